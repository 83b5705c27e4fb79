"""What several operators share: intermediate tables, components of a graph, bounded pre-filters."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters in SQL: all but space and \t \n \v \f \r.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD_BYTES = b" \t\n\v\f\r"


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one where none is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_quillon_base"):
        context._quillon_base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return context._quillon_base


#: Rows sent to a Python worker at once while a table is written, which bounds what it holds of whole texts.
BATCH_ROWS = 1_000

#: In force while a table is written: its job's shuffle files go when it ends, for nothing reads them again.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; the caller's own come back."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Tasks a core that write a table of few rows.
TASKS_A_CORE = 4


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks write a table that follows ``rows``: one for ``each`` of them, and enough for all cores."""
    return max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, rows // each)


def table(df: DataFrame, like: str = "t", tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, a lost executor costs nothing before it.

    tasks: at most so many write it; where nothing joins small partitions, a file for each costs more than its rows.
    """
    spark = df.sparkSession
    path = f"{shared_base(spark)}/quillon/{like}-{uuid.uuid4().hex}"
    if tasks is not None:
        df = df.coalesce(tasks)
    with settings(spark, _WRITING):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.quillon_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quillon-")
    with zipfile.ZipFile(f"{folder}/quillon_package.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{folder}/quillon_package.zip")  # the driver serves it
    context._quillon_shipped = True


def release() -> None:
    """Gives freed memory of a Python worker back to the system; workers outlive the tasks that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def sliced(arrays: Iterator[pa.Array], rows: int = 500) -> Iterator[pa.Array]:
    """The same values in arrays of at most ``rows``: what a worker makes of one is gone before the next."""
    for a in arrays:
        for at in range(0, len(a), rows):
            yield a.slice(at, rows)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns under these very names, whatever else the input carries."""
    return df.select(*(F.col(f"`{n}`").alias(n) for n in names))


#: Buckets of the broadcast pre-filter: at most so many longs are sent, however large the input.
PREFILTER_BUCKETS = 1 << 18


def semi_join_large(big: DataFrame, ids: DataFrame, key: str, buckets: int = PREFILTER_BUCKETS) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids`` (one distinct column of that name).

    Hash buckets of the ids, at most ``buckets`` of them, are broadcast first and
    drop most other rows before the shuffle join decides.  With more ids than
    buckets the first step just drops less.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    wanted = ids.select(slot.alias("_slot")).distinct()
    return big.withColumn("_slot", slot).join(F.broadcast(wanted), "_slot", "left_semi").drop("_slot").join(ids, key, "left_semi")


def components(edges: DataFrame, like: str = "cc", tasks: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, comp)``, comp the smallest node reachable.

    Every node hooks on its smallest neighbour; the graph is contracted to the
    labels and the step repeated until no edge joins two labels.  State lives in
    tables in the shared folder.  A level's aggregates combine map-side and its
    joins carry no pairs beyond the edges, so that a node with very many edges is
    only a skewed join side, which adaptive execution splits.  tasks: see ``table``.
    """
    edges = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{like}-e", tasks)
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("m")), F.struct(F.col("b").alias("node"), F.col("a").alias("m")))).alias("x")).select("x.*")
        labels = table(both.groupBy("node").agg(F.min("m").alias("comp")), f"{like}-l", tasks)
        # Hooks only point to smaller nodes: follow them to their roots before contracting.
        while True:
            up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            labels = table(labels.join(up, "comp").select("node", F.col("root").alias("comp"), (F.col("comp") != F.col("root")).alias("moved")), f"{like}-l", tasks)
            if labels.where("moved").isEmpty():
                break
        labels = labels.select("node", "comp")
        levels.append(labels)
        la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        mapped = edges.join(la, "a").join(lb, "b").where("ca <> cb")
        edges = table(mapped.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"{like}-e", tasks)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = levels[-1]
    for labels in reversed(levels[:-1]):
        up = out.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        out = table(labels.join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{like}-o", tasks)
    return out
