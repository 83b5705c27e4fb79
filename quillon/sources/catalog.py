"""Ordered relation catalog: a relation's id is its load order.

Every relation is a DataFrame whose columns are ``c0..cN`` of type bigint.  Any
loader feeds it: Parquet columns, pipe-delimited text, the binary columnar
format, or a DataFrame at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources import binary, tbl


#: Schemas of Parquet paths by application, path and time of change: read from a footer once, not for each query.
_schemas: dict[tuple, StructType] = {}


def parquet_frame(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; its files are listed anew, its schema is read again only if the path has changed."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    changed = where.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    key = (context.applicationId, path, changed)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


class Catalog:
    """Relations by load order.  A relation is opened when a query first touches it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.names: list[str] = []
        self._scans: list[Callable[[Sequence[int] | None], DataFrame]] = []
        self._frames: dict[int, DataFrame] = {}

    def __len__(self) -> int:
        return len(self._scans)

    def __getitem__(self, relation: int) -> DataFrame:
        """The relation with all its columns."""
        if relation not in self._frames:
            self._frames[relation] = self._scan(relation)(None)
        return self._frames[relation]

    def _scan(self, relation: int) -> Callable[[Sequence[int] | None], DataFrame]:
        if not 0 <= relation < len(self._scans):
            raise KeyError(f"relation {relation} of {len(self._scans)}")
        return self._scans[relation]

    def columns(self, relation: int, indices: Sequence[int]) -> DataFrame:
        """The named columns of a relation; a source that cannot be pruned by Catalyst reads these alone."""
        width = len(self[relation].columns)
        for i in indices:
            if i >= width:
                raise ValueError(f"column {i} is out of range: relation {relation} has {width}")
        return self._scan(relation)(indices).select(*(f"c{i}" for i in indices))

    def _add(self, name: str, scan: Callable[[Sequence[int] | None], DataFrame]) -> int:
        if name in self.names:
            raise ValueError(f"relation {name!r} is registered already")
        self.names.append(name)
        self._scans.append(scan)
        return len(self._scans) - 1

    def register(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> int:
        """Adds ``df`` (all or the named columns, in that order) and returns its id."""
        return self._add(name, lambda _: _numbered(df, columns))

    def parquet(self, name: str, path: str, columns: Sequence[str] | None = None) -> int:
        return self._add(name, lambda _: _numbered(parquet_frame(self.spark, path), columns))

    def tbl(self, name: str, path: str, n_columns: int) -> int:
        return self._add(name, lambda _: tbl.read(self.spark, path, n_columns))

    def binary(self, name: str, path: str) -> int:
        return self._add(name, lambda indices: binary.read(self.spark, path, columns=indices))

    def load_init(self, lines: Iterable[str], folder: str) -> list[int]:
        """Relation names, one a line, until ``Done``: binary files below ``folder``."""
        ids = []
        for line in lines:
            if (name := line.strip()) == "Done":
                break
            if name:
                ids.append(self.binary(name, f"{folder.rstrip('/')}/{name}"))
        return ids

    def create_views(self) -> None:
        for i, name in enumerate(self.names):
            self[i].createOrReplaceTempView(name)


def _numbered(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("bigint").alias(f"c{i}") for i, c in enumerate(columns or df.columns)))


#: The integer columns of the synthetic star schema, in relation-id order.
STAR = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey", "n_regionkey")),
    ("customer", ("c_custkey", "c_nationkey")),
    ("supplier", ("s_suppkey", "s_nationkey")),
    ("part", ("p_partkey", "p_size")),
    ("orders", ("o_orderkey", "o_custkey")),
    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    ("events", ("event_id", "user_id")),
    ("documents", ("doc_id", "n_chars")),
    ("labels", ("doc_id", "quality", "toxic")),
    ("pages", ("page_id",)),
    ("conversations", ("conv_id", "turn")),
    ("benchmark", ("item_id",)),
    ("embeddings", ("vec_id", "label")),
)


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = Catalog(spark)
    for name, columns in STAR:
        catalog.parquet(name, f"{sf_dir}/{name}.parquet", columns)
    return catalog
