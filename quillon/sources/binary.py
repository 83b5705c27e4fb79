"""Binary columnar relations as a Spark data source.

Layout, native byte order: ``u64 rows, u64 columns``, then each column as
``rows`` contiguous u64 values.  A scan is split into row ranges; each task reads
only its slice of the columns named in the ``columns`` option (Spark does not tell
Python sources which columns a query uses, so the catalog names them), and of the
rest only where a pushed filter holds (the ``pushdown`` option).  Spark's LongType holds values below 2**63;
a larger one raises unless ``decimal`` is set, which yields decimal(20,0) columns
over the full unsigned range.  A header with no rows is an empty relation.

A relation is one file, or a folder of such files with a list of them: the form that
``write_frame`` writes in parallel.  Paths are local ones that all executors see, or
URIs of a store that pyarrow reads (hdfs, s3, gs, file).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FORMAT = "u64col"
HEADER_BYTES = 16
ROWS_PER_PARTITION = 4_000_000
ROWS_PER_BATCH = 65_536
#: The session setting without which Spark refuses readers that take filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: A folder's list of files, one ``rows name`` a line, written when all files are complete.
LIST = "_files"
_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def header(path: str) -> tuple[int, int]:
    """Rows and columns of one file."""
    store, at = _store(path)
    with store.open_input_file(at) as file:
        size = file.size()
        if size < HEADER_BYTES:
            raise ValueError(f"{path}: {size} bytes, the header alone has {HEADER_BYTES}")
        rows, columns = np.frombuffer(file.read_at(HEADER_BYTES, 0), np.uint64).tolist()
    if size != HEADER_BYTES + 8 * rows * columns:
        raise ValueError(f"{path}: {size} bytes do not hold {rows} rows of {columns} columns")
    return rows, columns


def files(path: str) -> list[str]:
    """The files of a relation: itself, or those that a folder lists."""
    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    with store.open_input_file(f"{at}/{LIST}") as file:
        return [f"{path.rstrip('/')}/{line.split()[1]}" for line in file.read().decode().splitlines()]


def _bytes(columns: Sequence[np.ndarray]) -> Iterator[bytes]:
    rows = len(columns[0]) if columns else 0
    yield np.array([rows, len(columns)], np.uint64).tobytes()
    for column in columns:
        if len(column) != rows:
            raise ValueError("columns differ in length")
        yield np.asarray(column).astype(np.uint64).tobytes()


def write(path: str, columns: Sequence[np.ndarray]) -> None:
    """One file from equally long arrays."""
    store, at = _store(path)
    with store.open_output_stream(at) as out:
        for part in _bytes(columns):
            out.write(part)


def write_frame(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_PARTITION) -> int:
    """Writes bigint columns without nulls as a folder of files; returns the rows.

    One pass: each task writes files of up to ``rows_per_file`` rows under names of
    its own, and the list holds those of the attempts that succeeded.  A task that
    is run twice or at once leaves files that no list names.
    """
    store, at = _store(folder)
    store.create_dir(at)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def close() -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}"
            write(f"{folder.rstrip('/')}/{name}", [np.concatenate(c) for c in zip(*held, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["name", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append([column.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64) for column in batch.columns])
                rows += batch.num_rows
            if rows >= rows_per_file:
                yield close()
                held, rows = [], 0
        if rows:
            yield close()

    from pyspark.sql import functions as F

    wide = df.select(*(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").cast("bigint")).otherwise(F.raise_error(F.lit(f"null in {c}"))).alias(c) for c in df.columns))
    made = sorted(map(tuple, wide.mapInArrow(fill, "name string, n long").collect()))  # one short row a file
    if not made:
        write(f"{folder.rstrip('/')}/part-none", [np.zeros(0, np.uint64) for _ in df.columns])
        made = [("part-none", 0)]
    with store.open_output_stream(f"{at}/{LIST}") as out:
        out.write("".join(f"{n} {name}\n" for name, n in made).encode())
    return sum(n for _, n in made)


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    last: int
    rows: int


class U64Scan(DataSourceReader):
    """Reads row ranges.  It takes no filters: Spark refuses a reader that does where the session has not enabled that."""

    def __init__(self, path: str, schema: T.StructType, rows_per_partition: int) -> None:
        self.path, self.schema, self.step = path, schema, rows_per_partition
        self.filters: list[tuple[type, str, int]] = []

    def partitions(self) -> list[RowRange]:
        found = [(p, header(p)[0]) for p in files(self.path)]
        return [RowRange(p, a, min(a + self.step, n), n) for p, n in found for a in range(0, n, self.step)] or [RowRange("", 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        kinds = {f.name: f.dataType for f in self.schema.fields}
        store, at = _store(partition.path)
        with store.open_input_file(at) as file:
            for a in range(partition.first, partition.last, ROWS_PER_BATCH):
                n = min(a + ROWS_PER_BATCH, partition.last) - a
                got: dict[str, pa.Array] = {}

                def column(name: str, a=a, n=n, got=got) -> pa.Array:
                    if name not in got:
                        raw = file.read_at(8 * n, HEADER_BYTES + 8 * (int(name[1:]) * partition.rows + a))
                        values = pa.Array.from_buffers(pa.uint64(), n, [None, pa.py_buffer(raw)])
                        # Both casts check the range: a value that does not fit raises.
                        got[name] = values.cast(pa.int64() if isinstance(kinds[name], T.LongType) else pa.decimal128(20, 0))
                    return got[name]

                keep = None
                for kind, name, value in self.filters:
                    side = column(name)
                    hit = _COMPARED[kind](side, pa.scalar(value, pa.int64()).cast(side.type))
                    keep = hit if keep is None else pc.and_(keep, hit)
                if keep is not None and not pc.any(keep).as_py():
                    continue
                batch = pa.RecordBatch.from_arrays([column(name) for name in kinds], list(kinds))
                yield batch if keep is None else batch.filter(keep)


class U64Reader(U64Scan):
    def pushFilters(self, filters):  # noqa: N802
        """Comparisons of a column with a number are applied to a batch before any other column of it is read."""
        names = set(self.schema.names)
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and f.attribute[0] in names and isinstance(f.value, int) and -(2**63) <= f.value < 2**63:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f


class U64Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        kind = T.DecimalType(20, 0) if self.options.get("decimal", "false").lower() == "true" else T.LongType()
        width = header(files(self.options["path"])[0])[1]
        wanted = [int(x) for x in self.options.get("columns", "").split(",") if x] or range(width)
        if bad := [i for i in wanted if i >= width]:
            raise ValueError(f"column {bad[0]} is out of range: {self.options['path']} has {width}")
        return T.StructType([T.StructField(f"c{i}", kind, False) for i in wanted])

    def reader(self, schema: T.StructType) -> U64Scan:
        kind = U64Reader if self.options.get("pushdown", "false").lower() == "true" else U64Scan
        return kind(self.options["path"], schema, int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))


def read(spark: SparkSession, path: str, decimal: bool = False, rows_per_partition: int = ROWS_PER_PARTITION, columns: Sequence[int] | None = None) -> DataFrame:
    """columns: indices of the columns to read, all if none are named.

    Filters reach the reader where ``spark.sql.python.filterPushdown.enabled`` is set as
    the frame is made (``quillon.session`` sets it); elsewhere Spark applies them after the scan.
    """
    spark.dataSource.register(U64Source)
    pushdown = spark.conf.get(PUSHDOWN, "false")
    options = {"pushdown": pushdown, "decimal": str(decimal).lower(), "rowsPerPartition": str(rows_per_partition), "columns": ",".join(map(str, columns or ()))}
    return spark.read.format(FORMAT).options(**options).load(path)
