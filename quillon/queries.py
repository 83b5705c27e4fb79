"""The registered queries of the engine, each with the SQL that states its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import bits
from quillon.functions.fmt import checksum_line, wrapping_sum
from quillon.operators import radix
from quillon.operators.stats import column_stats
from quillon.plans import order as ordering
from quillon.plans.batch import Engine
from quillon.plans.dsl import QuerySpec, parse
from quillon.plans.lower import query
from quillon.sources import binary, tbl
from quillon.sources.catalog import STAR, Catalog, parquet_frame, star_catalog

Query = Callable[[SparkSession, str], DataFrame]

#: Queries stated in the compact language.
DSL = {
    "scan_sum": "6||0.0",
    "project_cols": "6||0.1 0.2",
    "filter_gt": "6|0.2>50|0.1",
    "filter_lt": "6|0.2<50|0.1",
    "filter_eq": "6|0.2=50|0.1",
    "filter_conj": "6|0.2>10&0.2<50&0.3=1|0.1",
    "filter_empty": "6|0.2>100000|0.1",
    "col_eq_same_alias": "6|0.2=0.3|0.1",
    "join_two": "6 5|0.0=1.0&0.2>50|0.1 1.1",
    "join_filtered": "6 5|0.0=1.0&0.2>50&1.1<100|0.1 1.1",
    "join_three_chain": "6 5 2|0.0=1.0&1.1=2.0&2.1<5|0.1 2.1",
    "join_star4": "6 5 4 3|0.0=1.0&0.1=2.0&0.2=3.0&2.1>25|0.1 2.1 3.1",
    "self_join": "6 6|0.0=1.0&0.3=1|0.1 1.2",
    "join_m2n": "2 3|0.1=1.1&0.0<500|0.0 1.0",
    "join_cycle": "6 5 2 3|0.0=1.0&1.1=2.0&0.2=3.0&3.1=2.1&0.3<4|0.1",
    "join_redundant": "6 5|0.0=1.0&1.0=0.0|0.1",
    "join_empty": "6 5|0.0=1.0&0.2>100000|0.1 1.1",
    "multi_projection": "6 5|0.0=1.0&0.2>50|0.1 1.1 0.1",
    "join_events": "7 2|0.1=1.0|0.0 1.1",
    "join_docs": "8 9|0.0=1.0&1.1=1|0.0 0.1",
}

#: The batch of batch_run and format_line: one query ends without rows.
BATCH = ("filter_gt", "join_two", "join_empty", "join_three_chain", "col_eq_same_alias")


def _oracle(spec: QuerySpec, outer: str = "{inner}") -> str:
    sources = ", ".join(
        f"(SELECT {', '.join(f'CAST({c} AS BIGINT) AS c{k}' for k, c in enumerate(STAR[r][1]))} FROM {STAR[r][0]}) t{i}" for i, r in enumerate(spec.relations)
    )
    col = lambda c: f"t{c.alias}.c{c.index}"
    where = [f"{col(j.left)} = {col(j.right)}" for j in spec.joins] + [f"{col(f.column)} {f.op} {f.value}" for f in spec.filters]
    sums = ", ".join(f"CAST(SUM({col(c)}) AS BIGINT) AS s{i}" for i, c in enumerate(spec.projections))
    return outer.format(inner=f"SELECT {sums} FROM {sources}" + (f" WHERE {' AND '.join(where)}" if where else ""))


def _dsl(line: str, **how) -> Query:
    return lambda spark, sf_dir: query(star_catalog(spark, sf_dir), line, **how)


def _ordered(policy: str) -> Query:
    return lambda spark, sf_dir: Engine(star_catalog(spark, sf_dir), policy).query(DSL["join_star4"])


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return parquet_frame(spark, f"{sf_dir}/{table}.parquet")


def _batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = list(Engine(star_catalog(spark, sf_dir)).run([DSL[k] for k in BATCH] + ["F"]))
    return spark.createDataFrame(list(enumerate(lines, 1)), "query_no long, line string")


def _format_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, out = star_catalog(spark, sf_dir), None
    for n, key in enumerate(BATCH, 1):
        sums = query(catalog, DSL[key])
        line = sums.select(F.lit(n).cast("bigint").alias("query_no"), checksum_line(sums).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out


def _line_sql() -> str:
    one = lambda k: " || ' ' || ".join(f"COALESCE(CAST(NULLIF(s{i}, 0) AS VARCHAR), 'NULL')" for i in range(len(parse(DSL[k]).projections)))
    return " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS query_no, {one(k)} AS line FROM ({_oracle(parse(DSL[k]))}) q{n}" for n, k in enumerate(BATCH, 1))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name that all executors see: below spark.checkpoint.dir, or a local one where none is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        import tempfile

        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _scan_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    binary.write_frame(star_catalog(spark, sf_dir)[4], folder)
    return binary.read(spark, folder).agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))


def _scan_binary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two binary relations: only the columns it touches are read, filters reach the reader."""
    source, catalog = star_catalog(spark, sf_dir), Catalog(spark)
    for relation in (6, 4):
        folder = shared_folder(spark)
        binary.write_frame(source[relation], folder)
        catalog.binary(source.names[relation], folder)
    return query(catalog, "0 1|0.1=1.0&1.1>25&0.2<50|0.1 1.1")


def _scan_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    tbl.write(star_catalog(spark, sf_dir)[4], folder)
    return tbl.read(spark, folder, 2).agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_stats(star_catalog(spark, sf_dir)[6])


def _estimate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = parse(DSL["filter_gt"])
    engine = Engine(star_catalog(spark, sf_dir), exact_stats=True)
    stats = ordering.filtered(spec, ordering.alias_stats(spec, {r: engine.relation_stats(r) for r in spec.relations}))
    return spark.createDataFrame([(str(c), float(s.min), float(s.max), float(s.count), float(s.distinct)) for c, s in sorted(stats.items())], "col string, min double, max double, count double, distinct double")


def _estimate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = parse(DSL["join_two"])
    engine = Engine(star_catalog(spark, sf_dir), exact_stats=True)
    stats = ordering.alias_stats(spec, {r: engine.relation_stats(r) for r in spec.relations})
    return spark.createDataFrame([(ordering.cost(spec, stats, spec.joins),)], "rows double")


def _all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_star4 once per connected join order: the sums do not depend on it."""
    from itertools import permutations

    spec, catalog, out = parse(DSL["join_star4"]), star_catalog(spark, sf_dir), None
    for o in (p for p in permutations(spec.joins) if ordering.connected(p)):
        one = query(catalog, spec, order=o)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _ranhash_sql() -> str:
    wide = lambda x: f"(CAST({x} AS UHUGEINT) % 18446744073709551616)"
    mul = lambda x, f, a=0: f"""(
        (CAST({x} AS UHUGEINT) % 4294967296) * {f & 0xFFFFFFFF}::UHUGEINT
        + ((((CAST({x} AS UHUGEINT) >> 32) * {f & 0xFFFFFFFF}::UHUGEINT) + ((CAST({x} AS UHUGEINT) % 4294967296) * {f >> 32}::UHUGEINT)) % 4294967296) * 4294967296::UHUGEINT
        + {a}::UHUGEINT) % 18446744073709551616::UHUGEINT"""  # noqa: E731
    right = lambda x, n: f"xor({x}, {x} >> {n})"
    left = lambda x, n: f"xor({x}, ({x} << {n}) % 18446744073709551616::UHUGEINT)"
    steps = [mul("h", bits.HASH_MULTIPLIER_1, bits.HASH_INCREMENT), right("h", 21), left("h", 37), right("h", 4), mul("h", bits.HASH_MULTIPLIER_2), left("h", 20), right("h", 41), left("h", 5)]
    inner = f"SELECT p_partkey, {wide('p_partkey')} AS h FROM part"
    for s in steps:
        inner = f"SELECT p_partkey, {s} AS h FROM ({inner})"
    return f"SELECT p_partkey, CAST(h % 16 AS BIGINT) AS bucket FROM ({inner})"


QUERIES: dict[str, Query] = {k: _dsl(v) for k, v in DSL.items()} | {
    "join_hint_broadcast": _dsl(DSL["join_two"], hint="broadcast"),
    "join_hint_shuffle_hash": _dsl(DSL["join_two"], hint="shuffle_hash"),
    "zero_sum_null": lambda s, d: query(star_catalog(s, d), "2|0.0=0|0.0").select(F.nullif("s0", F.lit(0)).alias("s0")),
    "join_pairs": lambda s, d: radix.pair_join(_read(s, d, "orders").select("o_orderkey", "o_custkey"), _read(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_custkey")),
    "radix_histogram": lambda s, d: radix.histogram(_read(s, d, "lineitem"), "l_partkey", 8),
    "radix_prefix_sum": lambda s, d: radix.prefix_sum(radix.histogram(_read(s, d, "lineitem"), "l_partkey", 8)),
    "radix_max_partition": lambda s, d: radix.largest_partition(radix.histogram(_read(s, d, "lineitem"), "l_partkey", 8)),
    "radix_partition": lambda s, d: radix.clustered(_read(s, d, "part").select("p_partkey"), "p_partkey", 8),
    "radix_partition2": lambda s, d: radix.clustered(_read(s, d, "part").select("p_partkey"), "p_partkey", 8, 10),
    "radix_layout": lambda s, d: radix.layout(radix.clustered(_read(s, d, "lineitem").select("l_partkey"), "l_partkey", 8)),
    "radix_layout2": lambda s, d: radix.layout(radix.clustered(_read(s, d, "lineitem").select("l_partkey"), "l_partkey", 4, 6)),
    "value_lookup": lambda s, d: radix.value_lookup(_read(s, d, "lineitem"), "l_partkey", 42, "l_orderkey"),
    "value_index": lambda s, d: radix.value_index(_read(s, d, "lineitem").select("l_partkey", "l_orderkey"), "l_partkey", "l_orderkey").select("value", "page", "n", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids")),
    "column_stats": _stats,
    "sum_wrap_u64": lambda s, d: _read(s, d, "lineitem").select((F.col("l_orderkey").cast("decimal(20,0)") * F.lit(900000000000000).cast("decimal(15,0)")).alias("v")).agg(wrapping_sum(F.col("v")).cast("string").alias("s0")),
    "join_order_simple": _ordered("simple"),
    "join_order_greedy": _ordered("greedy"),
    "join_order_all": _all_orders,
    "estimate_filter": _estimate_filter,
    "estimate_join": _estimate_join,
    "ranhash": lambda s, d: _read(s, d, "part").select("p_partkey", bits.unsigned_mod_pow2(bits.ranhash(F.col("p_partkey")), 4).alias("bucket")),
    "bit_helpers": lambda s, d: _read(s, d, "part").select("p_partkey", bits.pow2_at_least(F.col("p_size")).alias("pow2"), bits.nth_bit(F.col("p_partkey"), 3).alias("bit3"), bits.low_bits(F.col("p_partkey"), 5).alias("low5")),
    "batch_run": _batch_run,
    "format_line": _format_line,
    "cross_product": _dsl("0 1||0.0 1.1", allow_cross=True),
    "scan_binary": _scan_binary,
    "scan_binary_filter": _scan_binary_filter,
    "scan_tbl": _scan_tbl,
}

_PAIRS_SQL = "SELECT o.o_orderkey AS r_id, c.c_custkey AS s_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
_HIST_SQL = "SELECT l_partkey & 255 AS bucket, COUNT(*) AS n FROM lineitem GROUP BY 1"
_LAYOUT_SQL = "SELECT l_partkey & {} AS bucket, COUNT(*) AS n, CAST(1 AS BIGINT) AS n_partitions, CAST(0 AS BIGINT) AS n_falls FROM lineitem GROUP BY 1"
_STATS_SQL = " UNION ALL ".join(
    f"SELECT 'c{i}' AS col, CAST(MIN({c}) AS BIGINT) AS min, CAST(MAX({c}) AS BIGINT) AS max, COUNT({c}) AS count, COUNT(DISTINCT {c}) AS distinct FROM lineitem" for i, c in enumerate(STAR[6][1])
)
_PART_SUM_SQL = "SELECT CAST(SUM(p_partkey) AS BIGINT) AS s0, CAST(SUM(p_size) AS BIGINT) AS s1 FROM part"

#: Statistics of lineitem after l_suppkey > 50: the uniform share of the range, on all counts.
_FILTERED_SQL = f"""WITH stats AS ({_STATS_SQL}), share AS (
  SELECT CASE WHEN count <= 0 THEN 0.0 WHEN max = min THEN CAST(min > 50 AS INT) ELSE LEAST(1.0, GREATEST(0.0, CAST(max - 50 AS DOUBLE) / (max - min))) END AS f FROM stats WHERE col = 'c2'
), rest AS (SELECT col, min, max, count * f AS count, LEAST("distinct", count * f) AS d, f FROM stats, share)
SELECT '0.' || substr(col, 2) AS col, CAST(CASE WHEN col = 'c2' THEN GREATEST(min, 51) ELSE min END AS DOUBLE) AS min, CAST(CASE WHEN col = 'c2' THEN GREATEST(max, min, 51) ELSE max END AS DOUBLE) AS max,
  CAST(count AS DOUBLE) AS count, CAST(CASE WHEN col = 'c2' THEN d * f ELSE d END AS DOUBLE) AS "distinct" FROM rest"""
#: Rows of the filtered lineitem joined with orders: both sides cut to the common range, over the larger distinct count.
_JOINED_SQL = f"""WITH l AS (SELECT * FROM ({_FILTERED_SQL}) WHERE col = '0.0'), r AS (
  SELECT CAST(MIN(o_orderkey) AS DOUBLE) AS min, CAST(MAX(o_orderkey) AS DOUBLE) AS max, COUNT(*) AS count, COUNT(DISTINCT o_orderkey) AS d FROM orders
), inside AS (SELECT l.count AS lc, l."distinct" AS ld, r.count AS rc, r.d AS rd, GREATEST(l.min, r.min) AS low, LEAST(l.max, r.max) AS high,
  LEAST(1.0, (LEAST(l.max, r.max) - GREATEST(l.min, r.min) + 1) / (l.max - l.min + 1)) AS fl, LEAST(1.0, (LEAST(l.max, r.max) - GREATEST(l.min, r.min) + 1) / (r.max - r.min + 1)) AS fr FROM l, r)
SELECT CAST(CASE WHEN low > high OR lc = 0 OR rc = 0 THEN 0 ELSE (lc * fl) * (rc * fr) / GREATEST(1.0, ld * fl, rd * fr) END AS DOUBLE) AS rows FROM inside"""

ORACLE: dict[str, str] = {k: _oracle(parse(v)) for k, v in DSL.items()} | {
    "join_hint_broadcast": _oracle(parse(DSL["join_two"])),
    "join_hint_shuffle_hash": _oracle(parse(DSL["join_two"])),
    "zero_sum_null": _oracle(parse("2|0.0=0|0.0"), "SELECT NULLIF(s0, 0) AS s0 FROM ({inner})"),
    "join_pairs": _PAIRS_SQL,
    "radix_histogram": _HIST_SQL,
    "radix_prefix_sum": f"SELECT bucket, CAST(COALESCE(SUM(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_HIST_SQL})",
    "radix_max_partition": f"SELECT MAX(n) AS max_n FROM ({_HIST_SQL})",
    "radix_partition": "SELECT p_partkey, p_partkey & 255 AS bucket FROM part",
    "radix_partition2": "SELECT p_partkey, p_partkey & 255 AS bucket, (p_partkey >> 8) & 1023 AS bucket2 FROM part",
    "radix_layout": _LAYOUT_SQL.format(255),
    "radix_layout2": _LAYOUT_SQL.format(15),
    "value_lookup": "SELECT l_orderkey FROM lineitem WHERE l_partkey = 42",
    "value_index": f"SELECT l_partkey AS value, l_orderkey // {radix.PAGE} AS page, COUNT(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS ids FROM lineitem GROUP BY 1, 2",
    "column_stats": _STATS_SQL,
    "sum_wrap_u64": "SELECT CAST(SUM(CAST(l_orderkey AS HUGEINT) * 900000000000000) % 18446744073709551616 AS VARCHAR) AS s0 FROM lineitem",
    "join_order_simple": _oracle(parse(DSL["join_star4"])),
    "join_order_greedy": _oracle(parse(DSL["join_star4"])),
    "join_order_all": _oracle(parse(DSL["join_star4"])),
    "ranhash": _ranhash_sql(),
    "bit_helpers": "SELECT p_partkey, CAST(CASE WHEN p_size <= 1 THEN 1 ELSE 1 << CAST(ceil(log2(p_size)) AS INT) END AS BIGINT) AS pow2, (p_partkey >> 3) & 1 AS bit3, p_partkey & 31 AS low5 FROM part",
    "estimate_filter": _FILTERED_SQL,
    "estimate_join": _JOINED_SQL,
    "batch_run": _line_sql(),
    "format_line": _line_sql(),
    "cross_product": "SELECT CAST(SUM(r.r_regionkey) AS BIGINT) AS s0, CAST(SUM(n.n_regionkey) AS BIGINT) AS s1 FROM region r CROSS JOIN nation n",
    "scan_binary": _PART_SUM_SQL,
    "scan_binary_filter": _oracle(parse("6 4|0.1=1.0&1.1>25&0.2<50|0.1 1.1")),
    "scan_tbl": _PART_SUM_SQL,
}
