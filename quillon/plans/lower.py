"""QuerySpec to DataFrame.

Each alias is pruned to the columns the query touches, filtered, and renamed to
``t{alias}_c{index}``; self-joins are then free of ambiguous names.  The fold
starts at the first join's left alias and always takes the first predicate that
touches the joined set.  A new alias is joined on all predicates that connect it
at once (one composite key), so a cycle costs no extra pass.  Physical choices
stay with Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.fmt import wrapping_sum
from quillon.plans.dsl import ColumnRef, Filter, JoinPred, QuerySpec, parse
from quillon.sources.catalog import Catalog

U32 = 0xFFFFFFFF
#: Largest side that a broadcast hint is passed on for, as a hash table in memory; the driver holds it a few times over.
BROADCAST_BYTES = 64 << 20
#: What a row takes in a hash table besides twice its values.
ROW_BYTES = 64


class DisconnectedQuery(ValueError):
    pass


def _name(ref: ColumnRef) -> str:
    return f"t{ref.alias}_c{ref.index}"


def _compare(column: Column, f: Filter) -> Column:
    value = F.lit(f.value)
    return {"<": column < value, ">": column > value, "=": column == value}[f.op]


def hinted(df: DataFrame, hint: str | None) -> DataFrame:
    """``df`` with the hint, but for a broadcast of more than BROADCAST_BYTES.

    Spark's estimate goes by the size of packed files, which tells little of rows in
    memory: it only rules out, and a side that it lets through is counted.
    """
    if hint == "broadcast":
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if estimate > BROADCAST_BYTES or df.count() * (ROW_BYTES + 2 * df._jdf.schema().defaultSize()) > BROADCAST_BYTES:
            return df
    return df.hint(hint) if hint else df


def lower(
    catalog: Catalog,
    spec: QuerySpec,
    *,
    order: Sequence[JoinPred] | None = None,
    hint: str | None = None,
    allow_cross: bool = False,
    compat_u32: bool = False,
) -> DataFrame:
    """The joined and filtered rows, one column per touched ``alias.index``.

    order: the join predicates in the order to fold (default: as written).
    hint: a Spark join hint for every join (``broadcast``, ``shuffle_hash``, ``merge``);
    a side is broadcast only if its rows, which are counted, take at most BROADCAST_BYTES.
    allow_cross: SQL's cross product for aliases no predicate connects, else an error.
    compat_u32: filters and joins compare the low 32 bits only.
    """
    joins = list(order if order is not None else spec.joins)
    if sorted(map(repr, joins)) != sorted(map(repr, spec.joins)):
        raise ValueError("order must be a permutation of the query's join predicates")
    touched = {*spec.projections, *(f.column for f in spec.filters)}
    touched |= {c for j in joins for c in (j.left, j.right)}
    key = (lambda c: c.bitwiseAND(F.lit(U32))) if compat_u32 else (lambda c: c)
    col = lambda ref: key(F.col(_name(ref)))

    def scan(alias: int) -> DataFrame:
        refs = sorted(c for c in touched if c.alias == alias)
        base = catalog.columns(spec.relations[alias], [r.index for r in refs])
        df = base.select(*(F.col(f"c{r.index}").alias(_name(r)) for r in refs))
        for f in spec.filters:
            if f.column.alias == alias:
                df = df.filter(_compare(col(f.column), f))
        for j in joins:
            if j.same_alias and j.left.alias == alias:
                df = df.filter(col(j.left) == col(j.right))
        return df

    pending = [j for j in joins if not j.same_alias]
    first = pending[0].left.alias if pending else 0
    df, joined = scan(first), {first}
    while len(joined) < len(spec.relations):
        new = next((b for j in pending for a, b in ((j.left.alias, j.right.alias), (j.right.alias, j.left.alias)) if a in joined and b not in joined), None)
        if new is None:
            left_over = sorted(set(range(len(spec.relations))) - joined)
            if not allow_cross:
                raise DisconnectedQuery(f"no predicate connects aliases {left_over}; allow_cross=True gives their cross product")
            df, joined = df.crossJoin(scan(left_over[0])), joined | {left_over[0]}
        else:
            using = [j for j in pending if new in (j.left.alias, j.right.alias) and {j.left.alias, j.right.alias} <= joined | {new}]
            right = scan(new)
            on = [col(j.left) == col(j.right) for j in using]
            df = df.join(hinted(right, hint), on, "inner")
            pending, joined = [j for j in pending if j not in using], joined | {new}
        # Predicates between aliases that a cross product has brought together.
        for j in [j for j in pending if {j.left.alias, j.right.alias} <= joined]:
            df = df.filter(col(j.left) == col(j.right))
            pending.remove(j)
    return df


def query(catalog: Catalog, line: str | QuerySpec, *, wrap_u64: bool = False, **how) -> DataFrame:
    """One row of sums ``s0, s1, ...``; NULL where no row qualifies.

    The sum is a bigint that raises on overflow, or with wrap_u64 a decimal(20,0)
    modulo 2**64.
    """
    spec = line if isinstance(line, QuerySpec) else parse(line)
    total = wrapping_sum if wrap_u64 else F.sum
    return lower(catalog, spec, **how).agg(*(total(F.col(_name(c))).alias(f"s{i}") for i, c in enumerate(spec.projections)))
