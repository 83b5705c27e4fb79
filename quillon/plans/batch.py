"""Batches of query lines: concurrent Spark jobs, results in input order.

``F`` or a blank line ends a batch; the end of input flushes the last one.
Queries run on a small driver thread pool; each is one Spark job that returns a
single row, and the FAIR scheduler (``spark.scheduler.mode``) shares executors
among them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target

from quillon.functions.fmt import format_row
from quillon.operators.stats import ColumnStats, collect_stats
from quillon.plans import order as ordering
from quillon.plans.dsl import parse
from quillon.plans.lower import query
from quillon.sources.catalog import Catalog

CONCURRENCY = 3


def batches(lines: Iterable[str]) -> Iterator[list[str]]:
    batch: list[str] = []
    for line in lines:
        text = line.rstrip("\r\n")
        if text in ("F", ""):
            if batch:
                yield batch
            batch = []
        else:
            batch.append(text)
    if batch:
        yield batch


class Engine:
    """Answers query lines over a catalog under a join-order policy.

    exact_stats: count distinct values exactly, which shuffles every column; a sketch,
    one map-side pass, is enough to order joins.
    """

    def __init__(self, catalog: Catalog, policy: str = "none", concurrency: int = CONCURRENCY, exact_stats: bool = False) -> None:
        self.catalog, self.policy, self.concurrency, self.exact_stats = catalog, policy, concurrency, exact_stats
        self._stats: dict[int, dict[str, ColumnStats]] = {}
        self._locks: defaultdict[int, Lock] = defaultdict(Lock)

    def relation_stats(self, relation: int) -> dict[str, ColumnStats]:
        """Statistics of a relation, computed once; queries that need them meanwhile wait."""
        with self._locks[relation]:
            if relation not in self._stats:
                self._stats[relation] = collect_stats(self.catalog[relation], self.exact_stats)
            return self._stats[relation]

    def query(self, line: str, **how):
        spec = parse(line)
        if self.policy != "none" and ordering.needs_reorder(spec):
            stats = ordering.alias_stats(spec, {r: self.relation_stats(r) for r in set(spec.relations)})
            how["order"] = ordering.choose(self.policy, spec, stats)
        return query(self.catalog, spec, **how)

    def answer(self, line: str) -> str:
        return format_row(self.query(line).first())

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        """One checksum line per query, batch after batch."""
        with ThreadPoolExecutor(self.concurrency) as pool:
            for batch in batches(lines):
                yield from pool.map(inheritable_thread_target(self.answer), batch)
