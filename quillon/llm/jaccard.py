"""Similarity join of word n-gram sets by token-combination prefixes.

Sets link when ``100 * |x & y| >= threshold * |x | y|``.  Tokens (hashed n-grams) have
one global order, rare before frequent.  Prefixes are extended: of a set of n tokens
``n - ceil(threshold * n / 100) + extent(n)`` are taken, so that a linked pair shares
at least the smaller extent, which is 2 or more, in both.  A set is indexed under every rare token of its prefix, and under every two-token
combination of the frequent ones.  Sets of more than COMBINE tokens, whose
prefixes are long, use single frequent tokens instead; the classes overlap by the
size ratio of a linked pair, so that every pair meets in one of the two ways.

Sets that share fewer of their index keys with any other set than a partner would need
cannot link and go before pairs are made, and so do pairs that share too few.

Equal sets are collapsed first.  Candidates are then verified in rounds, for only
components are wanted: all members of a key are compared with a few pivots of
that key, what has been linked is one component, and keys inside one component
are done.  Then all pairs across components in the keys still open are compared, so
no link between components is missed: keys with few members by a join, larger
ones chunk against chunk or block against block inside tasks.  A pair is
first held against an exact upper bound of the intersection (histograms of token
hashes), then its sets are intersected.  No pairs of large keys leave a task: of two
chunks or blocks those documents do that have a partner within the bound, and then
the links of a spanning forest of what their sets say.

Frequent tokens: each task counts the tokens of its documents, a bounded number at a
time, and reports those that reach a share of them; the most frequent, at most
MAX_FREQUENT, form the class.  What the class holds changes speed only, never
results.

Defined results: text that is null or without words has an empty set and links with
nothing.  Rows that share a doc_id are one document; a null doc_id links with
nothing.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, components, forget, release, semi_join_large, ship, table, tasks_for

N = 4
THRESHOLD = 85
#: A token is frequent if it is in one of so many documents (and in MIN_FREQUENT of a task's documents).
FREQUENT_SHARE = 1_000
MIN_FREQUENT = 4
MAX_FREQUENT = 1 << 18
#: Largest smaller set of a pair that meets by combinations.
COMBINE = 200
PIVOTS = 4
PEELS = 2
PIVOT_ROUNDS = 2
#: Buckets of a histogram, one byte each; all are full where a count does not fit.
HISTOGRAM = 256
FULL = b"\xff" * HISTOGRAM
#: Members up to which a key's pairs are made by a join, and about as many make a block of a larger one.
SMALL_KEY = 32
BLOCK = 96
#: Documents of large keys that are compared as one, and how far those of a key may lie spread over such chunks.
CHUNK = 256
SPREAD = 4
#: Bytes of blocks made at once: so many at least, or so many a document of the input.
BLOCK_BYTES = 128 << 20
BLOCK_DOC_BYTES = 256
#: Bytes of whole sets held against each other at once, likewise.
SET_BYTES = 128 << 20
SET_DOC_BYTES = 1 << 10
#: Tokens of documents that are intersected with others at once, about.
PART_TOKENS = 1 << 20
#: Columns of the matrices that they are intersected by.
SLAB = 4096
#: Documents for each task that writes an intermediate table, at least.
TASK_DOCS = 2_000

_rng = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = (_rng.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word of the text, A-Z lower-cased."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _PLACE[63])


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence where it is shorter."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64) * _PLACE[62]
    for i in range(k):
        total = total + w[i : len(w) - k + 1 + i] * _PLACE[i]
    return np.unique(mix(total))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one = np.add.reduce(mix(s ^ _PLACE[60]), dtype=np.uint64)
    two = np.add.reduce(mix(s + _PLACE[61]), dtype=np.uint64)
    return int(np.array([one]).view(np.int64)[0]), int(np.array([two]).view(np.int64)[0])


#: One more shared token is asked of a pair for so many tokens of its sets.
EXTENT_STEP = 50


def extent(n):
    """Shared prefix tokens asked of a pair whose smaller set has n tokens (an int or a column)."""
    return 2 + (F.floor(n / EXTENT_STEP) if isinstance(n, Column) else n // EXTENT_STEP)


def prefix_keys(s: np.ndarray, frequent: np.ndarray, threshold: int, combine: int = COMBINE) -> tuple[np.ndarray, int]:
    """Index keys of a set, and the number of frequent tokens in its prefix.

    frequent: the frequent tokens, sorted by value, with ranks beside: shape (2, m).
    """
    n = len(s)
    if n < 2:
        return s[:0], 0  # only an equal set links with it
    need = max(-(-threshold * n // 100), 2)
    size = min(n, n - need + extent(n))
    at = np.searchsorted(frequent[0], s)
    at[at == frequent.shape[1]] = 0
    common = frequent[0][at] == s if frequent.shape[1] else np.zeros(n, bool)
    rare = s[~common][:size]
    often = s[common]
    if len(rare) == size or not len(often):
        return rare, 0
    often = often[np.argsort(frequent[1][at[common]], kind="stable")][: size - len(rare)]
    out = [rare]
    if n * threshold <= 100 * combine:  # also above combine, as far as a partner below it reaches
        i, j = np.triu_indices(len(often), 1)
        out.append(mix(often[i] * _PLACE[50] + often[j] * _PLACE[51]))
    if n > combine:
        out.append(often)
    return np.concatenate(out), len(often)


def _binary(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


#: Tokens a task gathers before it counts them.
COUNT_AT = 1_000_000


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (size and digest of its set), and rows of tokens frequent in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tokens = 0

        def rows(ids, sizes, ones, twos, token, count) -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in (ids, sizes, ones, twos, token, count)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "c1", "c2", "token", "count"])

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(MIN_FREQUENT, len(held) / FREQUENT_SHARE)
            values, counts = values[keep].view(np.int64), counts[keep]
            none = pa.nulls(len(values), pa.int64())
            return rows(none, none, none, none, values, counts)

        for batch in batches:
            ids, sizes, ones, twos = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, n)
                one, two = digest(s) if len(s) else (0, 0)
                ids.append(doc)
                sizes.append(len(s))
                ones.append(one)
                twos.append(two)
                held.append(s)
                tokens += len(s)
                if tokens >= COUNT_AT:
                    yield counted()
                    held.clear()
                    tokens = 0
            none = pa.nulls(len(ids), pa.int64())
            yield rows(ids, sizes, ones, twos, none, none)
        if tokens:
            yield counted()
        held.clear()
        release()

    return docs.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, token long, count long")


def _keys(docs: DataFrame, n: int, threshold: int, frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            ids, sizes, mixed, keys = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, n)
                found, often = prefix_keys(s, known, threshold)
                if doc is not None and len(found):
                    ids.append(doc)
                    sizes.append(len(s))
                    mixed.append(often)
                    keys.append(found.view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(mixed, pa.int64()), lists], ["doc_id", "n", "often", "keys"])
        release()

    return docs.mapInArrow(run, "doc_id long, n long, often long, keys array<long>")


def _texts(docs: DataFrame, n: int, column: str, value) -> DataFrame:
    """``doc, n`` and what ``value`` makes of the set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(text, n) for text in batch.column(1).to_pylist())
            made = [(len(s), value(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.int64()), _binary([x for _, x in made])], ["doc", "n", column])
        release()

    return docs.mapInArrow(run, f"doc long, n long, {column} binary")


def _hists(docs: DataFrame, n: int) -> DataFrame:
    def hist(s: np.ndarray) -> bytes:
        counts = np.bincount((s & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM)
        return FULL if counts.max() > 254 else counts.astype(np.uint8).tobytes()

    return _texts(docs, n, "hist", hist)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    return _texts(docs, n, "tokens", np.ndarray.tobytes)


def _pass_pairs(pairs: DataFrame, test) -> DataFrame:
    """``(a, b)`` of those rows ``(a, b, na, nb, xa, xb)`` that the test lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [test(*x) for x in zip(na, nb, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, hists: DataFrame, docs: DataFrame, n: int, threshold: int, total: int) -> DataFrame:
    """The candidate pairs ``(a, b)`` that link.

    Whole sets take more room than their texts.  They are made only for pairs that
    the bound lets through, in as many passes as keep those of one in a bound.
    total: the number of all documents, which the bound follows.
    """

    def enough(shared: int, na: int, nb: int) -> bool:
        return 100 * shared >= threshold * (na + nb - shared)

    tasks = tasks_for(docs.sparkSession, total, TASK_DOCS)

    def bound(na, nb, xa, xb) -> bool:
        both = np.minimum(np.frombuffer(xa, np.uint8), np.frombuffer(xb, np.uint8))
        return FULL in (xa, xb) or enough(int(both.sum(dtype=np.int64)), na, nb)

    def exact(na, nb, xa, xb) -> bool:
        both = np.concatenate([np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)])
        both.sort(kind="stable")
        return enough(int((both[1:] == both[:-1]).sum()), na, nb)

    def beside(p: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            p = p.join(sets.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col(column).alias(f"x{side}")), side)
        return p.select("a", "b", "na", "nb", "xa", "xb")

    likely = table(_pass_pairs(beside(pairs, hists, "hist"), bound).distinct(), "jac-likely", tasks)
    ends = likely.select(F.explode(F.array("a", "b")).alias("doc"))
    size = 8 * (ends.join(hists.select("doc", "n"), "doc").agg(F.sum("n")).first()[0] or 0)
    passes = -(-size // max(SET_BYTES, SET_DOC_BYTES * total)) or 1
    found = None
    for at in range(passes):
        mine = likely if passes == 1 else likely.where(F.pmod(F.xxhash64("a", F.lit("pass")), F.lit(passes)) == at)
        wanted = table(mine.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jac-exact", tasks)
        sets = table(_sets(semi_join_large(docs, wanted, "doc_id"), n), "jac-sets", tasks)
        new = table(_pass_pairs(beside(mine, sets, "tokens"), exact).distinct(), "jac-links", tasks)
        forget(wanted, sets)
        found = new if found is None else found.unionByName(new)
    forget(likely)
    return found


def _linked(near: list[DataFrame], docs: DataFrame, n: int, threshold: int, total: int) -> DataFrame | None:
    """Edges ``(a, b)`` of spanning forests of the links in each part of ``near``, as PARTS has them; passes as in ``_verified``."""
    tasks = tasks_for(docs.sparkSession, total, TASK_DOCS)
    found = None
    for rows in near:
        size = 8 * (rows.agg(F.sum("n")).first()[0] or 0)
        passes = -(-size // max(SET_BYTES, SET_DOC_BYTES * total))
        for at in range(passes):
            mine = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("part", F.lit("pass")), F.lit(passes)) == at)
            wanted = table(mine.select(F.col("doc").alias("doc_id")).distinct(), "jac-exact", tasks)
            sets = table(_sets(semi_join_large(docs, wanted, "doc_id"), n), "jac-sets", tasks)
            held = mine.select("part", "side", "doc", "comp").join(sets.select("doc", "tokens"), "doc").select("part", "side", "doc", "comp", "tokens")
            new = table(_forests(held.repartition("part").sortWithinPartitions("part"), threshold), "jac-links", tasks)
            forget(wanted, sets)
            found = new if found is None else found.unionByName(new)
    return found


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a set in ``one`` with a set in ``two``."""
    flat = [np.concatenate(x) for x in (one, two)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(one), len(two)), np.int64)
    sides = []
    for sets, tokens in zip((one, two), flat, strict=True):
        at = np.searchsorted(both, tokens)
        there = at < len(both)
        there[there] = both[at[there]] == tokens[there]
        order = np.argsort(at[there], kind="stable")
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[there][order], at[there][order]))
    for low in range(0, len(both), SLAB):
        width = min(SLAB, len(both) - low)
        slabs = []
        for sets, (owner, at) in zip((one, two), sides, strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            x = np.zeros((len(sets), width), np.float32)
            x[owner[a:b], at[a:b] - low] = 1
            slabs.append(x)
        out += (slabs[0] @ slabs[1].T).astype(np.int64)
    return out


def _forests(rows: DataFrame, threshold: int) -> DataFrame:
    """Of rows ``(part, side, doc, comp, tokens)``, sorted by part: edges that join what links across a part's sides."""

    def forest(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        side, doc, comp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (1, 2, 3))
        sets = [np.frombuffer(x, np.uint64) for b in held for x in b.column(4).to_pylist()]
        (d1, c1, s1), (d2, c2, s2) = ((doc[at], comp[at], [sets[i] for i in at]) for at in (np.flatnonzero(side == k) for k in (0, 1)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(d1) and len(d2):
            shared = _shared(s1, s2)
            union = np.array([len(s) for s in s1])[:, None] + np.array([len(s) for s in s2])[None, :] - shared
            link = 100 * shared >= threshold * union
            for x in np.flatnonzero(link.any(1)):
                y = np.flatnonzero(link[x] & (c2 != c1[x]))
                if len(y):
                    met, first = np.unique(c2[y], return_index=True)
                    a.append(np.full(len(met), d1[x]))
                    b.append(d2[y[first]])
                    label = c1[x]
                    c1[np.isin(c1, met)] = label
                    c2[np.isin(c2, met)] = label
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
            out = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if held and held[0].column(0)[0].as_py() != part[low]:
                    out.append(forest(held))
                    held = []
                held.append(batch.slice(low, high - low))
            yield _batch(out, PAIR)
        if held:
            yield _batch([forest(held)], PAIR)
        held = []
        release()

    return rows.mapInArrow(run, PAIR)


def _block_tables(live: DataFrame, sets: DataFrame, threshold: int, docs: int, form: tuple) -> list[DataFrame]:
    """All pairs across components that the bound lets through, of keys whose members come as ``(key, m, doc, n, comp)``, in the form asked for.

    A member carries its histogram and its other keys under every key, which grows
    with the square of its keys, unless the key's members lie in few chunks: the keys are dealt to as many passes as keep the
    blocks of one in a bound.  Passes share no key, so all keys are compared.
    docs: the number of all documents, which the bound follows.
    """
    tasks = tasks_for(live.sparkSession, docs, TASK_DOCS)
    chunked, dense = _chunk_pairs(live, sets, threshold, tasks, form)
    chunked = table(chunked, "jac-near", tasks)
    live = table(live.join(dense, "key", "left_anti"), "jac-spread", tasks)
    lists = live.groupBy("doc").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    lists = table(lists.join(sets.select("doc", "hist"), "doc"), "jac-lists", tasks)
    size = F.size("keys").cast("long")
    total = lists.agg(F.sum(size * (HISTOGRAM + 24 + 8 * size))).first()[0] or 0
    passes = -(-total // max(BLOCK_BYTES, BLOCK_DOC_BYTES * docs))
    found = [chunked]
    for at in range(passes):
        mine = live if passes == 1 else live.where(F.pmod(F.xxhash64("key", F.lit("pass")), F.lit(passes)) == at)
        blocks = table(_blocks(mine, lists), "jac-blocks")
        new = table(_compared(blocks, threshold, form), "jac-near")
        forget(blocks)
        found.append(new)
    forget(lists, live)
    return found


def _block_pairs(live: DataFrame, sets: DataFrame, threshold: int, docs: int) -> DataFrame:
    """``(a, b)`` of ``_block_tables``."""
    return reduce(DataFrame.unionByName, _block_tables(live, sets, threshold, docs, PAIRS))


#: What a member carries in its blocks.
_CARRIED = ("doc", "n", "comp", "hist", "keys")


def _blocks(live: DataFrame, lists: DataFrame) -> DataFrame:
    """``(key, i)`` and lists of the members of block i of the key."""
    d = live.join(lists, "doc")
    blocks = F.ceil(F.col("m") / BLOCK)
    d = d.withColumn("i", F.pmod(F.xxhash64("doc", F.lit("block")), blocks))
    return d.groupBy("key", "i").agg(*(F.collect_list(c).alias(c) for c in _CARRIED))


def _members(values) -> tuple[np.ndarray, ...]:
    """doc, n, comp and histograms of a block or chunk, from its lists."""
    doc, n, comp, hist = (x.values for x in values)
    return *(x.to_numpy() for x in (doc, n, comp)), np.frombuffer(b"".join(hist.to_pylist()), np.uint8).reshape(-1, HISTOGRAM)


def _open(one: tuple, two: tuple, same: bool, threshold: int) -> np.ndarray:
    """Which pairs lie across components and have sizes that can link; of one block with itself each pair once."""
    (d1, n1, c1, _), (d2, n2, c2, _) = one, two
    a, b = n1[:, None], n2[None, :]
    near = (c1[:, None] != c2[None, :]) & (100 * b >= threshold * a) & (100 * a >= threshold * b)
    return near & (d1[:, None] < d2[None, :]) if same else near


def _bounded(one: tuple, two: tuple, near: np.ndarray, threshold: int) -> np.ndarray:
    """Those of the marked pairs that the bound lets through."""
    (_, n1, _, h1), (_, n2, _, h2) = one, two
    full1, full2 = (h1 == 255).all(1), (h2 == 255).all(1)
    out = np.zeros_like(near)
    for x in np.flatnonzero(near.any(1)):
        at = np.flatnonzero(near[x])
        most = np.minimum(h1[x], h2[at]).sum(1, dtype=np.int64)
        out[x, at] = (100 * most >= threshold * (n1[x] + n2[at] - most)) | full1[x] | full2[at]
    return out


def _cut(at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The places in pieces of about PART_TOKENS tokens."""
    piece = np.cumsum(n[at]) // PART_TOKENS
    return np.split(at, np.flatnonzero(piece[1:] != piece[:-1]) + 1) if len(at) else []


def _parts(one: tuple, two: tuple, ok: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The documents of marked pairs, as rows of a part.  A part is named by its documents: if two have one name, more is compared, not less."""
    for p in _cut(np.flatnonzero(ok.any(1)), one[1]):
        for q in _cut(np.flatnonzero(ok[p].any(0)), two[1]):
            r = p[ok[np.ix_(p, q)].any(1)]
            doc, n, comp = (np.concatenate([one[c][r], two[c][q]]).astype(np.int64) for c in range(3))
            side = np.repeat(np.arange(2), [len(r), len(q)])
            name = np.add.reduce(mix(mix(doc.view(np.uint64)) + side.astype(np.uint64)), dtype=np.uint64, keepdims=True).view(np.int64)
            yield np.repeat(name, len(doc)), side, doc, n, comp


def _pairs(one: tuple, two: tuple, ok: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The marked pairs, lesser document first."""
    x, y = np.nonzero(ok)
    yield np.minimum(one[0][x], two[0][y]), np.maximum(one[0][x], two[0][y])


def _batch(rows: list[tuple[np.ndarray, ...]], names: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64)) for i in range(len(names))], names)


#: What is told of two chunks or blocks: their pairs, or the documents of these, each on its side of a part whose pairs across the sides are to be intersected.
PAIR = "a long, b long"
PAIRS = (PAIR, _pairs)
PARTS = ("part long, side long, doc long, n long, comp long", _parts)


def _chunk_pairs(live: DataFrame, sets: DataFrame, threshold: int, tasks: int, form: tuple = PAIRS) -> tuple[DataFrame, DataFrame]:
    """The pairs that the bound lets through, of keys whose members lie in few chunks, and ``(key)`` of these keys.

    Near copies share many keys.  Key by key their pairs would come up under each;
    here every document is in one chunk, by its least key, and two chunks that have such a key in
    common are compared once, whole.
    """
    homes = table(live.groupBy("doc").agg(F.min("key").alias("home"), F.first("n").alias("n"), F.first("comp").alias("comp")), "jac-homes", tasks)
    width = homes.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("width"))
    homes = table(homes.join(width, "home").withColumn("slot", F.pmod(F.xxhash64("doc", F.lit("chunk")), F.col("width"))).drop("width"), "jac-chunked", tasks)
    touched = table(live.select("key", "m", "doc").join(homes, "doc").select("key", "m", "home", "slot").distinct(), "jac-touched", tasks)
    dense = touched.groupBy("key").agg(F.count("*").alias("chunks"), F.first("m").alias("m")).where(F.col("chunks") * CHUNK <= SPREAD * F.col("m"))
    dense = table(dense.select("key"), "jac-dense", tasks)
    touched = touched.join(dense, "key").select("key", "home", "slot")
    other = touched.select("key", F.col("home").alias("home2"), F.col("slot").alias("slot2"))
    met = table(touched.join(other, "key").where("home < home2 or (home = home2 and slot <= slot2)").drop("key").distinct(), "jac-met", tasks)
    schema, told = form
    columns = ("doc", "n", "comp", "hist")
    chunks = table(homes.join(sets.select("doc", "hist"), "doc").groupBy("home", "slot").agg(*(F.collect_list(c).alias(c) for c in columns)), "jac-chunks", tasks)
    second = chunks.select(F.col("home").alias("home2"), F.col("slot").alias("slot2"), *(F.col(c).alias(f"{c}2") for c in columns))
    rows = met.join(chunks, ["home", "slot"]).join(second, ["home2", "slot2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py()
                row = [batch.column(c)[r] for c in range(1, 1 + 2 * len(columns))]
                one, two = _members(row[: len(columns)]), _members(row[len(columns) :])
                yield _batch(list(told(one, two, _bounded(one, two, _open(one, two, same, threshold), threshold))), schema)

    same = F.expr("home = home2 and slot = slot2").alias("same")
    return rows.select(same, *columns, *(f"{c}2" for c in columns)).mapInArrow(run, schema), dense


def _compared(d: DataFrame, threshold: int, form: tuple) -> DataFrame:
    """The pairs of every two blocks of a key that the bound lets through."""
    schema, told = form
    columns = _CARRIED
    other = d.select("key", F.col("i").alias("j"), *(F.col(c).alias(f"{c}2") for c in columns))
    met = d.join(other, "key").where("i <= j")
    order = ["key", "i", "j", *(f"{c}{k}" for k in ("", "2") for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lesser(keys, key):
            owner, flat = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy()
            least = flat < key
            return owner[least], flat[least]

        def holds(owner, flat, keys, rows):
            out = np.zeros((rows, len(keys)), np.float32)
            at = np.searchsorted(keys, flat)
            at[at == len(keys)] = 0
            there = keys[at] == flat
            out[owner[there], at[there]] = 1
            return out

        half = len(columns)
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                key, i, j = (batch.column(c)[r].as_py() for c in range(3))
                row = [batch.column(c)[r] for c in range(3, len(order))]
                one, two = _members(row[: half - 1]), _members(row[half:-1])
                near = _open(one, two, i == j, threshold)
                # A pair that shares a lesser key as well is compared there.
                if near.any():
                    (o1, k1), (o2, k2) = lesser(row[half - 1].values, key), lesser(row[-1].values, key)
                    if len(both := np.intersect1d(k1, k2)):
                        near &= holds(o1, k1, both, len(near)) @ holds(o2, k2, both, near.shape[1]).T == 0
                out.extend(told(one, two, _bounded(one, two, near, threshold)))
            yield _batch(out, schema)

    return met.select(*order).mapInArrow(run, schema)


def links(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, c1, c2)`` of every row, and edges ``(a, b)`` whose components are those of the similarity graph."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = table(_survey(docs, n), "jac-survey")
    rows = survey.where("n is not null").select("doc_id", "n", "c1", "c2")
    total = rows.count()
    tasks = tasks_for(spark, total, TASK_DOCS)
    full = rows.where("n > 0 and doc_id is not null")
    classes = table(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "jac-class", tasks)
    again = classes.where("copies > 1")
    copies = full.join(again, ["c1", "c2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    heavy = survey.where("token is not null").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= max(MIN_FREQUENT, total / FREQUENT_SHARE))
    # At most MAX_FREQUENT rows of 16 bytes, whatever the input.
    top = heavy.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort((tokens, top["n"].to_numpy(np.int64)))] = np.arange(len(tokens), dtype=np.uint64)
    by_value = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast(np.stack([tokens[by_value], rank[by_value]]) if len(tokens) else np.zeros((2, 0), np.uint64))

    keys = _keys(docs, n, threshold, frequent).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keys = table(keys, "jac-keys", tasks)
    each = keys.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"), "n", "often")
    shared = table(each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "jac-shared", tasks)
    members = table(each.join(shared, "key"), "jac-members", tasks)
    forget(keys, shared)
    # A linked set shares as many keys as its smallest possible partner asks for, frequent tokens aside.
    asked = extent(F.ceil(F.col("n") * threshold / 100))
    for _ in range(PEELS):
        able = members.groupBy("doc", "n", "often").agg(F.count("*").alias("keys")).where(F.col("keys") + F.col("often") >= asked)
        able = table(able.select("doc"), "jac-able", tasks)
        left = table(members.join(able, "doc", "left_semi"), "jac-left", tasks)
        still = table(left.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "jac-still", tasks)
        forget(members, able)
        members = table(left.join(still, "key", "left_semi"), "jac-members", tasks)
        forget(left, still)
    ids = table(members.select("doc").distinct(), "jac-ids", tasks)
    comp = ids.select("doc", F.col("doc").alias("comp"))
    found: DataFrame | None = None
    tested: DataFrame | None = None
    fit = (F.col("n") * 100 >= F.col("pn") * threshold) & (F.col("pn") * 100 >= F.col("n") * threshold)
    for at in range(PIVOT_ROUNDS + 1):
        live = members.join(comp, "doc")
        open_keys = live.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.count("*").alias("comps"))
        open_keys = table(open_keys.where("comps > 1").select("key", "m"), "jac-open", tasks)
        if open_keys.isEmpty():
            break
        live = table(live.select("key", "doc", "n", "often", "comp").join(open_keys, "key"), "jac-live", tasks)
        large = None
        if at == PIVOT_ROUNDS:
            # Shared tokens may also lie in large keys, which count like frequent ones here.
            large = live.where(F.col("m") > SMALL_KEY)
            in_large = table(large.groupBy("doc").agg(F.count("*").alias("large")), "jac-large", tasks)
            few = live.where(F.col("m") <= SMALL_KEY).join(in_large, "doc", "left")
            few = few.select("key", "doc", "n", "comp", (F.col("often") + F.coalesce("large", F.lit(0))).alias("often"))
            few = table(few, "jac-few", tasks)
            other = few.select("key", F.col("doc").alias("p"), F.col("n").alias("pn"), F.col("often").alias("po"), F.col("comp").alias("pc"))
            pairs = few.join(other, "key").where("doc < p and comp <> pc").where(fit)
        else:
            order = [F.xxhash64("doc", F.lit(at), F.lit(i)) for i in range(PIVOTS)]
            pivots = live.groupBy("key").agg(*(F.min_by(c, o).alias(f"{c}{i}") for i, o in enumerate(order) for c in ("doc", "n", "often", "comp")))
            pivots = table(pivots, "jac-pivots", tasks)
            pick = F.explode(F.array(*(F.struct(F.col(f"doc{i}").alias("p"), F.col(f"n{i}").alias("pn"), F.col(f"often{i}").alias("po"), F.col(f"comp{i}").alias("pc")) for i in range(PIVOTS))))
            # Members meet the pivots of their key: at most PIVOTS rows a member.
            met = live.select("key", "doc", "n", "often", "comp").join(pivots, "key").select("key", "doc", "n", "often", "comp", pick.alias("x"))
            pairs = met.select("key", "doc", "n", "often", "comp", "x.*").where("doc <> p and comp <> pc").where(fit).distinct()
        # Pairs met under too few keys cannot link; pivots leave keys out, so that little is asked of theirs.
        enough = extent(F.least("n", "pn")) if large is not None else F.lit(2)
        pairs = pairs.groupBy(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).agg(F.count("*").alias("keys"), F.max(F.least("often", "po")).alias("more"), F.max(enough).alias("enough"))
        pairs = pairs.where("keys + more >= enough").select("a", "b")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = table(pairs, "jac-pairs", tasks)
        tested = pairs if tested is None else tested.unionByName(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        wanted = wanted if large is None else wanted.unionByName(in_large.select(F.col("doc").alias("doc_id")))
        wanted = table(wanted.distinct(), "jac-wanted", tasks)
        hists = table(_hists(semi_join_large(docs, wanted, "doc_id"), n), "jac-hists", tasks)
        new = _verified(pairs, hists, docs, n, threshold, total)
        found = new if found is None else found.unionByName(new)
        if large is not None and (new := _linked(_block_tables(large, hists, threshold, total, PARTS), docs, n, threshold, total)) is not None:
            found = found.unionByName(new)
        forget(live, open_keys, wanted, hists)
        if at < PIVOT_ROUNDS:
            cc = components(found, "jac-cc", tasks).select(F.col("node").alias("doc"), F.col("comp").alias("c"))
            comp = table(ids.join(cc, "doc", "left").select("doc", F.coalesce("c", "doc").alias("comp")), "jac-comp", tasks)
    forget(members)
    return rows, copies if found is None else copies.unionByName(found)


def similar(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    rows, edges = links(columns_of(docs, "doc_id", "text"), n, threshold)
    tasks = tasks_for(docs.sparkSession, rows.count(), TASK_DOCS)
    cc = components(edges, "jac-all", tasks).select(F.col("node").alias("doc_id"), F.col("comp").alias("component_id"))
    out = rows.join(cc, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group."""
    kept = similar(docs, n, threshold).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
