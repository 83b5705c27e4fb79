"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected at random to BLOCKS blocks of eight dimensions in each
of TABLES tables, and every block is decoded to its nearest point of the E8
lattice.  A vector's cells of a table are that code and the codes with one block
moved to its second nearest point.  Vectors that share any cell of any table are
compared; those with cosine >= THRESHOLD in double precision link.

The number of tables, blocks and the scale are fitted to the number of vectors and
their length: pairs of unit vectors at the threshold, and unrelated ones, are simulated,
and of the settings that find a pair at the threshold with a chance of 1 - MISS the one
with the least sum of cells and unrelated partners a vector is taken.  So partners do
not grow with the number of vectors; cells do, by about its power 0.15.

Equal directions are collapsed first and counted with their number.  Inside a
cell, comparison is one matrix product per block pair: a cell of more than
CELL_BLOCK vectors is cut into hashed blocks, whose pairs go to different tasks.
A pair that shares several cells is counted in the one with the least key only, so
counts per vector and a spanning forest per block pair are all that leaves a
task, never the pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing and is its own component.  Vectors of different
length never link.  Rows are vectors of their own, also where vec_id repeats; of a
null vec_id component_id and kept are null unless it links with a vector that has one;
kept is then false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, components, ship, table

THRESHOLD = 0.9
#: Chance by which a pair exactly at the threshold may be missed, in simulation.
MISS = 0.01
#: What the fit chooses among: blocks a table, and the scale of a 64-dimensional unit vector in lattice units.
MAX_BLOCKS = 8
SCALES = (2.4, 2.8, 3.2, 3.6, 4.0, 4.4, 4.8)
SIMULATED = 8_192
#: Vector lengths that get a setting of their own; further ones, the rarest, take that of the most frequent.
MAX_LENGTHS = 256
SEED = 20240611
CELL_BLOCK = 384

_projections: dict[tuple, np.ndarray] = {}


class Setting(NamedTuple):
    tables: int
    blocks: int
    scale: float


def projection(dim: int, setting: Setting) -> np.ndarray:
    """``dim x (tables * blocks * 8)``; each table's columns are orthogonal where the dimension allows."""
    key, (tables, blocks, scale) = (dim, setting), setting
    if key not in _projections:
        parts = []
        for t in range(tables):
            g = np.random.Generator(np.random.PCG64([SEED, dim, t])).normal(size=(dim, 8 * blocks))
            parts.append(np.linalg.qr(g)[0] if dim >= 8 * blocks else g / np.linalg.norm(g, axis=0))
        _projections[key] = np.concatenate(parts, axis=1) * (scale * np.sqrt(dim / 64))
    return _projections[key]


def e8_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and a second near E8 point of each row, doubled so as to be integers.

    E8 is D8 (integers of even sum) and D8 + 1/2.  In either coset rounding is
    nearest, but for the parity, which the worst rounded coordinate mends at least
    cost; the runner-up moves the next worst.
    """
    i = np.arange(len(y))
    points, distances = [], []
    for shift in (0.0, 0.5):
        z = y - shift
        r = np.rint(z)
        e = z - r
        worst = np.argsort(-np.abs(e), axis=1)
        odd = r.sum(1).astype(np.int64) & 1 == 1
        turn = np.where(e >= 0, 1.0, -1.0)
        first, second = worst[:, 0], worst[:, 1]
        near, next_ = r.copy(), r.copy()
        near[i[odd], first[odd]] += turn[i[odd], first[odd]]
        next_[i, second] += turn[i, second]
        even = ~odd
        next_[i[even], first[even]] += turn[i[even], first[even]]
        for p in (near, next_):
            points.append(p + shift)
            distances.append(((p - z) ** 2).sum(1))
    order = np.argsort(np.array(distances), axis=0, kind="stable")
    doubled = np.rint(np.array(points) * 2).astype(np.int64)
    return doubled[order[0], i], doubled[order[1], i]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _point_hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), salt, np.uint64)
    for c in range(8):
        h = _scramble(h * np.uint64(0x9E3779B97F4A7C15) + points[:, c].astype(np.uint64) + np.uint64(c + 1))
    return h


def cells(x: np.ndarray, setting: Setting) -> np.ndarray:
    """Cell keys of unit vectors ``x``: ``tables * (1 + blocks)`` a row."""
    tables, blocks, _ = setting
    z = x @ projection(x.shape[1], setting)
    out = []
    for t in range(tables):
        home, probe = [], []
        for b in range(blocks):
            at = 8 * (t * blocks + b)
            near, second = e8_points(z[:, at : at + 8])
            salt = (t * blocks + b + 1) * 1000003 + x.shape[1]
            home.append(_point_hash(near, salt))
            probe.append(_point_hash(second, salt))
        code = np.zeros(len(x), np.uint64)
        for h in home:
            code = code + h
        out.append(_scramble(code))
        out += [_scramble(code - home[b] + probe[b]) for b in range(blocks)]
    return np.stack(out, axis=1).view(np.int64)


@cache
def _agreement(dim: int, threshold: float, scale: float) -> tuple[tuple[float, float, float], ...]:
    """For a pair at the threshold and an unrelated one: the chances that in a block near = near, near = second, second = second."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    u, v, g = (unit(rng.normal(size=(SIMULATED, dim))) for _ in range(3))
    g = unit(g - (g * u).sum(1, keepdims=True) * u)
    p = rng.normal(size=(dim, 16))
    p = (np.linalg.qr(p)[0] if dim >= 16 else p / np.linalg.norm(p, axis=0)) * (scale * np.sqrt(dim / 64))
    out = []
    for other in (threshold * u + np.sqrt(max(0.0, 1 - threshold**2)) * g, v):
        shares = []
        for at in (0, 8):
            (n1, s1), (n2, s2) = (e8_points((x @ p)[:, at : at + 8]) for x in (u, other))
            same = lambda x, y: float((x == y).all(1).mean())
            shares.append((same(n1, n2), (same(n1, s2) + same(s1, n2)) / 2, same(s1, s2)))
        out.append(tuple(np.mean(shares, axis=0).tolist()))
    return tuple(out)


def fitted(n: int, dim: int, threshold: float = THRESHOLD) -> Setting:
    """The setting for ``n`` vectors of one length."""
    best, least = None, math.inf
    for scale in SCALES:
        (a, b, _), (far_a, far_b, far_c) = _agreement(dim, threshold, scale)
        far_a = max(far_a, 1 / SIMULATED)
        for blocks in range(1, MAX_BLOCKS + 1):
            # Home meets home, home meets a moved block, two cells moved in different blocks; unrelated ones also by the same moved block.
            chance = a**blocks + 2 * blocks * a ** (blocks - 1) * b + blocks * (blocks - 1) * a ** max(blocks - 2, 0) * b * b
            unrelated = far_a**blocks + 2 * blocks * far_a ** (blocks - 1) * far_b + blocks * far_a ** (blocks - 1) * far_c + blocks * (blocks - 1) * far_a ** max(blocks - 2, 0) * far_b**2
            tables = max(2, math.ceil(math.log(MISS) / math.log(max(1 - chance, 1e-9))))
            if (cost := tables * (1 + blocks) + tables * unrelated * n) < least:
                best, least = Setting(tables, blocks, scale), cost
    return best


def unit_rows(vectors: list) -> tuple[np.ndarray, list]:
    """Which vectors can link, and their unit form in double precision."""
    ok, units = np.zeros(len(vectors), bool), [None] * len(vectors)
    for k, v in enumerate(vectors):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        a = np.asarray(v, np.float64)
        if not np.isfinite(a).all():
            continue
        top = np.abs(a).max()
        if top > 0:
            a = a / top  # neither square overflows nor underflows
            units[k], ok[k] = a / np.linalg.norm(a), True
    return ok, units


def _units(rows: DataFrame) -> DataFrame:
    """``vec_id, unit``: the unit vector's bytes, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, units = unit_rows(batch.column(1).to_pylist())
            raw = pa.array([None if u is None else (u + 0.0).tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["vec_id", "unit"])

    return rows.mapInArrow(run, "vec_id long, unit binary")


def _cell_rows(classes: DataFrame, settings: dict[int, Setting]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys: list = [None] * len(raw)
            for size in {len(r) for r in raw}:
                at = [k for k, r in enumerate(raw) if len(r) == size]
                found = cells(np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), -1), settings.get(size // 8, settings[0]))
                for k, f in zip(at, found, strict=True):
                    keys[k] = np.unique(f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["cid", "keys"])

    return classes.select("cid", "unit").mapInArrow(run, "cid long, keys array<long>")


#: Members up to which a cell's pairs are listed and compared together with those of other cells.
SMALL_CELL = 16
#: Rows gathered before they are compared, and listed pairs whose vectors are multiplied at once.
GATHERED = 16_384
PAIRS = 32_768

_LAST = np.iinfo(np.int64).max


def _forest(ids1: np.ndarray, ids2: np.ndarray, linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a block of links, the least id that they are linked with by steps inside the block."""
    label1, label2 = ids1.copy(), ids2.copy()
    while True:
        new1 = np.minimum(label1, np.where(linked, label2[None, :], _LAST).min(1))
        new2 = new1 if same else np.minimum(label2, np.where(linked, new1[:, None], _LAST).min(0))
        done = (new1 == label1).all() and (new2 == label2).all()
        label1, label2 = new1, new2
        if done:
            return label1, label2


class _Rows:
    """Gathered rows of whole groups, as columns, vectors by length."""

    def __init__(self, columns: dict[str, list], settings: dict[int, Setting]) -> None:
        self.settings = settings
        self.key, self.i, self.j, self.side, self.cid, self.n = (np.array(columns[c], np.int64) for c in ("key", "i", "j", "side", "cid", "n"))
        length = np.array([len(u) // 8 for u in columns["unit"]])
        self.length, self.at, self.units = length, np.zeros(len(length), np.int64), {}
        for dim in np.unique(length).tolist():
            rows = np.flatnonzero(length == dim)
            self.at[rows] = np.arange(len(rows))
            self.units[dim] = np.frombuffer(b"".join(columns["unit"][r] for r in rows), np.float64).reshape(len(rows), dim)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.units[int(self.length[rows[0]])][self.at[rows]]

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Cell keys of rows of one length, as (rows, tables, 1 + blocks); made once for each vector and at once for all asked."""
        ids, first, back = np.unique(self.cid[rows], return_index=True, return_inverse=True)
        dim = int(self.length[rows[0]])
        setting = self.settings.get(dim, self.settings[0])
        return cells(self.unit(rows[first]), setting).reshape(len(ids), setting.tables, -1)[back]

    def listed(self, threshold: float, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Links inside small groups, each in the least of its cells: ``(cid, links, root)``, two rows a link."""
        rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
        until = np.repeat(ends, ends - starts)
        x, y = [], []
        for gap in range(1, SMALL_CELL):
            one = rows[rows + gap < until]
            one = one[self.length[one] == self.length[one + gap]]
            x.append(one)
            y.append(one + gap)
        x, y = np.concatenate(x), np.concatenate(y)
        for dim in np.unique(self.length[x]).tolist():
            of = np.flatnonzero(self.length[x] == dim)
            for a in range(0, len(of), PAIRS):
                p, q = x[of[a : a + PAIRS]], y[of[a : a + PAIRS]]
                hit = np.einsum("ij,ij->i", self.unit(p), self.unit(q)) >= threshold
                p, q = p[hit], q[hit]
                if not len(p):
                    continue
                known = self.keys(np.concatenate([p, q]))
                for b in range(0, len(p), 1_024):
                    k1, k2 = known[b : b + 1_024][: len(p) - b], known[len(p) + b : len(p) + b + 1_024]
                    least = np.where(k1[:, :, :, None] == k2[:, :, None, :], k1[:, :, :, None], _LAST).reshape(len(k2), -1).min(1)
                    here = least == self.key[p[b : b + 1_024]]
                    c, d = p[b : b + 1_024][here], q[b : b + 1_024][here]
                    low = np.minimum(self.cid[c], self.cid[d])
                    yield np.concatenate([self.cid[c], self.cid[d]]), np.concatenate([self.n[d], self.n[c]]), np.concatenate([low, low])

    def block(self, threshold: float, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Links between two blocks of a cell, or inside one, as ``(cid, links, root)``."""
        same = left is right
        if not len(left) or not len(right) or self.length[left[0]] != self.length[right[0]]:
            return
        key = self.key[left[0]]
        linked = self.unit(left) @ self.unit(right).T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        # Pairs that also share a cell with a lesser key are counted there.
        one, two = (self._earlier(rows, linked.any(axis), key) for rows, axis in ((left, 1), (right, 0)))
        for e, at in one.items():
            if e in two:
                linked[np.ix_(at, two[e])] = False
        if not linked.any():
            return
        root1, root2 = _forest(self.cid[left], self.cid[right], linked, same)
        yield self.cid[left], (linked * self.n[right][None, :]).sum(1), root1
        if not same:
            yield self.cid[right], (linked * self.n[left][:, None]).sum(0), root2

    def _earlier(self, rows: np.ndarray, some: np.ndarray, key: int) -> dict[int, np.ndarray]:
        """Places, among ``some`` of the rows, that have each key less than ``key``."""
        at = np.flatnonzero(some)
        keys = self.keys(rows[at]).reshape(len(at), -1)
        which, column = np.nonzero(keys < key)
        values = keys[which, column]
        order = np.lexsort((which, values))
        values, which = values[order], at[which[order]]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        return {int(v): np.unique(w) for v, w in zip(values[np.concatenate([[0], cuts])] if len(values) else (), np.split(which, cuts), strict=False)}


def _within(rows: DataFrame, threshold: float, settings: dict[int, Setting]) -> DataFrame:
    """Rows ``(cid, links, root)`` from rows sorted by ``key, i, j, side``: links counted here, and a node linked here."""
    names = ("key", "i", "j", "side", "cid", "n", "unit")

    def compared(columns: dict[str, list]) -> pa.RecordBatch:
        r = _Rows(columns, settings)
        cut = np.flatnonzero((np.diff(r.key) != 0) | (np.diff(r.i) != 0) | (np.diff(r.j) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(r.key)]])
        small = (r.i[starts] == r.j[starts]) & (ends - starts <= SMALL_CELL)
        found = []
        if small.any():
            found.extend(r.listed(threshold, starts[small], ends[small]))
        for a, b in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            group = np.arange(a, b)
            for dim in np.unique(r.length[a:b]):
                of = group[r.length[a:b] == dim]
                if r.i[a] == r.j[a]:
                    found.extend(r.block(threshold, of, of))
                else:
                    found.extend(r.block(threshold, of[r.side[of] == 0], of[r.side[of] == 1]))
        ids, links, roots = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (ids, links, roots)], ["cid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c].extend(batch.column(c).to_pylist())
            if len(held["key"]) >= GATHERED:
                # The last group may go on: it is kept back.
                last = len(held["key"]) - 1
                while last > 0 and all(held[c][last - 1] == held[c][-1] for c in ("key", "i", "j")):
                    last -= 1
                if last:
                    yield compared({c: held[c][:last] for c in names})
                    held = {c: held[c][last:] for c in names}
        if held["key"]:
            yield compared(held)

    return rows.select(*names).mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, setting: Setting | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    setting: in place of the fitted one.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = columns_of(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = table(_units(rows), "e8-units")
    classes = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    # Class numbers are arbitrary; the table fixes them.
    classes = table(classes.withColumn("cid", F.monotonically_increasing_id()), "e8-classes")
    lengths = classes.groupBy((F.octet_length("unit") / 8).cast("int").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MAX_LENGTHS).collect()
    settings = {r["dim"]: setting or fitted(r["count"], r["dim"], threshold) for r in lengths}
    settings[0] = next(iter(settings.values()), setting or fitted(0, 64, threshold))
    keyed = table(_cell_rows(classes, settings), "e8-keys")
    each = keyed.select(F.explode("keys").alias("key"), "cid")
    sizes = table(each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "e8-cells")
    members = each.join(sizes, "key").join(classes.select("cid", "n", "unit"), "cid")
    nb = F.ceil(F.col("m") / CELL_BLOCK)
    members = members.withColumn("b", F.pmod(F.xxhash64("cid", F.lit("block")), nb))
    # A block meets every block of its cell once; one block alone meets itself.
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), nb - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), (F.col("b") > o).cast("int").alias("side"))))
    placed = members.select("key", "cid", "n", "unit", pair.alias("p")).select("key", "p.i", "p.j", "p.side", "cid", "n", "unit")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    found = table(_within(placed, threshold, settings), "e8-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "e8-cc").select(F.col("node").alias("cid"), "comp")
    own = classes.join(links, "cid", "left").join(comp, "cid", "left").select("unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("comp", "cid").alias("comp"))
    own = table(own, "e8-own")
    least = own.groupBy("comp").agg(F.min("low").alias("component_id"))
    own = table(own.join(least, "comp").select("unit", "n_links", "component_id"), "e8-own")
    out = rows.join(own, "unit", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.when(component.isNotNull(), F.col("vec_id").eqNullSafe(component)).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
