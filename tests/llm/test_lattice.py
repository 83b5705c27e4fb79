"""Lattice cells: recall on planted pairs, partners that do not grow with the table, ids and the threshold itself."""

import numpy as np
import pytest

from quillon.llm import lattice


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(rng, n, cosine):
    u = unit(rng.normal(size=(n, 64)))
    g = rng.normal(size=(n, 64))
    g = unit(g - (g * u).sum(1, keepdims=True) * u)
    cosine = np.broadcast_to(cosine, (n,))[:, None]
    return u, cosine * u + np.sqrt(1 - cosine**2) * g


def test_recall_on_planted_pairs(spark):
    """Against brute force over all pairs: nothing false, and at least 0.98 of the links from cosine 0.9 to 1."""
    rng = np.random.default_rng(8)
    u, v = planted(rng, 600, rng.uniform(0.9, 1.0, 600))
    x = np.concatenate([u, v, rng.normal(size=(2000, 64))])
    x *= rng.uniform(0.01, 100, (len(x), 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(df).collect()}
    links = unit(x) @ unit(x).T >= lattice.THRESHOLD
    np.fill_diagonal(links, False)
    want = links.sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.sum() > 1000


@pytest.mark.parametrize("n", [3_000, 50_000, 1_000_000])
def test_partners_do_not_grow(n):
    """Unrelated vectors that share a cell with one, scaled from 3,000 vectors to n; pairs at the very threshold are found."""
    setting = lattice.fitted(n, 64)
    rng = np.random.default_rng(1)
    u, v = planted(rng, 3000, 0.9)
    one, two = lattice.cells(u, setting), lattice.cells(v, setting)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two, strict=True)]) >= 0.97
    values, counts = np.unique(np.concatenate([np.unique(r) for r in one]), return_counts=True)
    partners = (counts * (counts - 1)).sum() / 3000 * n / 3000
    assert partners < 60


def test_ids(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=(3, 16)).tolist()
    rows = [(None, a), (5, a), (None, b), (None, b), (9, c), (9, c), (9, None), (None, None)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(None, 1, 5, False), (5, 1, 5, True), (None, 1, None, None), (None, 1, None, None), (9, 1, 9, True), (9, 1, 9, True), (9, 0, 9, True), (None, 0, None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_threshold_itself(spark):
    """Cosines of exactly 3/5, where doubles have no rounding error: they link at 0.6, and not at the next double."""
    rows = []
    for i in range(30):
        one, two = [0.0] * 64, [0.0] * 64
        one[2 * i], two[2 * i], two[2 * i + 1] = 1.0, 3.0, 4.0
        rows += [(2 * i, one), (2 * i + 1, two)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = lambda t: sum(r.n_links for r in lattice.near_duplicates(df, threshold=t).collect()) / 2
    assert links(0.6) >= 28 and links(float(np.nextafter(0.6, 1))) == 0
