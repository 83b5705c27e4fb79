"""The isolation forest against plain forms of the same: path lengths, depths, thresholds; and its verdicts on rows it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality


def walked(tree, row):
    feature, value, left, length = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + int(row[feature[node]] > value[node])
    return length[node]


def test_path_lengths_by_walking():
    rng = np.random.default_rng(3)
    x, seen = rng.normal(size=(300, 4)), rng.normal(size=(80, 4)) * 3
    forest = quality.grow(x, (seen.min(0), seen.max(0)), trees=20, rows=64)
    want = [np.mean([walked(t, row) for t in forest]) for row in seen]
    assert np.allclose(quality.path_lengths(forest, seen), want)


def usual_by_recursion(n):
    """Mean depth of a leaf of a tree of n rows whose splits fall between any two neighbours alike: its recurrence, solved from below."""
    mean = [0.0, 0.0]
    for m in range(2, n + 1):
        mean.append(1 + 2 * sum(k * mean[k] for k in range(1, m)) / (m * (m - 1)))
    return mean[n]


def test_usual_depth():
    assert quality.usual_depth(0) == quality.usual_depth(1) == 0 and quality.usual_depth(2) == 1
    for n in (5, 50, 256):
        assert quality.usual_depth(n) == pytest.approx(usual_by_recursion(n), rel=0.15)


def test_trees_split_their_rows():
    """Leaf by leaf: depth, plus the usual depth of the tree rows that end there."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 3))
    for seed in range(3):
        (tree,) = quality.grow(x, (x.min(0), x.max(0)), trees=1, rows=100, seed=seed)
        feature, value, left, length = tree

        def check(node, at, depth):
            if feature[node] < 0:
                assert length[node] == pytest.approx(depth + float(quality.usual_depth(len(at))))
                return len(at)
            go = x[at, feature[node]] <= value[node]
            return check(left[node], at[go], depth + 1) + check(left[node] + 1, at[~go], depth + 1)

        assert check(0, np.arange(100), 0) == 100


def test_calibrated_by_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        good, bad = rng.normal(8, 1, 400), rng.normal(5, 2, 60)
        t = quality.calibrated(good, bad, 0.02)
        assert (good < t).mean() <= 0.02
        best = max((bad < u).mean() - (good < u).mean() for u in np.concatenate([bad + 1e-9, good]) if (good < u).sum() <= 0.02 * 400)
        assert (bad < t).mean() - (good < t).mean() >= best - 0.01
    assert quality.calibrated(np.array([]), np.array([1.0])) == quality.calibrated(np.array([1.0]), np.array([])) == -np.inf


def test_halves():
    """Trees never see the rows that the threshold is chosen on."""
    rng = np.random.default_rng(7)
    x, q, half = rng.normal(size=(200, 9)), rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    forest, _ = quality.fitted(x, q, half)
    again = quality.grow(x[(q == 1) & (half == 0)], (x.min(0), x.max(0)))
    assert all((a == b).all() for s, t in zip(forest, again, strict=True) for a, b in zip(s, t, strict=True))
    assert quality.fitted(x, np.zeros(200, int), half) == ([], -np.inf)
    assert quality.fitted(x, q, np.ones(200, int)) == ([], -np.inf)


def test_unseen_rows(spark):
    """Labels of half the documents; verdicts are counted on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    rows = {r["quality"]: r for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert rows[1].n > 500 and rows[1].kept >= 0.985
    assert rows[0].n > 40 and rows[0].kept <= 0.4, rows


def test_all_labels_count(spark, monkeypatch):
    """The threshold is that of all labelled rows, also where a bound of the former kind would leave most of them out."""
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300, raising=False)
    monkeypatch.setattr(quality, "TREES", 20)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id", "left").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).where("not base_failed").toPandas()
    length = got["path_length"].to_numpy()
    good, bad = (got["quality"] == 1) & (got["half"] == 1), got["quality"] == 0
    t = quality.calibrated(length[good], length[bad])
    assert good.sum() > 1000 and t > 0
    assert ((length >= t) == got["kept"].to_numpy(bool)).all()


def test_threshold_over_a_table(spark):
    rng = np.random.default_rng(8)
    for few in (0.02, 0.2):
        good, bad = rng.normal(8, 1, 400).round(2), rng.normal(6, 2, 90).round(2)
        scored = spark.createDataFrame([(1, float(x)) for x in good] + [(0, float(x)) for x in bad], "quality int, path_length double")
        assert quality._threshold(scored, few) == quality.calibrated(good, bad, few)
        assert quality._threshold(scored.where("quality = 1"), few) == -np.inf


def test_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "x"), (None, None, "x"), (1, "", "x")], "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs, none).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (0, True, False), (60, True, False)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == 3
    assert quality.judge(docs.limit(0), labels).collect() == []
