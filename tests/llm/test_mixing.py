"""Source mixing: draws, positions and taken words against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        text = rng.choice([" ", ""]) + " ".join(f"w{rng.randrange(50)}" + rng.choice(["", "\n", "  x"]) for _ in range(rng.choice([0, 1, 5, 70, 200, 900])))
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([text, text, None, "same words here"]), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def near(got, seed):
    taken, target = Counter(), {}
    for r in got:
        taken[r.target] += r.taken
        target[r.target] = r.target
        assert 0 <= r.taken <= 2 * r.size, (r, seed)
    return all(abs(taken[t] - t) <= mixing.DRIFT * t + mixing.BLOCK + 1 for t in target)


def test_taken_by_brute_force(spark, docs):
    """Every word of every stream is marked by the slots; documents are read off their places."""
    classes = mixing.counted(docs)
    places = mixing.placed(classes).collect()
    plan = mixing.targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    slots = mixing.drawn(plan).collect()
    stream = defaultdict(int)
    for p in places:
        stream[p.source] += p.size
    covered = {s: [0] * n for s, n in stream.items()}
    for p in places:
        for w in range(p.first, p.first + p.size):
            covered[p.source][w] += 1
    assert all(set(c) == {1} for c in covered.values())  # documents fill their stream without gap or overlap
    marks = {s: [0] * n for s, n in stream.items()}
    for s in slots:
        for w in range(s.block * mixing.BLOCK, min(s.block * mixing.BLOCK + s.words, stream[s.source])):
            marks[s.source][w] += 1
    want = Counter((p.doc_id, p.size, sum(marks[p.source][p.first : p.first + p.size])) for p in places)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got if r.size) == want
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if not r.size)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    # A source's slots are numbered without gap; a pass takes no block twice.
    for source in stream:
        mine = [s for s in slots if s.source == source]
        assert sorted(s.k for s in mine) == list(range(len(mine)))
        assert len({(s.epoch, s.block) for s in mine}) == len(mine)


def test_draws_fill_every_shard(spark):
    p = mixing.planned(spark.createDataFrame([("a", 100_000, 150_000.0), ("b", 30_000, 20_000.0), (None, 64, 128.0)], "source string, source_size long, target double"))
    total = p.agg(F.sum("slots")).first()[0]
    rows = mixing.draws(p, total, 8, 1).collect()
    per = Counter()
    for r in rows:
        per[r.shard] += r.n
    assert per == {s: len(range(s, total, 8)) for s in range(8)}
    share = sum(r.n for r in rows if r.source == "a") / total
    assert abs(share - 150_000 / 170_128) < 0.02


def test_draws_decide(spark, monkeypatch):
    """Other draws give another mix; each mix meets the targets, also if all draws fall on one source."""
    rows = [(i, "w " * 997, "abc"[i % 3]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    by_id = lambda rows: {r.doc_id: r.taken for r in rows}
    mixes = [mixing.mix(docs, seed=s).collect() for s in (1, 1, 2, 3, 4, 5)]
    one = mixes[0]
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixes[1]))
    assert len({tuple(sorted(by_id(m).items())) for m in mixes}) > 2
    assert all(near(m, s) for s, m in enumerate(mixes))
    monkeypatch.setattr(mixing, "unit", lambda *parts: F.lit(0.001) + F.xxhash64(*parts) * F.lit(0.0))
    forced = mixing.mix(docs).collect()
    assert by_id(forced) != by_id(one) and near(forced, "forced")


def test_hot_copies(spark):
    """Equal rows, null ids: one class of many runs."""
    n = 3 * mixing.RUN + 5
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs.unionByName(docs.limit(0))).collect()
    assert len(got) == n and {r.size for r in got} == {3}
    assert abs(sum(r.taken for r in got) - 1.5 * 3 * n) <= mixing.DRIFT * 4.5 * n + mixing.BLOCK
    assert max(r.taken for r in got) <= 6


def test_blocks_leave_the_mix(spark, docs):
    blocks = mixing.mixed_blocks(docs).collect()
    got = mixing.mix(docs).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in got)
    assert all(len(WORD.findall(b.text)) == b.n_words <= mixing.BLOCK for b in blocks)
    assert len({(b.source, b.k) for b in blocks}) == len(blocks)
    words = lambda rows, column: Counter(w for r in rows for w in WORD.findall(r[column] or ""))
    assert words(blocks, "text") == words(mixing.mixed_documents(docs).collect(), "text")
    assert mixing.mixed_blocks(docs.limit(0)).collect() == []
