"""Line dedup against a quadratic search for shared runs of words."""

import random

import pytest

from quillon.llm import linededup
from quillon.llm.linededup import EDGE, GRAM, WINDOW

SURE = GRAM + WINDOW - 1


def covered(texts, k):
    """Per text, the places of words in a run of k words that stands in an earlier text, or earlier in the same one (if k is SURE)."""
    seen, out = set(), []
    for words in texts:
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        hit, own = set(), set()
        for i, g in enumerate(grams):
            if g in seen or g in own and k == SURE:
                hit |= set(range(i, i + k))
            own.add(g)
        seen |= own
        out.append(hit)
    return out


def gone(before, after):
    """Places of the words that a cut text lacks; what is left keeps its order."""
    out, at = set(), 0
    for i, w in enumerate(before):
        if at < len(after) and after[at] == w:
            at += 1
        else:
            out.add(i)
    assert at == len(after)
    return out


def near(places, within):
    """Places without those that lie at most EDGE words inside of a border."""
    return {p for p in places if all(p + d in within for d in range(-EDGE, EDGE + 1))}


def corpus(seed, whole_first, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(rng.choice([10, 24, 30, 49, 60, 120, 300]))] for _ in range(12)]
    texts = [[w for p in passages for w in p]] if whole_first else []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 1, 2])):
            a = rng.choice([0, 0, rng.randrange(len(p))])
            words += p[a : rng.choice([len(p), len(p), rng.randint(a, len(p))])] + [word() for _ in range(rng.randint(1, 60))]
        texts.append(words)
    return texts, ["".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in t).rstrip() for t in texts]


@pytest.mark.parametrize(("seed", "whole_first"), [(0, True), (1, True), (2, False), (3, False)])
def test_against_quadratic_search(spark, seed, whole_first):
    """Never a word outside of a run of GRAM words met before; every run of GRAM + WINDOW - 1 words whose first text holds it whole.

    Where a part of a passage comes first alone, a few words beside that part may stay.
    """
    texts, rows = corpus(seed, whole_first)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    some, sure = covered(texts, GRAM), covered(texts, SURE)
    cut = missed = 0
    for i, words in enumerate(texts):
        left = got[i].text.split()
        out = gone(words, left)
        cut += len(out)
        assert out <= some[i], (i, sorted(out - some[i]))
        missed += len(near(sure[i], sure[i]) - out)
        assert got[i].kept == bool(left) or not words
    assert cut > 500
    assert missed <= (0 if whole_first else 0.02 * cut)


def test_ids(spark):
    """Null ids come first in the order and are told apart by their text; rows of one id and text are one document."""
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    rows = [(None, f"{passage} null one"), (None, f"null two {passage}"), (3, f"{passage} three"), (3, f"{passage} three"), (4, passage)]
    got = sorted((r.doc_id or 0, r.text, r.kept) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g for g in got if g[0] == 3] == [(3, "three", True)] * 2 and got[-1] == (4, "", False)
    assert sorted(len(t.split()) for i, t, _ in got if i == 0) == [2, 82]  # one of the two keeps the passage


def test_runs_within_a_text_ask_for_no_words(spark, monkeypatch):
    """A text that repeats only itself has the words around its runs; they are not fetched and dealt out again for each run."""
    asked = []
    contexts = linededup._contexts
    monkeypatch.setattr(linededup, "_contexts", lambda docs, runs, reach: asked.append(runs.count()) or contexts(docs, runs, reach))
    rng = random.Random(7)
    verse, other = ([f"v{rng.randrange(10**6)}" for _ in range(n)] for n in (70, 60))
    texts = [verse + ["so", "on"] + verse + ["and"] + verse[5:], other, ["x"] * 3 + other[:55] + ["y"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    cut = lambda some: {r.doc_id: r.text.split() for r in linededup.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert cut(rows[:1]) == {0: verse + ["so", "on", "and"]} and asked == [0]
    assert cut(rows) == {0: verse + ["so", "on", "and"], 1: other, 2: ["x", "x", "x", "y"]} and 0 < asked[1] < 5


def test_fingerprints_against_brute_force(spark):
    """The places chosen are those of the least marks of all windows, also for texts around the length of a gram and a window."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(30)}" for _ in range(n)] for n in (0, 1, GRAM - 1, GRAM, GRAM + 1, SURE - 1, SURE, SURE + 1, 400)]
    space = lambda: "".join(rng.choices(" \t\n\v\f\r", k=rng.randint(1, 3)))
    df = spark.createDataFrame([(i, space() + "".join(w + space() for w in t)) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, "\v")], "doc_id long, text string")
    got = {}
    for r in linededup.fingerprints(df, GRAM, WINDOW).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    seen = [r[0] for r in spark.createDataFrame([(w,) for w in sorted({w for t in texts for w in t})], "w string").selectExpr("(w, xxhash64(3, w))").collect()]
    mark = {w: h >> linededup.PLACE_BITS for w, h in seen}
    want = {}
    for i, t in enumerate(texts):
        grams = [(mark[w], k) for k, w in enumerate(t[: max(len(t) - GRAM + 1, 0)])]
        if grams:
            want[i] = sorted({min(grams[k : k + WINDOW])[1] for k in range(max(len(grams) - WINDOW + 1, 1))})
    assert {k: sorted(v) for k, v in got.items()} == want
