"""Quality rules: counts over whole texts, a base rule, and an isolation forest over rule statistics.

Every tree of the forest splits its own draw of TREE_ROWS rows, out of all labelled
good ones, at random features and values, as the method has it; a document
that few splits set apart from the labelled good ones is anomalous.  It is
rejected if its mean path length over the trees is below a threshold, chosen on
labelled rows as the one that rejects most bad ones among those that reject at
most MAX_GOOD_LOST of the good.

Fitted on labelled rows only, and on all of them: their whole range bounds the cuts, the
trees draw from one half of the good rows; the threshold is chosen on all of the other half
and all bad ones, which no tree has seen.  The driver gets about 1.5 TREE_ROWS rows a tree and MAX_GOOD_LOST of the path lengths.  Without good labelled rows in both halves
nothing is anomalous; without bad ones neither, for no threshold can be told.

Defined results: null text has no words; a text of under MIN_WORDS words, or with
more than half of its words in repeated three-word windows, fails the base rule
and is not kept.  Null or repeated doc_ids and extra columns do no harm; of
several labels of a document the least counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BYTES, columns_of, ship, table
from quillon.llm.jaccard import mix

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

TREES = 200
TREE_ROWS = 256
SEED = 20240731
MAX_GOOD_LOST = 0.003

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")


def rule_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and EXTRA of a text."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    counted = lambda marks: len(raw) - len(raw.translate(None, marks))
    n = len(words)
    lines = text.split("\n")
    dup = 0
    full = len(lines)
    if full > 1:
        lines = [x for x in lines if _HAS_WORD.search(x)]
        full = len(lines)
        dup = full - len(set(lines))
    repeated = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        seen: set = set()
        again = {g for g in grams if g in seen or seen.add(g)} if len(set(grams)) < len(grams) else ()
        if again:
            upto = 0
            for i, g in enumerate(grams):
                if g in again:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(text) - counted(WORD_BYTES), counted(SYMBOLS), dup, repeated, full, counted(UPPER), counted(DIGITS), counted(MARKS), len(set(words))


def features(counts: pd.DataFrame) -> np.ndarray:
    """Rule statistics: shares and means of the counts."""
    c = {k: counts[k].to_numpy(np.float64) for k in (*COUNTS, *EXTRA)}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [np.log(words), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, np.log(c["n_distinct"] + 1) / np.log(words + 1)],
        axis=1,
    )


def usual_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(safe - 1 + (safe == 2) * 1e-12) + 0.5772156649015329) - 2 * (safe - 1) / safe) * (n > 2) + (n == 2)


def _tree(part: np.ndarray, box: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """The arrays feature (-1 at leaves), value, left child, path length at leaves of a tree over all rows of ``part``.

    A node's random cut falls anywhere in its part of ``box``, the range of all
    labelled rows, not only where its own rows lie: what lies apart from all rows
    of the tree ends in an empty leaf after few cuts.
    """
    limit = 2 * int(np.ceil(np.log2(max(len(part), 2)))) + 4
    feature, value, left, length = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(part)), 0, *box)]
    while todo:
        node, at, depth, low, high = todo.pop()
        wide = np.flatnonzero(high > low)
        if len(at) < 2 or depth >= limit or not len(wide):
            length[node] = depth + float(usual_depth(len(at)))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        go = part[at, f] <= cut
        feature[node], value[node], left[node] = f, cut, len(feature)
        below, above = high.copy(), low.copy()
        below[f] = above[f] = cut
        for side in ((at[go], depth + 1, low, below), (at[~go], depth + 1, above, high)):
            todo.append((len(feature), *side))
            feature.append(-1)
            value.append(0.0)
            left.append(0)
            length.append(0.0)
    return np.array(feature), np.array(value), np.array(left), np.array(length)


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """A forest over rows ``x``, every tree over a draw of ``rows`` of them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [_tree(x[rng.choice(len(x), min(rows, len(x)), replace=False)], box, rng) for _ in range(trees)]


def path_lengths(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Mean path length of every row over the trees."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, value, left, length in forest:
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > value[node]
            node = np.where(inner, left[node] + right, node)
        total += length[node]
    return total / max(len(forest), 1)


def calibrated(good: np.ndarray, bad: np.ndarray, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The path length below which a row is rejected."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    allowed = good[min(int(max_good_lost * len(good)), len(good) - 1)]
    # Any threshold up to ``allowed`` loses few good rows; take the one with the best balance.
    options = np.unique(np.concatenate([bad[bad < allowed] + 1e-9, [allowed]]))
    gain = np.searchsorted(bad, options) / len(bad) - np.searchsorted(good, options) / len(good)
    return float(options[int(gain.argmax())]) if gain.max() > 0 else -np.inf


def fitted(x: np.ndarray, quality: np.ndarray, half: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], float]:
    """The forest and its threshold from labelled rows in memory, ``half`` 0 to grow on and 1 to calibrate with."""
    good = quality == 1
    if not (good & (half == 0)).any():
        return [], -np.inf
    forest = grow(x[good & (half == 0)], (x.min(0), x.max(0)))
    return forest, calibrated(path_lengths(forest, x[good & (half == 1)]), path_lengths(forest, x[~good]))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` with COUNTS and EXTRA of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([rule_counts(t if isinstance(t, str) else None) for t in texts], columns=[*COUNTS, *EXTRA], dtype=np.int64)

    udf = F.pandas_udf(run, ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA)))
    return columns_of(docs, "doc_id", "text").select("doc_id", udf(F.col("text")).alias("c")).select("doc_id", "c.*")


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: Columns of a row's features between Spark and the workers.
_X = tuple(f"x{i}" for i in range(9))


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The range of every feature over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for counts in batches:
            if len(counts):
                x = features(counts)
                yield pd.DataFrame(np.stack([x.min(0), x.max(0)]), columns=[*_X])

    ends = rows.select(*COUNTS, *EXTRA).mapInPandas(run, ", ".join(f"{c} double" for c in _X))
    found = ends.agg(*(F.min(c) for c in _X), *(F.max(c) for c in _X)).first()
    return np.array(found[: len(_X)], np.float64), np.array(found[len(_X) :], np.float64)


def _forest(rows: DataFrame, n: int, box: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """TREES trees, each over the TREE_ROWS of the ``n`` rows with the least of its own hash."""
    # A third more rows a tree than it takes come to the driver, so that none has too few.
    share = min(1.0, (TREE_ROWS + 8 * TREE_ROWS**0.5) / n)
    turns = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for counts in batches:
            x, draw = features(counts), counts["draw"].to_numpy(np.int64).view(np.uint64)
            order = (mix(draw[:, None] ^ turns[None, :]) >> np.uint64(11)).astype(np.int64)
            row, tree = np.nonzero(order < share * (1 << 53))
            yield pd.DataFrame(x[row], columns=[*_X]).assign(tree=tree, turn=order[row, tree])

    drawn = rows.select(*COUNTS, *EXTRA, F.xxhash64("doc_id", *COUNTS, *EXTRA, F.lit(SEED)).alias("draw"))
    drawn = drawn.mapInPandas(run, ", ".join(f"{c} double" for c in _X) + ", tree long, turn long").toPandas().sort_values(["tree", "turn", *_X])
    x, tree = drawn[[*_X]].to_numpy(np.float64), drawn["tree"].to_numpy(np.int64)
    rng = np.random.Generator(np.random.PCG64(SEED))
    return [_tree(x[slice(*np.searchsorted(tree, [t, t + 1]))][:TREE_ROWS], box, rng) for t in range(TREES)]


def _threshold(scored: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """``calibrated`` over all rows ``(quality, path_length)``, of which the driver sees the least good ones only."""
    n = {r["quality"]: r["n"] for r in scored.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return -np.inf
    at = min(int(max_good_lost * n[1]), n[1] - 1)
    low = scored.where("quality = 1").select("path_length").orderBy("path_length").limit(at + 1).toPandas()["path_length"].to_numpy(np.float64)
    allowed = low[-1]

    # Between two good rows the threshold above the last bad one is best.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bad in batches:
            over = bad["path_length"].to_numpy(np.float64) + 1e-9
            yield pd.DataFrame({"good": np.searchsorted(low, over), "over": over})

    bad = scored.where((F.col("quality") == 0) & (F.col("path_length") < float(allowed))).select("path_length")
    steps = bad.mapInPandas(run, "good long, over double").groupBy("good").agg(F.count("*").alias("n"), F.max("over").alias("over")).toPandas().sort_values("good")
    below = steps["n"].to_numpy(np.int64).cumsum()
    options = np.concatenate([steps["over"].to_numpy(np.float64), [allowed]])
    rejected = np.concatenate([below, [below[-1] if len(below) else 0]])
    lost = np.concatenate([steps["good"].to_numpy(np.int64), [np.searchsorted(low, allowed)]])
    gain = rejected / n[0] - lost / n[1]
    return float(options[int(gain.argmax())]) if gain.max() > 0 else -np.inf


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed``, ``kept``, ``path_length`` of every row of ``docs(doc_id, text)``.

    labels: ``(doc_id, quality)``, quality 1 good and 0 bad.
    """
    spark = docs.sparkSession
    stats = table(measure(docs), "rules")
    marked = columns_of(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(stats.where(~_base_failed()).join(marked, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "rules-labelled")
    grown = rows.where("quality = 1 and half = 0")
    n = grown.count()
    forest = _forest(grown, n, _box(rows)) if n else []
    model = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for counts in batches:
            yield pd.Series(path_lengths(model.value, features(counts)))

    udf = F.pandas_udf(run, "double")
    length = udf(F.struct(*COUNTS, *EXTRA))
    scored = table(rows.where("quality = 0 or half = 1").select("quality", length.alias("path_length")), "rules-scored")
    threshold = _threshold(scored) if n else -np.inf
    out = stats.withColumn("path_length", length).withColumn("base_failed", _base_failed())
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("path_length") >= F.lit(threshold))).alias("kept"), "path_length")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
