"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text.  A document is parsed, left to right, into the longest phrases
that occur in that sample; text of the same language needs few.  With N sample
characters and c phrases over n characters, ``c * log2(N) / n`` estimates the
cross entropy in bits a character; the language with the least wins.

Text is lower-cased, everything but letters becomes one separator between words.
A document is parsed whole, in blocks of ``BLOCK`` symbols; a phrase ends with
its block.  All blocks of a batch advance together, one symbol a step, in numpy.

Every label that has text is learned, with every letter of it.  An automaton is held
as sparse rows laid over one another in one array, about a megabyte a language; the
time of a prediction follows the number of languages.

Defined results: ``und`` with score 0 for null text, text without a letter, and
where nothing could be learned.  Ties go to the language first in order of name.
held_out is null for a null doc_id; such rows are not learned from.  Repeated rows,
extra columns and null languages do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, release, ship, sliced

UND = "und"
#: Bounds of the labelled sample the model is fitted on.
SAMPLE_DOCS = 48  # documents a language
SAMPLE_CHARS = 32_768  # characters a language, after normalisation
SAMPLE_CHARS_DOC = 4_096  # characters of one document
BLOCK = 1_024
#: Places a row is tried at before the search for the next ones moves on.
TRIES = 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def letters_only(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``; state 0 is the start."""
    follow: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


@dataclass
class Automaton:
    """State s goes on with symbol x to the low half of ``rows[base[s] + x]`` if its high half is s; else a phrase begins, at ``start[x]``."""

    base: np.ndarray
    rows: np.ndarray
    start: np.ndarray


def compact(follow: list[dict[str, int]], symbol: dict[str, int]) -> Automaton:
    """Rows of transitions, the longest first, each laid where its places are free."""
    n = max(symbol.values()) + 1
    start = np.zeros(n, np.int32)  # an unknown symbol is a phrase of its own
    for c, to in follow[0].items():
        start[symbol[c]] = to
    rows = [sorted((symbol[c], to) for c, to in out.items()) if state else [] for state, out in enumerate(follow)]
    room = sum(map(len, rows)) + 2 * n
    used = bytearray(2 * room)
    base = np.zeros(len(rows), np.int32)
    at = {}
    low = after = n  # places are n or more, so that no base is negative
    for state in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
        row = rows[state]
        if not row:
            break
        first = row[0][0]
        if len(row) == 1:
            place = low = used.index(0, low)
        else:
            place, tries = used.index(0, after), 0
            while any(used[place - first + x] for x, _ in row[1:]):
                place, tries = used.index(0, place + 1), tries + 1
            if tries > TRIES:  # leave the crowded part to rows of one transition
                after = place
        base[state] = place - first
        for x, to in row:
            where = place - first + x
            if where + n >= len(used):
                used.extend(bytes(room))
            used[where] = 1
            at[where] = (state, to)
    packed = np.full(max([n, *at, *(base + 0).tolist()]) + n + 1, -1, np.int64)
    for where, (state, to) in at.items():
        packed[where] = state << 32 | to
    return Automaton(base, packed, start)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # code point -> symbol; 0 unknown letter, 1 separator
    automata: list[Automaton]
    bits: list[float]  # log2 of the sample's size


def fit(samples: dict[str, str]) -> Model:
    langs = sorted(samples)
    counts = Counter(c for s in samples.values() for c in s if c != " ")
    symbol = {" ": 1} | {c: i for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 2)}
    codes = np.ones(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            codes[point] = symbol.get(c.lower()[0], 0)
    return Model(langs, codes, [compact(suffix_automaton(samples[x]), symbol) for x in langs], [math.log2(len(samples[x]) + 1) for x in langs])


def symbols_of(text: str, codes: np.ndarray) -> np.ndarray:
    """Symbols of a text: runs of non-letters are one separator, none at either end."""
    s = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = s == 1
    if gap.any():
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        s = s[keep]
        s = s[1:] if len(s) and s[0] == 1 else s
        s = s[:-1] if len(s) and s[-1] == 1 else s
    return s


def phrases(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Phrases of each document (rows) under each language (columns)."""
    starts = [(d, a) for d, s in enumerate(docs) for a in range(0, len(s), BLOCK)]
    out = np.zeros((len(docs), len(model.langs)), np.int64)
    if not starts:
        return out
    blocks = [docs[d][a : a + BLOCK] for d, a in starts]
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    grid = np.zeros((int(lengths[0]), len(blocks)), np.int32)
    for lane, k in enumerate(order):
        grid[: lengths[lane], lane] = blocks[k]
    alive = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # lanes with a symbol at this step
    owner = np.array([starts[k][0] for k in order])
    for lang, t in enumerate(model.automata):
        state = np.zeros(len(blocks), np.int64)
        count = np.zeros(len(blocks), np.int64)
        for step in range(len(grid)):
            k = alive[step]
            x = grid[step, :k]
            met = t.rows[t.base[state[:k]] + x]
            begun = met >> 32 != state[:k]
            count[:k] += begun
            state[:k] = np.where(begun, t.start[x], met & 0xFFFFFFFF)
        np.add.at(out[:, lang], owner, count)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    docs = [symbols_of(t, model.codes) if t else np.zeros(0, np.int32) for t in texts]
    counts = phrases(model, docs)
    langs, scores = [], []
    for d, s in enumerate(docs):
        if not len(s) or not model.langs:
            langs.append(UND)
            scores.append(0.0)
            continue
        entropy = counts[d] * np.array(model.bits) / len(s)
        best = int(entropy.argmin())
        # Likelihoods 2^-(entropy * n) of an n-symbol text, n cut so that long texts keep a scale.
        weight = np.exp2(-(entropy - entropy[best]) * min(len(s), 64))
        langs.append(model.langs[best])
        scores.append(float(1 / weight.sum()))
    return langs, scores


def training_samples(docs: DataFrame) -> dict[str, str]:
    """Bounded labelled text of each language; held-out rows are never read.

    doc_ids are counted first, so that a hash threshold keeps a few times SAMPLE_DOCS of
    any language before they are ranked; rows of one doc_id count as one.  At most
    4 * SAMPLE_DOCS pieces of SAMPLE_CHARS_DOC characters a language reach the driver.
    """
    d = columns_of(docs, "doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").isNotNull())
    counted = d.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    limit = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.col("n")) * (1 << 40)
    # One short row a label is broadcast; the model that is made for each label is a megabyte.
    picked = d.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).join(F.broadcast(counted), "lang").where(F.col("h") <= limit)
    picked = picked.groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS_DOC)).alias("text"))
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= 4 * SAMPLE_DOCS)
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(letters_only(r["text"]))
    joined = {k: " ".join(x for x in v if x)[:SAMPLE_CHARS].strip() for k, v in out.items()}
    return {k: v for k, v in joined.items() if v}


BATCH_SYMBOLS = 1_250_000


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score``; clashing columns of the input are replaced."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(training_samples(docs)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def found(part: list[str | None]) -> pa.Array:
            langs, scores = predict(model.value, part)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        part, size = [], 0
        for texts in sliced(batches):
            for t in texts.to_pylist():
                part.append(t)
                size += len(t or "")
                if size > BATCH_SYMBOLS:
                    yield found(part)
                    part, size = [], 0
        if part:
            yield found(part)
        release()

    # Called nondeterministic so that a filter on its result does not make it run twice.
    udf = F.arrow_udf(run, "struct<lang_pred:string,score:double>").asNondeterministic()
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "_p")]
    out = columns_of(docs, *kept).withColumn("_p", udf(F.col("text")))
    return out.select(*(F.col(f"`{c}`") for c in kept), held_out(F.col("doc_id")).alias("held_out"), F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "lang", "text")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
