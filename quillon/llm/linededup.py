"""Removal of repeated runs of words, by winnowing, in DataFrame operations alone.

A text is its sequence of words; where lines break does not matter to the search.
A gram is GRAM words in a row.  Of any WINDOW grams in a row the one whose first word
has the least hash, the first of equal ones, is a fingerprint.  So two places that share GRAM + WINDOW - 1 words in a row
share a fingerprint in them, and none is shared by fewer than GRAM words.

Every fingerprint is held against its first occurrence, by doc_id and then position.
Fingerprints at one distance to the same first text, with no gap between their grams,
are one run, which is then extended word by word both ways, as far as REACH words,
within which the next fingerprint takes over.  The words of the later occurrence are
deleted.  The first stays.  What repeats within one text alone is deleted from
GRAM + WINDOW - 1 words on, so that refrains and overlaps of short lines stay.

Lines: a line that loses all its words goes, blank lines inside a run too; a line that
loses some keeps the rest.  Where a run reaches fewer than EDGE words over a line's
end or start, these stay: as many words are alike by chance.

Hot runs: the aggregates combine map-side; the joins with first occurrences are one to
many on plain exchanges, which adaptive execution splits.  No pairs of later
occurrences are made, and a first text is asked for at most two contexts a word.

What stays: runs of under GRAM words, a parameter; those of GRAM to GRAM + WINDOW - 2
words if no fingerprint falls into them; and, where a part of a run stands alone in an
earlier text, up to GRAM + WINDOW words beside that part.  README has the shares.

Defined results: a null doc_id comes first in the order.  Null text stays null, text without a word stays as it is.  A
document that loses all its words has the empty text and ``kept`` false.  Rows
with the same doc_id and text are one document: they get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import PREFILTER_BUCKETS, columns_of, let, table

GRAM = 25
WINDOW = 25
REACH = GRAM + WINDOW
EDGE = 3
#: Words beside a run that are looked at before all within reach are.
NEAR = 12
#: Written one by one, for which Java looks in a table of bits.
SPACE = r"\x20\t\n\x0B\f\r"


def words(text: Column) -> Column:
    """The words in order; space at the ends splits off empty pieces, which are none."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(F.lit(1), w))


def _least(values: Column, width: int) -> Column:
    """At each place the least of the ``width`` values up to it, and ``width - 1`` places more: the list is laid over itself, shifted.

    Nulls in front shift a list at a fraction of what a slice of it takes in an interpreted expression.
    """

    def further(x: Column, held: int) -> Column:  # each element of x is the least of so many
        if held == width:
            return x
        step = min(held, width - held)
        late = F.concat(F.array(*[F.lit(None).cast("bigint")] * step), x)
        return let(F.zip_with(late, x, lambda a, b: F.least(a, b)), lambda y: further(y, held + step))

    return let(values, lambda x: further(x, 1))


#: Low bits of a word's hash that give way to its place, so that the least of a window tells where it is: as many as words fit in a string.
PLACE_BITS = 30


def fingerprints(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """``(doc_id, th, pos, g1, g2)``: selected grams; th tells texts of one doc_id apart, pos counts words from 0."""
    mask = (1 << PLACE_BITS) - 1

    def of(w: Column) -> Column:
        marked = F.transform(w, lambda x, i: F.xxhash64(F.lit(3), x).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))
        return F.when(F.size(w) >= gram, chosen(w, _least(marked, window)))

    def chosen(w: Column, least: Column) -> Column:  # of windows of words that begin a whole gram, or of all of these if they are fewer
        grams = F.size(w) - (gram - 1)
        of_windows = F.slice(least, F.least(grams, F.lit(window)), F.greatest(grams - (window - 1), F.lit(1)))
        return F.transform(F.array_distinct(of_windows), lambda v: pick(w, v.bitwiseAND(F.lit(mask)).cast("int")))

    def pick(w: Column, pos: Column) -> Column:
        return let(F.slice(w, pos + 1, gram), lambda x: F.struct(pos.alias("pos"), F.xxhash64(F.lit(3), x).alias("g1"), F.xxhash64(F.lit(4), x).alias("g2")))

    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), let(words(F.col("text")), of).alias("f"))
    # Not explode: the filter inferred from it would compute the list again.
    return d.select("doc_id", "th", F.explode_outer("f").alias("f")).where("f is not null").select("doc_id", "th", "f.*")


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(doc_id, th, runs)``: word ranges ``(a, b)``, ends included, with the first occurrence's words before and after.

    ``a0`` and ``b0`` are where the first occurrence begins and what follows its end; the words are null for one in the same text.
    """
    prints = table(fingerprints(docs, gram, window), "lines-fp")
    place = F.xxhash64("doc_id", "th", "pos")
    # A table of its own, so that the join's sides are plain exchanges, which can be split where one fingerprint has very many places.
    again = table(prints.groupBy("g1", "g2").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p < q").select("g1", "g2"), "lines-again")
    hits = table(prints.join(again.hint("shuffle_hash"), ["g1", "g2"], "left_semi"), "lines-hits")
    first = hits.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("at"))
    first = table(first.select("g1", "g2", F.col("at.doc_id").alias("d0"), F.col("at.th").alias("t0"), F.col("at.pos").alias("p0")), "lines-first")
    met = hits.join(first.hint("shuffle_hash"), ["g1", "g2"]).where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("th") == F.col("t0")) & (F.col("pos") == F.col("p0"))))
    met = met.select("doc_id", "th", "d0", "t0", (F.col("pos") - F.col("p0")).alias("off"), "pos").distinct()
    # Fingerprints of one diagonal whose grams touch are one run.
    order = Window.partitionBy("doc_id", "th", "d0", "t0", "off").orderBy("pos")
    met = met.withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(order) > gram, F.lit(True)).cast("int"))
    met = met.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = met.groupBy("doc_id", "th", "d0", "t0", "off", "run").agg(F.min("pos").alias("a"), (F.max("pos") + (gram - 1)).alias("b"))
    runs = table(runs.select("doc_id", "th", "d0", "t0", "a", "b", (F.col("a") - F.col("off")).alias("a0"), (F.col("b") - F.col("off") + 1).alias("b0"), (F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("th") == F.col("t0"))).alias("own")), "lines-runs")
    # A run within one text finds the words around its first place where it is extended.
    far, own = runs.where("not own"), runs.where("own")
    around = table(_contexts(docs, far, gram + window), "lines-around")
    for side, at in (("before", "a0"), ("after", "b0")):
        c = around.where(F.col("side") == side).select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("at").alias("_at"), F.col("words").alias(side))
        far = far.join(c, F.col("d0").eqNullSafe(F.col("_d")) & (F.col("t0") == F.col("_t")) & (F.col(at) == F.col("_at"))).drop("_d", "_t", "_at")
    run = F.struct("a", "b", "own", "a0", "b0", "before", "after").alias("run")
    runs = far.select("doc_id", "th", run).union(own.select("*", *(F.lit(None).cast("array<bigint>").alias(c) for c in ("before", "after"))).select("doc_id", "th", run))
    return runs.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))


def _contexts(docs: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """``(d, t, side, at, words)``: hashes of the words before (nearest first) or from word ``at`` of first texts."""
    ends = F.array(F.struct(F.lit("before").alias("side"), F.col("a0").alias("at")), F.struct(F.lit("after").alias("side"), F.col("b0").alias("at")))
    asked = runs.select(F.col("d0").alias("d"), F.col("t0").alias("t"), F.explode(ends).alias("x")).groupBy("d", "t").agg(F.collect_set("x").alias("asked"))
    asked = table(asked, "lines-asked")
    # Hash buckets drop most other texts before the shuffle.
    slot = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(PREFILTER_BUCKETS))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text").withColumn("_slot", slot("doc_id", "th"))
    texts = texts.join(F.broadcast(asked.select(slot("d", "t").alias("_slot")).distinct()), "_slot", "left_semi")
    met = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(["d", "t"])
    found = let(word_hashes(F.col("text")), lambda h: F.transform("asked", lambda x: F.struct(x["side"].alias("side"), x["at"].alias("at"), F.when(x["side"] == "before", _before(h, x["at"], reach)).otherwise(F.slice(h, x["at"] + 1, reach)).alias("words"))))
    return met.select("d", "t", F.explode_outer(found).alias("x")).select("d", "t", "x.*")


def _before(h: Column, at: Column, reach: int) -> Column:
    low = F.greatest(at - reach, F.lit(0))
    return F.reverse(F.slice(h, low + 1, at - low))


def _common(a, b, reach: int) -> Column:
    """How many leading elements of two lists are equal; ``a(n)`` and ``b(n)`` are their first n.  Few are taken where these differ already."""
    first = lambda x, y: (F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), F.lit(False)) - 1).cast("int")
    both = lambda n, body: let(a(n), lambda x: let(b(n), lambda y: body(x, y)))
    whole = both(reach, lambda x, y: F.when(x == y, F.size(x)).otherwise(first(x, y)))
    return both(min(NEAR, reach), lambda x, y: F.when(x != y, first(x, y)).otherwise(whole))


def _ranges(h: Column, runs: Column, reach: int) -> Column:
    """The runs extended, in order, overlapping or adjacent ones made one; short ones of the text's own words left out."""

    def extended(r: Column) -> Column:
        before = lambda n: F.when(r["own"], _before(h, r["a0"], n)).otherwise(F.slice(r["before"], 1, n))
        after = lambda n: F.when(r["own"], F.slice(h, r["b0"] + 1, n)).otherwise(F.slice(r["after"], 1, n))
        left = _common(lambda n: _before(h, r["a"], n), before, reach)
        right = _common(lambda n: F.slice(h, r["b"] + 2, n), after, reach)
        return F.struct((r["a"] - left).alias("a"), (r["b"] + right).alias("b"), r["own"].alias("own"))

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))
        return F.when(last["b"] + 1 >= r["a"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    found = F.filter(F.transform(runs, extended), lambda r: ~r["own"] | (r["b"] - r["a"] >= reach - 2))
    found = F.transform(found, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")))
    return F.aggregate(F.array_sort(found), F.array().cast("array<struct<a:int,b:int>>"), add)


def _cut(units: Column, ranges: Column) -> Column:
    """The units, each a word with the space before it, joined without those in ranges."""
    breaks = lambda i: units[i].contains("\n")
    gap = lambda i: F.regexp_extract(units[i], f"^[{SPACE}]*", 0)

    def snapped(r: Column) -> Column:
        a, b = F.when(breaks(r["a"]), r["a"]), F.when(breaks(r["b"] + 1), r["b"])
        for k in range(1, EDGE):
            a, b = a.when(breaks(r["a"] + k), r["a"] + k), b.when(breaks(r["b"] + 1 - k), r["b"] - k)
        return F.struct(a.otherwise(r["a"]).alias("a"), b.otherwise(r["b"]).alias("b"))

    def with_gap(r: Column) -> Column:
        g, h = gap(r["a"]), gap(r["b"] + 1)
        before = F.regexp_replace(g, r"\n[^\n]*\z", "")
        after = F.regexp_extract(h, r"\n(?s:.*)", 0)
        inside = F.array_join(F.slice(units, r["a"] + 2, r["b"] - r["a"]), "").contains("\n")
        made = F.when(h.contains("\n"), F.when(g.contains("\n"), F.concat(before, after)).otherwise(after)).when(g.contains("\n") | ~inside, g).otherwise(F.lit("\n"))
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), made.alias("gap"))

    def kept(cuts: Column) -> Column:
        def after(r: Column, i: Column) -> Column:
            until = F.coalesce(F.get(cuts, i + 1)["a"], F.size(units))
            return F.concat(r["gap"], F.regexp_replace(units[r["b"] + 1], f"^[{SPACE}]+", ""), F.array_join(F.slice(units, r["b"] + 3, F.greatest(until - r["b"] - 2, F.lit(0))), ""))

        return F.concat(F.array_join(F.slice(units, F.lit(1), F.get(cuts, F.lit(0))["a"]), ""), F.array_join(F.transform(cuts, after), ""))

    # Runs may all be too short to cut.
    whole = lambda cuts: F.when(F.size(cuts) == 0, F.array_join(units, "")).otherwise(kept(cuts))
    return let(F.transform(F.transform(ranges, snapped), with_gap), whole)


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated runs cut from ``text``, and ``n_lines_removed``, ``kept``; ``n_chars`` follows where present."""
    runs = repeated_runs(columns_of(docs, "doc_id", "text"), gram, window)
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("runs").alias("_r"))
    made = ("n_lines_removed", "kept")
    plain = columns_of(docs, *(c for c in docs.columns if c not in made)).withColumn("_th", F.xxhash64("text"))
    out = plain.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")

    def cut(whole: Column) -> Column:  # the text between two line ends, so that all lines are alike
        def at(units: Column) -> Column:
            ranges = let(word_hashes(whole), lambda h: _ranges(h, F.col("_r"), gram + window))
            return let(ranges, lambda r: _cut(units, r))

        # The last one is the space at the end.
        return let(F.regexp_extract_all(whole, F.lit(f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"), F.lit(0)), at)

    whole = F.concat(F.lit("\n"), F.col("text"), F.lit("\n"))
    found = F.when(F.col("_r").isNotNull(), let(let(whole, cut), lambda new: F.struct(
        F.when(new.rlike(f"[^{SPACE}]"), F.substring(new, F.lit(2), F.length(new) - 2)).otherwise(F.lit("")).alias("text"),
        new.rlike(f"[^{SPACE}]").alias("kept"),
        (F.regexp_count("text", F.lit("\n")) + 2 - F.regexp_count(new, F.lit("\n"))).cast("bigint").alias("gone"),
    )))
    # The generator keeps the cut from being computed once for each of its fields.
    out = out.withColumn("_new", F.explode(F.array(found)))
    out = out.withColumn("text", F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.col("_new.text")))
    out = out.withColumn("kept", F.coalesce("_new.kept", F.lit(True))).withColumn("n_lines_removed", F.coalesce("_new.gone", F.lit(0).cast("bigint")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_r").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), *made)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines_removed", "kept", "text")
