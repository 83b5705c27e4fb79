"""Mixing sources to target weights, by DataFrame operations alone.

Each source's documents form one stream of words, in a hashed order of doc_id,
cut into blocks of BLOCK words.  The mix is a sequence of block slots in output
shards.  Every shard draws how many of its slots each source gets (a multinomial
draw by the target weights); a source's slots are numbered through the shards, its
k-th slot maps to a block by a pseudorandom permutation of its block numbers, pass
after pass, and slots meet blocks in a join on (source, block).  All hashes have fixed
seeds, so reruns agree; ``seed`` gives other draws.

The draws decide how many blocks a source gives, within DRIFT of its target: surplus
draws beyond that fall away, in the last shards, and a shortfall is filled by slots
dealt over all shards.  A source of few slots meets its target exactly; with very many
slots draws stay far inside DRIFT by themselves.  The source's last slot is cut to the
words over, so that taken words are within DRIFT and one block of the target.  No
source gives more than MAX_REPEAT whole passes.

Targets: the mix has ``share`` times all words; sources ordered by code point, null
last, weigh 3, 1, 2, 3, 1, 2, ...; a target is capped at twice its source's words,
and what is over is shared by weight among the others until nothing is over.  So
no document is taken more than twice.

Defined results: null or wordless text has size 0 and is never taken.  Rows that
repeat, doc_ids that repeat and null ones are documents of their own: equal rows are
counted first, then numbered and dealt one by one, so no key gathers them.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, let, table

BLOCK = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SLOTS_PER_SHARD = 4_096
MAX_SHARDS = 65_536
#: Documents of a cell, whose words one task sums up in order; the number of cells has a bound.
DOCS_PER_CELL = 256
MAX_CELLS = 65_536
#: Cells of the unit interval by which a draw finds its source.
DRAW_CELLS = 4_096
ROUNDS = 12
#: How far draws may take a source from its target, as a share of its slots.
DRIFT = 0.005
SEED = 1
WORD = r"[^\x20\x09-\x0D]+"


def unit(*parts: Column) -> Column:
    """A hash of the parts, uniform in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 applied to ``x``: rounds of swap-or-not.

    Round r pairs x with k_r - x modulo n and swaps if a hash of the larger says so.
    It is its own inverse round by round, hence one to one for every n.
    """

    def swap(v: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, F.lit("key"), *seed), n) - v, n)
        return F.when(F.xxhash64(r, F.greatest(v, partner), *seed).bitwiseAND(F.lit(1)) == 1, partner).otherwise(v)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), x.cast("bigint"), swap)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``(source, source_size)`` rows with ``target``; one row a source, summed up in one task.

    The shared level L solves sum(min(cap, weight * L)) = total: in order of
    cap / weight, the first source whose cap holds the level that is left for it
    and its followers fixes L.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * F.lit(float(MAX_REPEAT)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    d = d.withColumn("level", left / F.sum("w").over(after))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    first = F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.select("source", "source_size", "w", F.least(F.coalesce(first * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, h, size, n)``: equal rows as one, h a hash of the text."""
    d = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words(F.col("text")).alias("size"))
    return d.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n"))


#: Copies of a row, or slots of a draw, that one sequence numbers.
RUN = 4_096


def numbered(classes: DataFrame) -> DataFrame:
    """One row a copy, ``copy`` from 0: a class of many copies is cut into runs, which are dealt to all tasks."""
    inside = lambda first, n: F.explode(F.sequence(first, F.least(first + RUN, n) - 1)).alias("copy")
    keep = ("doc_id", "source", "h", "size")
    few = classes.where(F.col("n") <= RUN).select(*keep, inside(F.lit(0).cast("bigint"), F.col("n")))
    runs = classes.where(F.col("n") > RUN).select(*keep, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))).alias("at"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few.unionByName(runs.repartition(parts, "doc_id", "h", "at").select(*keep, inside(F.col("at"), F.col("n"))))


def placed(classes: DataFrame) -> DataFrame:
    """``(doc_id, source, h, size, first)`` of each copy with words: its first word in its source's stream.

    Copies fall into hashed cells of bounded number; a cell holds a share of every
    source, so a source with most rows spreads like any other.  Words are summed
    inside cells, then cell totals are summed in cell order.
    """
    rows = classes.where("size > 0")
    cells = max(1, min(MAX_CELLS, (rows.agg(F.sum("n")).first()[0] or 0) // DOCS_PER_CELL))
    d = numbered(rows).withColumn("cell", F.pmod(F.xxhash64("doc_id", "h", "copy", F.lit("cell")), F.lit(cells)))
    totals = d.groupBy("cell", "source").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("cell").alias("c"), F.col("source").alias("s"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell", "source").orderBy(F.xxhash64("doc_id", "copy"), "doc_id", "size", "h", "copy").rowsBetween(Window.unboundedPreceding, -1)
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(n, "cell").withColumn("first", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(totals, (F.col("cell") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
    return d.select("doc_id", "source", "h", "size", (F.col("first") + F.col("start")).alias("first"))


def planned(plan: DataFrame) -> DataFrame:
    """Rows with source, source_size, target, as slots: ``(source, blocks, rest, slots, low, high)``.

    rest: words beyond whole passes.  low, high: how many slots the draws may leave.
    """
    p = plan.select("source", "source_size", F.round("target").cast("bigint").alias("want")).where("want > 0")
    p = p.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn("rest", F.col("want") % F.col("source_size"))
    # Whole passes first, then blocks up to the words left.
    p = p.withColumn("slots", F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + F.ceil(F.col("rest") / BLOCK))
    drift = F.floor(F.col("slots") * DRIFT)
    return p.select("source", "blocks", "rest", "slots", (F.col("slots") - drift).alias("low"), F.least(F.col("slots") + drift, F.col("blocks") * MAX_REPEAT).alias("high"))


def draws(p: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """``(shard, source, n)``: the multinomial draw of every shard, in which each slot's uniform number falls into one source's interval."""
    line = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = p.select("source", "slots", F.sum("slots").over(line).alias("upto"), F.sum("slots").over(whole).alias("all"))
    spans = spans.select("source", ((F.col("upto") - F.col("slots")) / F.col("all")).alias("lo"), (F.col("upto") / F.col("all")).alias("hi"))
    spans = spans.withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") * DRAW_CELLS), F.least(F.floor(F.col("hi") * DRAW_CELLS), F.lit(DRAW_CELLS - 1)))))
    slot = p.sparkSession.range(total).select(F.pmod("id", F.lit(shards)).alias("shard"), unit(F.col("id"), F.lit("slot"), F.lit(seed)).alias("u"))
    slot = slot.withColumn("at", F.floor(F.col("u") * DRAW_CELLS))
    # At most two spans a cell and source: DRAW_CELLS rows and two a source, summed by (shard, source) at once.
    return slot.join(spans, "at").where("u >= lo and u < hi").groupBy("shard", "source").agg(F.count("*").alias("n"))


def drawn(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Block slots ``(shard, source, k, block, epoch, words)`` of the mix, from rows with source, source_size, target."""
    p = table(planned(plan), "mix-plan")
    total = p.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, -(-total // SLOTS_PER_SHARD)))
    counts = table(draws(p, total, shards, seed), "mix-draws")

    # A source's slots are numbered through the shards; what goes beyond its bound falls away.
    q = p.withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(q, same)
    got = counts.groupBy("source").agg(F.sum("n").alias("got")).select(F.col("source").alias("g"), "got")
    ends = p.join(got, F.col("source").eqNullSafe(F.col("g")), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    ends = ends.withColumn("end", F.least(F.greatest("got", "low"), "high"))
    keep = ("shard", "source", "start", "upto", "blocks", "rest", "end")
    runs = runs.join(ends.select(F.col("source").alias("e"), "end"), F.col("source").eqNullSafe(F.col("e"))).where("start < end")
    runs = runs.withColumn("upto", F.least(F.col("start") + F.col("n"), "end")).select(*keep)
    # A shortfall is filled by short runs, dealt to shards by a hash.
    more = ends.where("got < end").withColumn("start", F.explode(F.sequence("got", F.col("end") - 1, F.lit(64).cast("bigint"))))
    more = more.withColumn("upto", F.least(F.col("start") + 64, "end")).withColumn("shard", F.pmod(F.xxhash64("start", F.coalesce("source", F.lit("\0")), F.lit(seed)), F.lit(shards)))
    # Dealt by run before the slots are made, so that no task makes those of many runs.
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.unionByName(more.select(*keep)).repartition(n, "source", "shard", "start")
    each = runs.withColumn("k", F.explode(F.sequence("start", F.col("upto") - 1)))
    epoch = F.floor(F.col("k") / F.col("blocks"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.coalesce("source", F.lit("\0")), epoch)
    cut = F.when((F.col("k") == F.col("end") - 1) & (F.col("rest") % BLOCK > 0), F.col("rest") % BLOCK).otherwise(F.lit(BLOCK))
    return each.select("shard", "source", "k", block.alias("block"), epoch.cast("int").alias("epoch"), cut.cast("bigint").alias("words"))


def taken_ranges(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal rows, the plan by source, and the ranges the mix takes of each document with words.

    Ranges: ``(doc_id, source, h, size, first, shard, k, epoch, a, b)``, words a up to b of
    the document, in slot k of its source; one row with null range for what the mix leaves out.
    """
    classes = table(counted(docs), "mix-classes")
    plan = table(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share=share), "mix-target")
    d = table(placed(classes), "mix-docs")
    slots = drawn(plan, seed).withColumnRenamed("source", "s").withColumnRenamed("block", "bl")
    last = F.floor((F.col("first") + F.col("size") - 1) / BLOCK)
    parts = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), last)))
    met = parts.join(slots, (F.col("block") == F.col("bl")) & F.col("source").eqNullSafe(F.col("s")), "left")
    begin = F.col("block") * BLOCK
    a = F.greatest(begin, "first") - F.col("first")
    b = F.when(F.col("words").isNotNull(), F.least(begin + F.col("words"), F.col("first") + F.col("size")) - F.col("first"))
    return classes, plan, met.select("doc_id", "source", "h", "size", "first", "shard", "k", "epoch", a.alias("a"), b.alias("b"))


def mix(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_shards`` of every row of ``docs(doc_id, text, source)``.

    n_shards: output shards that hold words of the document.
    """
    classes, plan, met = taken_ranges(columns_of(docs, "doc_id", "text", "source"), share, seed)
    words = F.greatest(F.col("b") - F.col("a"), F.lit(0))
    per = met.groupBy("doc_id", "source", "h", "size", "first").agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.size(F.collect_set(F.when(words > 0, F.col("shard")))).cast("bigint").alias("n_shards"))
    none = numbered(classes.where("size = 0")).select("doc_id", "source", "size", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("n_shards"))
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = per.select("doc_id", "source", "size", "taken", "n_shards").unionByName(none).join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_shards")


#: White space before a text's first word, and the places between a word's white space and the next word.
_LEAD, _BETWEEN = r"^[\x20\x09-\x0D]+", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def pieces(text: Column) -> Column:
    """The words of a text, each with the white space after it."""
    return F.split(F.regexp_replace(text, _LEAD, ""), _BETWEEN)


def _with_text(docs: DataFrame, met: DataFrame) -> DataFrame:
    """``met`` rows, whose keys are named d, s, th, beside the columns of one copy of their document."""
    rows = docs.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "_h"])
    return rows.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("th")) & F.col("source").eqNullSafe(F.col("s")))


def mixed_blocks(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mix itself: ``(shard, source, k, epoch, n_words, text)``, the packed text of every slot of every output shard.

    A slot holds the words of its block, document after document, a newline after each
    document's part; rows of a shard lie in no order, ``k`` numbers a source's slots.
    """
    base = columns_of(docs, "doc_id", "text", "source")
    _, _, met = taken_ranges(base, share, seed)
    keep = ("shard", "k", "epoch", "first", "a", "b")
    met = met.where("b > a").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h").alias("th"), *keep)
    # One row a document, so that its text is cut into words once for all its slots.
    met = met.groupBy("d", "s", "th").agg(F.collect_list(F.struct(*keep)).alias("parts"))
    cut = lambda ps: F.transform("parts", lambda r: F.struct(*(r[c].alias(c) for c in keep), F.rtrim(F.array_join(F.slice(ps, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")), "")).alias("text")))
    each = _with_text(base, met).select("source", F.explode(let(pieces(F.col("text")), cut)).alias("x")).select("source", "x.*")
    slot = each.groupBy("shard", "source", "k", "epoch").agg(F.sum(F.col("b") - F.col("a")).alias("n_words"), F.array_sort(F.collect_list(F.struct("first", "text"))).alias("texts"))
    return slot.select("shard", "source", "k", "epoch", "n_words", F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("text"))


def mixed_documents(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each pass that takes words of it, cut to those words.

    The words taken keep the white space that follows them; ``n_chars`` is counted
    anew where the input has it.  Rows with equal doc_id and text share one copy of
    the text here; each is still taken on its own.
    """
    _, _, met = taken_ranges(columns_of(docs, "doc_id", "text", "source"), share, seed)
    met = met.where("b > a")
    per = met.groupBy("doc_id", "source", "h", "size", "first", "epoch").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"), F.sum(F.col("b") - F.col("a")).alias("n"))
    per = per.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h").alias("th"), "size", "ranges", "n")
    cut = lambda ps: F.flatten(F.transform("ranges", lambda r: F.slice(ps, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int"))))
    whole = F.col("n") == F.col("size")
    out = _with_text(docs, per).withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(let(pieces(F.col("text")), cut), "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
