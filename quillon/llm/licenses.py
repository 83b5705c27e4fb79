"""License scans by MinHash bands over overlapping windows, in DataFrame operations alone.

Words are runs of letters and digits, lower-cased; shingles are NGRAM words.  A text
is cut into windows of WINDOW shingles, STEP apart, and so are the templates.  Each
window has BANDS minimum hashes, a band each; a text window and a template window that
share one make the template a candidate of the document.  Bands alone would miss some
templates of few shingles, above all at the ends of a text, where a shingle lies in one
window only; so every shingle's own hash is a band key too, and a text that shares any
shingle with a template is surely a candidate.  A candidate is verified exactly: the share of the
template's distinct shingles that the document holds must reach THRESHOLD.

Documents that cannot match are left out first: from every template words are taken
that occur in more than a fifth of its shingles; a document with 0.8 of them holds one
of these words.  Templates are a parameter of the job and are broadcast while their
bands are at most BROADCAST_ROWS; beyond that they are joined by shuffle.

Defined results: null or empty text has no license.  Rows that share a doc_id and text
give one row a license.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, let, table

NGRAM = 5
THRESHOLD = 0.8
WINDOW = 4
STEP = 2
BANDS = 16
BROADCAST_ROWS = 100_000

#: Notices of public licenses: fixed values, as their authors have them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)

_SPLIT = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(text: str) -> list[str]:
    w = template_words(text)
    if len(w) < NGRAM:
        raise ValueError(f"a template needs {NGRAM} words: {text!r}")
    return list(dict.fromkeys(" ".join(w[i : i + NGRAM]) for i in range(len(w) - NGRAM + 1)))


def anchor_words(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every ``threshold`` share of the template's shingles holds at least one."""
    shingles = template_shingles(text)
    open_, chosen = set(shingles), []
    counts = Counter(w for s in shingles for w in set(s.split()))
    while len(open_) >= threshold * len(shingles):
        # Long words are rare; each is taken with all its shingles.
        word = max((w for w in counts if w not in chosen and any(w in s.split() for s in open_)), key=lambda w: (len(w) > 4, len(w), w))
        chosen.append(word)
        open_ = {s for s in open_ if word not in s.split()}
    return chosen


def shingles(text: Column) -> Column:
    """The text's shingles in order, repeats included."""

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n >= NGRAM, F.sequence(F.lit(1), n - NGRAM + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, NGRAM), " "))

    listed = let(F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != ""), of)
    return F.coalesce(listed, F.array().cast("array<string>"))


def bands(hashes: Column) -> Column:
    """Distinct band keys of all windows of a list of shingle hashes, and of each shingle."""
    n = F.size(hashes)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (WINDOW - STEP), F.lit(1)), F.lit(STEP)))
    mins = lambda part: F.array(*(F.xxhash64(F.lit(b), F.array_min(F.transform(part, lambda h: F.xxhash64(F.lit(b), h)))) for b in range(BANDS)))
    windows = F.flatten(F.transform(starts, lambda i: mins(F.slice(hashes, i, WINDOW))))
    return F.array_distinct(F.concat(windows, F.transform(hashes, lambda h: F.xxhash64(F.lit(-1), h))))


def _band_rows(df: DataFrame, shingle_column: str) -> DataFrame:
    return df.withColumn("_h", F.transform(shingle_column, lambda s: F.xxhash64(s))).withColumn("band", F.explode(bands(F.col("_h")))).drop("_h")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, containment`` for every license notice found in ``docs(doc_id, text)``."""
    spark: SparkSession = docs.sparkSession
    rows = [(name, parts, len(parts)) for name, text in templates for parts in [template_shingles(text)]]
    t = spark.createDataFrame(rows, "license string, wanted array<string>, size int")
    anchors = sorted({w for _, text in templates for w in anchor_words(text, threshold)})
    # Parts of words may pass as well: the filter only has to let all that can match through.
    likely = F.lower("text").rlike("|".join(map(re.escape, anchors)))
    d = table(columns_of(docs, "doc_id", "text").where(likely), "license-texts")
    d = table(d.select("doc_id", F.xxhash64("text").alias("th"), shingles(F.col("text")).alias("found")), "license-docs").where(F.size("found") > 0)
    t_bands = table(_band_rows(t, "wanted").select("band", "license").distinct(), "license-bands")
    if t_bands.count() <= BROADCAST_ROWS:
        t_bands = F.broadcast(t_bands)
    hits = _band_rows(d, "found").select("doc_id", "th", "band").join(t_bands, "band").select("doc_id", "th", "license").distinct()
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("license").alias("licenses"))
    met = d.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(["doc_id", "th"])
    met = met.select("doc_id", "found", F.explode("licenses").alias("license")).join(F.broadcast(t) if len(templates) <= 1_000 else t, "license")
    met = met.withColumn("containment", F.size(F.array_intersect("wanted", "found")) / F.col("size"))
    return met.where(F.col("containment") >= threshold).select("doc_id", "license", "containment")


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, s.replace("'", "''")) for name, text in TEMPLATES for s in template_shingles(text))
    return rf"""
WITH t(license, s) AS (VALUES {values}), d AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' '))) AS s FROM d WHERE len(w) >= {NGRAM}
), n AS (SELECT license, COUNT(*) AS size FROM t GROUP BY license)
SELECT s.doc_id, t.license, COUNT(*) / CAST(ANY_VALUE(n.size) AS DOUBLE) AS containment
FROM s JOIN t ON s.s = t.s JOIN n ON n.license = t.license
GROUP BY s.doc_id, s.text, t.license HAVING COUNT(*) >= {THRESHOLD} * ANY_VALUE(n.size)
"""


ORACLE = _oracle()
