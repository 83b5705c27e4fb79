"""Cases of the first advice: each failed before its change."""

import random
from collections import Counter

import corpus_pipeline
from quillon.llm import langid, licenses, linededup
from test_operators import frame, prose


def test_null_ids_survive_near_duplicates(spark):
    rng = random.Random(11)
    texts = [prose(rng, "ka lo mi ne pu".split(), 40) for _ in range(4)]
    rows = [(1, texts[0], "a", "s"), (2, texts[0], "a", "s"), (None, texts[0], "a", "s"), (None, texts[1], "a", "s"), (None, texts[1], "a", "s"), (3, texts[2], "a", "s"), (None, None, "a", "s")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert got.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t, *_ in rows if i != 2)


def test_passages_inside_lines(spark):
    rng = random.Random(12)
    own = lambda n: prose(rng, "ko lu".split(), n).replace("k", rng.choice("bdfg")).split()
    rows, want = [], {}
    for i in range(30):
        passage = prose(random.Random(i // 2), "ra te mi".split(), 49 + i // 2).split()
        head, tail = own(10) + [f"h{i}"], [f"t{i}"] + own(10)
        gaps = [rng.choice([" ", " ", " ", "\n", "  "]) for _ in passage]  # lines break elsewhere in each
        gaps[0] = gaps[1] = gaps[2] = gaps[-1] = gaps[-2] = " "
        text = " ".join(head) + "".join(g + w for g, w in zip(gaps, passage)) + " " + " ".join(tail)
        rows.append((i, text, "a", "s"))
        want[i] = (" ".join(head) + ("\n" if "\n" in gaps else " ") + " ".join(tail), max(gaps.count("\n") - 1, 0)) if i % 2 else (text, 0)
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in got} == want
    assert all(r.kept and r.n_chars == len(r.text) for r in got)


def test_license_at_the_end_of_a_text(spark):
    rng = random.Random(13)
    # 25 words before make an even number of shingles, so that the last lies in one window only.
    rows = [(i, f"{prose(rng, 'ka lo mi ne pu'.split(), 25)} Released under the MIT License.", "a", "s") for i in range(800)]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == [(i, "mit", 1.0) for i in range(800)]


def test_language_sample_size(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, "ka lo mi ne pu".split(), 1200), "aa", "s") for i in range(40)]
    assert 32_700 < len(langid.training_samples(frame(spark, rows))["aa"]) <= 32_768
