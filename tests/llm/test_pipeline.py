"""The pipeline stage by stage, each against a plain version on its own input."""

import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import bpe, langid, mixing
from quillon.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage on documents of sf0.001."""
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = table(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_keep_columns(stages):
    columns = stages["language"][0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    assert all(stages[n][1].columns == columns for n in list(stages)[:-1])


def test_language(stages):
    docs, made = (x.collect() for x in stages["language"])
    got = {r.doc_id: r for r in made}
    assert set(got) == {r.doc_id for r in docs if any(c.isalpha() for c in r.text or "")}
    assert all(got[r.doc_id].text == r.text for r in docs if r.doc_id in got)
    known = [r for r in docs if r.lang and r.lang != langid.UND and r.doc_id in got]
    assert sum(got[r.doc_id].lang == r.lang for r in known) >= 0.98 * len(known)


def test_near_duplicates_by_all_pairs(spark, stages):
    """On the stage's own input, and on near copies that the line stage has not cut: what is linked is found, and nothing else goes."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = words(rng.randint(30, 400))
        for k in range(rng.choice([1, 1, 2, 5])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40)) if k else 0):
                edited[rng.randrange(len(base))] = words(1)[0]
            rows.append((1000 * i + k, " ".join(edited), "en", "s", 0))
    planted = spark.createDataFrame(rows, stages["lines"][1].schema)
    for docs in (stages["lines"][1], planted):
        texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
        ids, root = sorted(texts), {i: i for i in texts}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        links = 0
        for a, i in enumerate(ids):
            for j in ids[a + 1 :]:
                both = len(texts[i] & texts[j])
                if both and 100 * both >= 80 * (len(texts[i]) + len(texts[j]) - both):
                    links += 1
                    one, two = sorted((find(i), find(j)))
                    root[two] = one
        got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got == Counter(i for i in ids if find(i) == i)
    assert links > 50


def test_mixture(stages):
    docs, made = stages["mixture"]
    size, taken = Counter(), Counter()
    for r in docs.collect():
        size[r.doc_id] += len(WORD.findall(r.text))
    for r in made.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(taken[i] <= 2 * size[i] for i in taken)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert {i: n for i, n in want.items() if n} == dict(taken)


def test_tokens(stages):
    docs, made = stages["tokens"]
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in made.collect()) == want


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(map(str, got.collect())) == Counter(map(str, stages["tokens"][1].collect()))


def test_run_on_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
