"""Language identification without caps: many labels, many letters, sparse rows against plain dictionaries."""

import random

from quillon.llm import langid


def plain_phrases(follow, text):
    """Longest phrases by the automaton's dictionaries, a letter that no phrase begins with being one of its own."""
    count, state = 0, 0
    for c in text:
        if state and c in follow[state]:
            state = follow[state][c]
        else:
            count, state = count + 1, follow[0].get(c, 0)
    return count


def test_compact_rows():
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(900)] + list("abcdefgh ")
    samples = {k: "".join(rng.choice(letters[a:b]) for _ in range(3000)) for k, (a, b) in {"one": (0, 400), "two": (300, 909), "abc": (900, 909)}.items()}
    samples = {k: langid.letters_only(v) for k, v in samples.items()}
    model = langid.fit(samples)
    text = langid.letters_only("".join(rng.choice(letters + ["\u0639", "z"]) for _ in range(700)))
    got = langid.phrases(model, [langid.symbols_of(text, model.codes)])[0]
    assert got.tolist() == [plain_phrases(langid.suffix_automaton(samples[k]), text) for k in model.langs]
    assert all(len(a.rows) < 4 * sum(map(len, langid.suffix_automaton(samples[k]))) + 8 * len(letters) for k, a in zip(model.langs, model.automata, strict=True))


def test_many_languages_and_scripts(spark):
    """Eighty labels, each with letters of its own beyond any single script; letters of all planes."""
    rng = random.Random(1)
    alphabets = [[chr(0x4E00 + 120 * k + i) for i in range(100)] if k % 2 else [chr(0x30000 + 50 * k + i) for i in range(40)] for k in range(80)]
    text = lambda k, n: "".join(rng.choice(alphabets[k]) + (" " if rng.random() < 0.2 else "") for _ in range(n))
    rows = [(i, text(i % 80, 300), f"l{i % 80:02d}", "l00") for i in range(800)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")).collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.lang_pred == r.lang for r in got)


def test_letters_beyond_the_planes(spark):
    rows = [(i, "plain words of one language", "aa") for i in range(30)] + [(100, chr(0x30000) * 20, None), (None, "plain words", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].lang_pred == "aa" and 0 <= got[100].score <= 1
    assert got[None].held_out is None and got[None].lang_pred == "aa"


def test_sample_is_bounded(spark):
    """One doc_id on most rows, and null ones: they reach the driver once."""
    rows = [(7, f"the same id {i}", "aa") for i in range(3000)] + [(None, "no id at all", "aa")] * 2000 + [(i, f"text {i}", "aa") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_samples(docs)["aa"]
    assert "no id" not in sample and sample.count("the same id") <= 1 and sample.count("text") > 20
