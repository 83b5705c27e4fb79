"""Small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from quillon.llm import bpe, html, jaccard, langid, lattice, licenses, linededup, mixing, quality
from quillon.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, comp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in rows], DOCS)


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(90):
        lang, syl = [("aa", "ka lo mi ne pu".split()), ("bb", "sch ein über gra ten".split()), ("cc", "qu ois aux ément el".split())][i % 3]
        rows.append((i, "\n".join(prose(rng, syl, rng.randint(4, 40)) for _ in range(rng.randint(1, 6))), lang if i % 10 else None, f"s{i % 4}" if i % 7 else None))
    shared = prose(rng, "zor ban tik".split(), 60)
    for i in range(90, 100):
        rows.append((i, f"{prose(rng, 'ka lo mi'.split(), 10)}\n{shared}\n{prose(rng, 'ka lo mi'.split(), 10)}", "aa", "s0"))
    base = prose(rng, "ti ra mo su".split(), 120).split()
    for i in range(100, 130):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w), "aa", "s1"))
    rows += [(130, None, None, None), (131, "", "aa", "s1"), (132, " \n\t", "aa", "s1"), (133, "12 3!", None, "s2"), (134, "one two", "bb", "s2"), (135, "One  TWO", "bb", "s2")]
    rows += [(136, rows[0][1], "aa", "s0"), (0, *rows[0][1:]), (137, prose(rng, "ka lo mi ne pu".split(), 9000), "aa", "s3"), (None, rows[1][1], "bb", "s1")]
    return rows


def test_language(spark, corpus):
    got = langid.identify(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 90:
            assert r.lang_pred == ("aa", "bb", "cc")[r.doc_id % 3]
        assert 0 <= r.score <= 1
    none = langid.identify(frame(spark, corpus).where("doc_id = -1"))
    assert none.collect() == []
    assert {r.lang_pred for r in langid.identify(frame(spark, [(i, "abc", None, "s") for i in range(3)])).collect()} == {"und"}


def test_cross_parsing_is_longest_match():
    rng = random.Random(1)
    samples = {"x": prose(rng, "ab ba c".split(), 300), "y": prose(rng, "ac d".split(), 300)}
    model = langid.fit(samples)
    text = prose(rng, "ab ac d c e".split(), 100)
    got = langid.phrases(model, [langid.symbols_of(text, model.codes)])[0]
    for lang, n in zip(model.langs, got, strict=True):
        at = count = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in samples[lang]:
                size += 1
            at, count = at + size, count + 1
        assert n == count


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, corpus):
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice("ab#é \n\x0b\x85 A!") for _ in range(rng.randint(0, 60)))
        assert quality.rule_counts(t)[:5] == brute_counts(t)
    good = [(1000 + i, prose(rng, "ka lo mi ne".split(), 90), "aa", "s") for i in range(60)]
    bad = [(2000 + i, " ".join(f"{w}%%%" for w in prose(rng, "ka lo mi ne".split(), 90).split()), "aa", "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in good[:40]] + [(i, 0) for i, *_ in bad[:10]] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(frame(spark, good + bad + corpus), labels).collect()}
    for i, t, *_ in corpus:
        assert tuple(got[i])[1:6] == brute_counts(t)
    assert sum(got[i].kept for i, *_ in bad) <= 4, [got[i].path_length for i, *_ in bad + good]
    assert sum(got[i].kept for i, *_ in good) >= 57
    assert got[130].base_failed and not got[130].kept
    unlabelled = quality.judge(frame(spark, good), labels.where("doc_id < 0")).collect()
    assert all(r.kept for r in unlabelled)


def test_line_dedup(spark, corpus):
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, [r for r in corpus if r[0] is not None])).collect()}
    text = {i: t for i, t, *_ in corpus if i is not None}
    shared = text[90].split("\n")[1]
    assert shared in got[90].text and got[90].n_lines_removed == 0
    for i in range(91, 100):
        assert got[i].text == "\n".join(x for x in text[i].split("\n") if x != shared) and got[i].n_lines_removed == 1
    assert got[130].text is None and got[130].kept and got[131].text == "" and got[132].text == " \n\t"
    assert not got[136].kept and got[136].text == "" and got[0].kept  # an exact copy, and what it copies
    clean = [i for i in range(1, 90)]
    assert all(got[i].text == text[i] for i in clean)
    run = ["alpha beta gamma delta"] * 40
    two = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, [(1, "\n".join(run), "a", "s"), (2, "x\n\n" + "\n".join(run[:20]) + "\ny", "a", "s")])).collect()}
    assert len(two[2].split("\n")) <= 3 + 13 and two[2][:3] == "x\n\n" and two[2][-2:] == "\ny"
    assert two[1] == run[0]  # a run that repeats itself
    assert linededup.dedup_lines(frame(spark, corpus).where("doc_id = -1")).collect() == []


def test_guarantee_of_winnowing(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        passage = [prose(random.Random(i // 2), "ra te mi".split(), rng2) for rng2 in (random.Random(i // 2).choices(range(5, 20), k=6))]
        before = [prose(rng, "ko lu".split(), rng.randint(1, 30)) for _ in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(before + passage + [prose(rng, "ko lu".split(), 12)]), "a", "s"))
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        lines = t.split("\n")
        if i % 2:
            assert got[i].n_lines_removed == 6 and got[i].text == "\n".join(lines[:-7] + lines[-1:])
        else:
            assert got[i].text == t


def test_bpe_matches_library(spark, corpus):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(open(path, encoding="utf-8").read())
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<|endoftext|>", " ", "a", "ab", "é", "\n", "'s", " ", "\x1c", "日", "7", "!!", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, *(t for _, t, *_ in corpus if t)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False) == t
    rows = bpe.encode_documents(frame(spark, corpus)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((len(ids), sha(",".join(map(str, ids))), sha(t or "")) for _, t, *_ in corpus for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, corpus))).select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t, *_ in corpus)


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_jaccard(spark, corpus):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t, n=4):
        w = WORD.findall((t or "").translate(lower))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in corpus if i is not None}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(ids, linked)
    got = jaccard.similar(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles > 0
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert want[136] == 0 and want[135] == 134 and len(set(want[i] for i in range(100, 130))) < 30
    kept = jaccard.representatives(frame(spark, corpus)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == {i for i in ids if want[i] == i}
    assert jaccard.similar(frame(spark, corpus).where("doc_id = -1")).collect() == []


def test_jaccard_large_keys(spark, monkeypatch):
    rng = random.Random(8)
    base = [prose(rng, "ti ra mo su".split(), 1) + str(k) for k in range(100)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(100)] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a", "s"))
    for name, value in (("SMALL_KEY", 8), ("BLOCK", 16), ("PIVOT_ROUNDS", 1), ("PIVOTS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(97)} for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, linked)
    assert {r.doc_id: r.component_id for r in jaccard.similar(frame(spark, rows)).collect()} == want
    assert 1 < len(set(want.values())) < 160


def test_jaccard_chunks(spark, monkeypatch):
    """Documents that share many large keys: a pair comes out once, not again under each key, and none is missed."""
    import numpy as np

    rng = np.random.default_rng(12)
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    # Keys 0 to 29 lie among documents 0 to 59, keys 100 to 139 far between 200 others.
    holds = [(k, d) for d in range(60) for k in range(30) if rng.random() < 0.8] + [(100 + int(k), 100 + d) for d in range(200) for k in rng.choice(40, 4, replace=False)]
    size = {k: sum(x == k for x, _ in holds) for k, _ in holds}
    live = spark.createDataFrame([(k, size[k], d, 10, d) for k, d in holds], "key long, m long, doc long, n long, comp long")
    sets = spark.createDataFrame([(d, 10, bytes([10]) + bytes(255)) for d in {d for _, d in holds}], "doc long, n long, hist binary")
    near, dense = jaccard._chunk_pairs(live, sets, 85, 4)
    once = [tuple(r) for r in near.collect()]
    assert len(once) == len(set(once)) and {r.key for r in dense.collect()} >= set(range(30))
    want = {(a, b) for k in size for a in {d for x, d in holds if x == k} for b in {d for x, d in holds if x == k} if a < b}
    got = {tuple(r) for r in jaccard._block_pairs(live, sets, 85, 260).collect()}
    assert want <= got and len(got) < 2 * len(want)


def test_jaccard_tells_no_pairs_of_large_keys(spark, monkeypatch):
    """A group of near copies that no pivot joins: what is told of it follows its documents, not its pairs."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(300), 2 + i % 3):
            w[k] = f"q{i}x{k}"
        rows.append((i, " ".join(w), "a", "s"))
    for name, value in (("SMALL_KEY", 8), ("BLOCK", 64), ("PIVOT_ROUNDS", 0), ("PART_TOKENS", 30_000)):
        monkeypatch.setattr(jaccard, name, value)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(297)} for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, linked)
    _, edges = jaccard.links(frame(spark, rows).select("doc_id", "text"))
    edges = [tuple(r) for r in edges.collect()]
    assert groups(sets, edges) == want and all(tuple(sorted(e)) in set(linked) for e in edges)
    assert len(linked) > 5 * len(edges)


def test_jaccard_shared(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(13)
    monkeypatch.setattr(jaccard, "SLAB", 7)
    one, two = ([np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64) << np.uint64(57)) for _ in range(m)] for m in (9, 5))
    assert jaccard._shared(one, two).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_jaccard_makes_few_whole_sets(spark, monkeypatch):
    """Texts that share passages but are not alike are told apart by their histograms."""
    rng = random.Random(9)
    shared = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(10)]
    rows = [(i, " ".join(rng.sample(shared, 5) + [f"o{i}x{j}" for j in range(60)]), "a", "s") for i in range(80)]
    made = []
    whole = jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda docs, n: made.append(docs.count()) or whole(docs, n))
    assert all(r.component_id == r.doc_id for r in jaccard.similar(frame(spark, rows)).collect())
    assert sum(made) <= 20


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, 600 + i) for i in range(50)] + [(i, i + 1) for i in range(700, 760)]
    want = groups({x for p in pairs for x in p}, pairs)
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_lattice(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(300, 8)) * 1.5
    near, second = lattice.e8_points(y)
    roots = np.array([r for r in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T if (r**2).sum() == 2] + [r / 2 for r in np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T if r.sum() % 4 == 0])
    assert len(roots) == 240
    for p, q in zip(near / 2, y, strict=True):
        assert ((p - q) ** 2).sum() <= (((p + roots) - q) ** 2).sum(1).min() + 1e-9
    assert (near != second).any(1).all()

    x = rng.normal(size=(400, 64))
    for k in range(100, 200):  # at cosine 0.9 and more of another
        z = rng.normal(size=64)
        a = x[k - 100] / np.linalg.norm(x[k - 100])
        z -= (z @ a) * a
        c = 0.9 + 0.1 * rng.random()
        x[k] = 3 * (c * a + math.sqrt(1 - c * c) * z / np.linalg.norm(z))
    x[200:240] = x[0] + rng.normal(size=(40, 64)) * 0.01
    x[240] = x[241] = x[242]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [None, *[1.0] * 63], 1), (404, [float("nan")] * 64, 1), (405, [float("inf")] * 64, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [1e300, 2e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert (found[200:240] >= 40).all() and found[240] == links[240] >= 2
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(400, 406))
    assert [got[i].n_links for i in (406, 407, 408)] == [2, 2, 2] and got[408].component_id == 406 and not got[408].kept
    assert lattice.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><nav><ul><li><a href=/a>A</a></ul></nav>
    <div class="ad">Buy</div><div class="cookie-notice">We use</div><article class="post-12"><h1>The &amp; title</h1><p><b>First  one<br>line.
    <p>Second &lt;p&gt; &eacute; a < b.</p><aside>Side</aside><script>var t="</p>";</script><form>F<input></form><ul><li>one<li>two</ul>
    <section id="comments"><p>Reader says so, at length and with many words.</p></section></article><footer>&copy; F</footer></body></html>"""
    assert html.extract(page) == "The & title\nFirst one line.\nSecond <p> é a < b.\none\ntwo"
    assert html.extract(page[: page.index("<ul><li>one")]) == "The & title\nFirst one line.\nSecond <p> é a < b."
    assert html.extract("<div class=sidebar-left><p>only text</p></div>") == "only text"
    assert html.extract("") == html.extract("<p>") == "" and html.extract("just &amp; text") == "just & text"
    assert html.extract("<article><p>x</p><!-- <p>no</p> --><table><tr><td>a<td>b<tr><td>c</table>") == "x\na b\nc"
    long = "<div class='story-1'><p>" + "word " * 60 + "</p></div>"
    odd = "<div class='story-2'><p>" + "true " * 20 + "</p></div><div class='rail'><p>" + "rail " * 35 + "</p></div>"
    rows = [(i, "http://h.io/a", long, "t") for i in range(5)] + [(5, "http://h.io/b", odd, "t"), (6, "http://g.io/b", odd, "t"), (7, None, None, "t"), (None, "http://h.io/a", long, "t"), (5, "http://h.io/b", odd, "t")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {(r.page_id, r.url): r.text for r in got}
    assert text[5, "http://h.io/b"] == " ".join(["true"] * 20) and text[6, "http://g.io/b"] == " ".join(["rail"] * 35)
    assert text[7, None] == "" and text[None, "http://h.io/a"] == " ".join(["word"] * 60)


def water_level(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            capped.add(s)
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]


def test_mixing(spark, corpus):
    df = frame(spark, corpus)
    got = mixing.mix(df).collect()
    assert len(got) == len(corpus)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, mixing.mix(df.repartition(7)).collect())))
    source = {i: s for i, _, _, s in corpus}
    sizes = collections.Counter()
    for i, t, _, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    target, taken = water_level(sizes), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK + 1 for s in sizes)
    made = mixing.mixed_documents(df).collect()
    words = collections.Counter()
    for r in made:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r.text
    assert +words == +sum((collections.Counter({r.doc_id: r.taken}) for r in got), collections.Counter())
    assert mixing.mix(df.where("doc_id = -1")).collect() == [] == mixing.mixed_documents(df.where("doc_id = -1")).collect()


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("s"))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_licenses(spark, sf, corpus):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    rows = [(1, f"words before\n{mit.upper()}\nafter", "a", "s"), (2, "Released under the\nMIT license", "a", "s"), (3, "released under a MIT license", "a", "s"), (4, None, "a", "s"), (5, "", "a", "s"), (2, "Released under the\nMIT license", "a", "s")]
    got = licenses.scan(frame(spark, rows + corpus)).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == [(1, "mit-text", 1.0), (2, "mit", 1.0)]
    for _, text in licenses.TEMPLATES:
        parts, anchors = licenses.template_shingles(text), licenses.anchor_words(text)
        free = [s for s in parts if not set(s.split()) & set(anchors)]
        assert len(free) < licenses.THRESHOLD * len(parts)
    assert_same(licenses.op2_license_scans(spark, sf), connect(sf), licenses.ORACLE)
