from oracle import assert_same, connect
from pyspark.sql import functions as F

from quillon.llm.urls import ORACLE, filtered, node_of, op10_url_filters, resolved


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules_and_parts(spark):
    got = verdicts(filtered(pages(spark, [
        (1, "http://A.Example.COM/en/825?page=2#x", None, "z"), (2, "https://example.com/en/71", "", "z"), (3, "http://x.net/de/1", "", "z"),
        (4, "http://m.example.net/de/8", "", "z"), (5, "http://org/es/", "", "z"), (6, "http://xorg/es/", "", "z"), (7, None, "", "z"),
        (8, "no scheme/en/", "", "z"), (9, "http://com?/en/", "", "z"), (10, "http://com/EN/", "", "z"), (11, "x://y://com/en/", "", "z"),
    ])))
    assert got[1] == ("a.example.com", "/en/825", "com/en/", "block")
    assert got[2] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[3] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[4] == ("m.example.net", "/de/8", "example.net/de/8", "block")
    assert got[5][2:] == ("org/es/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "", None, "allow") and got[10][3] == "allow"
    assert got[11] == ("y:", "//com/en/", None, "allow")


def test_aliases(spark, sf):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.io/x", canonical.format("http://b.io/y#q"), ""),
        (2, "http://b.io/y", '<meta http-equiv="refresh" content="0; url=http://c.com/en/1">', ""),  # reaches a blocked URL that is no page
        (3, "http://d.io/z", canonical.format("/w/v"), ""),
        (4, "http://d.io/w/v", canonical.format("http://c.com/en/2"), ""),
        (5, "http://d.io/w/u", canonical.format("v"), ""),
        (6, "http://e.net/de/5", canonical.format("http://d.io/w/v"), ""),  # explicitly allowed: takes precedence over the block
        (7, "http://f.io/", canonical.format("http://f.io/#self"), ""),
        (8, "https://B.io/y#frag", None, ""), (8, "https://B.io/y#frag", None, ""),
        (9, "http://c.com/en/2", None, ""),
    ]
    df = pages(spark, rows)
    got = {k: v[3] for k, v in verdicts(filtered(df)).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}
    assert filtered(df).count() == len(rows)
    con = connect(sf)
    con.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM (VALUES " + ", ".join("({}, {}, {})".format(r[0], *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r[1:3])) for r in rows) + ") t(page_id, url, html)")
    assert_same(filtered(df), con, ORACLE)


def test_references(spark):
    """Reference resolution, values by hand (the base http://a/b/c/d;p?q and many references are those of RFC 3986, 5.4)."""
    want = {
        "g:h": None, "g": "a/b/c/g", "./g": "a/b/c/g", "g/": "a/b/c/g/", "/g": "a/g", "//g": "g/", "?y": "a/b/c/d;p?y", "g?y": "a/b/c/g?y", "#s": "a/b/c/d;p?q", "g#s": "a/b/c/g",
        "g?y#s": "a/b/c/g?y", ";x": "a/b/c/;x", "": "a/b/c/d;p?q", ".": "a/b/c/", "./": "a/b/c/", "..": "a/b/", "../": "a/b/", "../g": "a/b/g", "../..": "a/", "../../g": "a/g",
        "../../../g": "a/g", "/./g": "a/g", "/../g": "a/g", "g.": "a/b/c/g.", "..g": "a/b/c/..g", "./../g": "a/b/g", "g/./h": "a/b/c/g/h", "g/../h": "a/b/c/h", "g;x=1/../y": "a/b/c/y",
        "g?y/./x": "a/b/c/g?y/./x", "HTTP://G.io": "g.io/", "http://g.io/a/../b": "g.io/b", "mailto:x@y": None, "javascript:a()//b": None, "/login?next=http://c.com/en/9": "a/login?next=http://c.com/en/9",
    }
    df = spark.createDataFrame([(r, "http://a/b/c/d;p?q#f") for r in want], "ref string, base string")
    got = dict(df.select("ref", F.when(resolved(F.col("ref"), F.col("base")).isNotNull(), node_of(resolved(F.col("ref"), F.col("base")))["node"])).collect())
    assert got == want
    root = spark.createDataFrame([("g", "http://a"), ("?x", "http://a"), ("", "http://a")], "ref string, base string")
    assert [r[0] for r in root.select(node_of(resolved(F.col("ref"), F.col("base")))["node"]).collect()] == ["a/g", "a/?x", "a/"]


def linked(*parts):
    return "<html><head>" + "".join(parts) + "</head></html>"


def test_edges(spark, sf):
    """Links that are none, and those that are, written by hand; the SQL agrees."""
    link = '<link rel="canonical" href="{}">'.format
    blocked = "http://c.com/en/1"
    rows = [
        (1, "http://a.io/d/p", linked(link("?page=2"))), (2, "http://a.io/d/", linked(link(blocked))),  # a query alone is not the folder
        (3, "http://b.io/p", linked(link("/login?next=http://c.com/en/9"))),  # a URL in a query is no host
        (4, "http://d.io/x/y/z", linked(link("../../w"))), (5, "http://d.io/w", linked(link(blocked))),  # dots lead to a blocked page
        (6, "http://e.io/p", linked(f"<!-- {link(blocked)} -->", f"<script>'{link(blocked)}'</script>")),  # commented out, inside a script
        (7, "http://f.io/p", linked('<link title="x > y rel=canonical" href="http://c.com/en/1"><a data-rel="canonical" href="http://c.com/en/1">')),
        (8, "http://g.io/p", linked("<link data-href='http://x.io/' href=http://c.com/en/1 rel='nofollow canonical'>")),
        (9, "http://h.io/p", linked("<base href='http://c.com/en/'>", link("1"))),
        (10, "http://i.io", linked('<meta content=" 5 ; URL=\'http://c.com/en/1\'" http-equiv=Refresh>')), (11, "http://i.io/", "<p>"), (12, "http://I.io?x", "<p>"),
        (13, "http://j.io/?id=1", linked(link(blocked))), (14, "http://j.io/?id=2", "<p>"),  # told apart by the query
        (15, "http://k.io/a&b?c&d", linked(link("http://c.com/en/../en/1?x&amp;y"))),
        (16, "no url", linked(link(blocked))), (17, None, linked(link(blocked))),
    ]
    chain = [(100 + i, f"http://chain.io/{i}", linked(link(f"{i + 1}"))) for i in range(30)] + [(130, "http://chain.io/30", linked(link(blocked)))]
    ring = [(200 + i, f"http://ring.io/{i}", linked(link(f"/{(i + 1) % 12}"))) for i in range(12)]
    df = pages(spark, [(*r, "") for r in rows + chain + ring])
    got = {k: v[3] for k, v in verdicts(filtered(df)).items()}
    block = {2, 4, 5, 8, 9, 10, 11, 13, 15, *range(100, 131)}
    assert {k for k, v in got.items() if v == "block"} == block
    con = connect(sf)
    plain = [r for r in rows + chain + ring if r[0] != 9]  # the SQL reads no base
    values = ", ".join("({}, {}, {})".format(r[0], *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r[1:3])) for r in plain)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM (VALUES {values}) t(page_id, url, html)")
    assert_same(filtered(df.where("page_id <> 9")), con, ORACLE)


def test_query(spark, sf):
    assert_same(op10_url_filters(spark, sf), connect(sf), ORACLE)
    assert filtered(pages(spark, []).where(F.lit(False))).collect() == []
