"""URL filters with redirect equivalence, by DataFrame operations alone.

A URL's node is its host, path and query as RFC 3986 makes equivalent URLs the same:
host in lower case, an empty path is ``/``, dot segments are removed; scheme and
fragment do not tell pages apart.  Edges join a page with the targets of its canonical
links and of its meta refresh redirects, resolved against the page's URL or its
``base`` by RFC 3986, section 5.2.  References of a scheme without ``//`` (mailto,
javascript) are no edges.  Tags inside comments, scripts, styles, templates and other raw
text are none.  Of character references in an attribute ``&amp;`` is decoded.
Connected components of these edges are aliases of one page.

A rule fits its host and all subdomains where the path starts with the rule's; the
longest fitting rule decides (ties: allow, then order of rule).  A URL that no
rule fits takes its component's verdict: allow if any alias is allowed by a rule,
else block if any is blocked by one, else allow.

Defined results: null URLs and those without ``://`` have empty host and path, fit
no rule, belong to no component and are allowed.  Null html has no links.  Rows
with equal URLs are aliases; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import columns_of, components, let, table

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule(BLOCK, "com", "/en/"), Rule(ALLOW, "example.com", "/en/7"), Rule(ALLOW, "net", "/de/"), Rule(BLOCK, "example.net", "/de/8"), Rule(BLOCK, "org", "/es/"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_struct(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The deciding rule as ``(rule, verdict)``, null if none fits.

    Rules are one literal list in the plan: a few thousand are fine.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    every = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict, r))
    fits = None
    for r in every:
        hit = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits = F.when(hit, found) if fits is None else fits.when(hit, found)
    return fits


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


_RAW = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|title|textarea|template|noscript|iframe|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|\z)"
_ATTRIBUTE = r"""(?s)[^\s=/"'>]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, trimmed and without tabs and line ends; null if it has none."""
    found = F.get(F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 0), lambda x: x.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    value = F.regexp_replace(F.regexp_replace(found, r"(?s)^[^=]*=\s*", ""), r"""(?s)^["']|["']$|[\t\r\n]""", "")
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")))


def link_targets(html: Column) -> Column:
    """``(base, targets)`` of a page: its first base, and hrefs of canonical links and URLs of meta refreshes, as written."""
    markup = F.regexp_replace(html, _RAW, " ")
    tags = lambda name, has: F.filter(F.regexp_extract_all(markup, F.lit(rf"""(?is)<{name}\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), 0), has)
    links = F.transform(tags("link", lambda t: attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: attribute(t, "href"))
    metas = F.transform(tags("meta", lambda t: attribute(t, "http-equiv").rlike(r"(?i)^refresh$")), lambda t: F.trim(F.regexp_extract(attribute(t, "content"), r"""(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)))
    bases = F.transform(tags("base", lambda t: attribute(t, "href").isNotNull()), lambda t: attribute(t, "href"))
    return F.struct(F.get(bases, F.lit(0)).alias("base"), F.filter(F.concat(links, metas), lambda u: u != "").alias("targets"))


def plain_path(path: Column) -> Column:
    """A path without dot segments (RFC 3986, 5.2.4); the empty one is ``/``."""

    def of(parts: Column) -> Column:
        def step(done: Column, part: Column) -> Column:
            return F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(ended, "/"))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(parts, of)).when(path == "", F.lit("/")).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The absolute URL that a reference means beside the absolute URL ``base`` (RFC 3986, 5.2.2); null if it has no host."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    path, query = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    own = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    return (
        F.when(own != "", F.when(F.substring(target, F.length(own) + 2, F.lit(2)) == "//", target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(path == "", F.concat(origin, path_of(base), F.when(query == "", query_of(base)).otherwise(query)))
        .when(path.startswith("/"), F.concat(origin, path, query))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), path, query))
    )


def node_of(url: Column) -> Column:
    """``(host, path, node)`` of an absolute URL, the path without dot segments."""
    path = plain_path(path_of(url))
    return let(path, lambda p: F.struct(host_of(url).alias("h"), p.alias("q"), F.concat(host_of(url), p, query_of(url)).alias("node")))


def filtered(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url, html)``."""
    p = columns_of(pages, "page_id", "url", "html")
    linked = p.where("html is not null and instr(url, '://') > 0").where(F.expr(r"html rlike '(?i)canonical|refresh'"))
    links = linked.select("url", link_targets(F.col("html")).alias("x")).where("size(x.targets) > 0")
    links = links.select("url", F.coalesce(resolved(F.col("x.base"), F.col("url")), "url").alias("base"), F.explode("x.targets").alias("target"))
    links = links.select(node_of(F.col("url")).alias("a"), resolved(F.col("target"), F.col("base")).alias("to"))
    links = table(links.select("a", node_of(F.col("to")).alias("b")).where("a.h <> '' and b.h <> ''"), "url-links")
    comp = components(links.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "url-cc")
    # Explicit decisions of all aliases, pages or not, by component.
    ends = links.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").distinct()
    said = ends.select("node", rule_struct(F.col("h"), F.col("q"), rules)["verdict"].alias("v")).where("v is not null")
    # 'allow' sorts before 'block': the least explicit verdict is the one with precedence.
    by_comp = comp.join(said, "node").groupBy("comp").agg(F.min("v").alias("alias_verdict"))
    aliases = table(comp.join(by_comp, "comp").select("node", "alias_verdict"), "url-alias")

    out = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url"))["node"].alias("node"))
    out = out.withColumn("r", rule_struct(F.col("host"), F.col("path"), rules)).withColumn("node", F.when(F.col("host") != "", F.col("node")))
    own = out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), "node")
    own = own.join(aliases, "node", "left")
    return own.select("page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit(ALLOW)).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_rule(host: str, path: str, what: str) -> str:
    every = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.verdict, r))
    whens = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.host + r.path if what == 'rule' else r.verdict}'" for r in every)
    return f"CASE {whens} ELSE NULL END"


_SQL_HOST = lambda u: f"COALESCE(translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '')"
_SQL_PATH = lambda u: f"COALESCE(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_SQL_ATTRIBUTE = lambda t, name: rf"""regexp_extract({t}, '^<\w+(?:[^>"'']|"[^"]*"|''[^'']*'')*?[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is')"""
_SQL_VALUE = lambda t, name: f"replace(trim(regexp_replace(trim({_SQL_ATTRIBUTE(t, name)}, chr(34) || chr(39)), '[\\t\\r\\n]', '', 'g')), '&amp;', '&')"
#: The five parts of a URI reference, by the expression of RFC 3986, appendix B.
_SQL_PARTS = lambda u: f"regexp_extract({u}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?', ['scheme', 'host', 'path', 'query'], 's')"
_SQL_PLAIN = lambda path: rf"""CASE WHEN {path} = '' THEN '/' ELSE '/' || array_to_string(list_reduce(
    list_transform(split(substr({path}, 2), '/') || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN [''] ELSE [] END, lambda x: [x]),
    lambda done, x: CASE x[1] WHEN '.' THEN done WHEN '..' THEN done[:-2] ELSE done || x END, CAST([] AS VARCHAR[])), '/') END"""  # noqa: E731
_RAW_TAGS = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\b[^>]*>|\z)" for t in "script style title textarea template noscript iframe xmp".split())

ORACLE = rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(?:--!?>|\z)|{_RAW_TAGS}', ' ', 'gis'), '<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>', 0, 'is')) AS tag
  FROM (SELECT DISTINCT url, html FROM pages WHERE contains(url, '://'))
), refs AS (
  SELECT url, CASE WHEN regexp_matches(tag, '^<link\b', 'i') AND list_contains(regexp_split_to_array(lower({_SQL_VALUE("tag", "rel")}), '\s+'), 'canonical') THEN {_SQL_VALUE("tag", "href")}
    WHEN regexp_matches(tag, '^<meta\b', 'i') AND lower({_SQL_VALUE("tag", "http-equiv")}) = 'refresh'
      THEN trim(regexp_extract({_SQL_VALUE("tag", "content")}, '^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1, 'is')) END AS ref FROM tags
), parts AS (
  SELECT url, {_SQL_PARTS("ref")} AS r, {_SQL_HOST("url")} AS h, {_SQL_PATH("url")} AS p, {_SQL_PARTS("url")}.query AS q, ref FROM refs WHERE ref <> ''
), met AS (
  SELECT h AS h1, p AS p1, q AS q1, r.query AS rq, r.path AS rp,
    CASE WHEN r.scheme <> '' OR r.host <> '' THEN lower(r.host) ELSE h END AS h2,
    CASE WHEN r.scheme <> '' OR r.host <> '' OR starts_with(r.path, '/') THEN r.path WHEN r.path = '' THEN p
      ELSE COALESCE(NULLIF(regexp_extract(p, '^.*/', 0, 's'), ''), '/') || r.path END AS p2,
    CASE WHEN r.path = '' AND r.query = '' AND r.host = '' THEN q ELSE r.query END AS q2 FROM parts
), links AS (
  SELECT h1, {_SQL_PLAIN("p1")} AS p1, q1, h2, {_SQL_PLAIN("p2")} AS p2, q2 FROM met WHERE h1 <> '' AND h2 <> ''
), ends AS (
  SELECT h1 AS h, p1 AS p, h1 || p1 || q1 AS n, h2, p2, h2 || p2 || q2 AS n2 FROM links UNION SELECT h2, p2, h2 || p2 || q2, h1, p1, h1 || p1 || q1 FROM links
), reach AS (
  SELECT n AS node, n AS seen, h, p FROM ends UNION SELECT r.node, e.n2, e.h2, e.p2 FROM reach r JOIN ends e ON e.n = r.seen
), alias AS (
  SELECT node, MIN({_sql_rule("h", "p", "verdict")}) AS v FROM reach GROUP BY node
), own AS (
  SELECT page_id, {_SQL_HOST("url")} AS host, {_SQL_PATH("url")} AS path, COALESCE(regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's'), '') AS q FROM pages
)
SELECT page_id, host, path, {_sql_rule("host", "path", "rule")} AS rule,
  COALESCE({_sql_rule("host", "path", "verdict")}, alias.v, 'allow') AS verdict
FROM own LEFT JOIN alias ON host <> '' AND alias.node = host || ({_SQL_PLAIN("path")}) || q
"""
