"""URL filters (operator 1): block decisions follow redirects and canonical links, explicit allows stand.

URLs are nodes; a canonical link or a refresh redirect of a page is an edge. A URL is judged by the
longest rule that fits. Connected components over the edges make aliases of each other: a page
without a rule of its own is blocked if any alias is blocked by a rule, else allowed. A page's own
rule, allow or block, always stands before what its aliases say.

Scale: rules are a short list and become one expression; only pages that carry an edge enter the
graph; components run as joins and aggregates on the executors (``components``).

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and is allowed;
null html has no edge, and a page has an edge for each link it holds; repeated rows are judged alike; edges to pages that are not in the table
count (their rule does, too); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table
from .components import components

#: verdict, rule: a host, then the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A longer list of rules would need a join in place of one expression.
MAX_RULES = 500

#: What a browser reads no links in: comments (to the end, if unclosed), scripts, styles.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
#: A link or meta tag; a ">" within quotes does not end it, unless its quotes don't match.
TAG = r"(?is)<(?:link|meta)\b(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
# Entities that occur in addresses.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _first(text: Column, pattern: str) -> Column:
    """The first group of ``pattern`` that holds anything."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in (1, 2, 3)], F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    return _first(tag, rf"(?is)(?<![\w-]){name}{VALUE}")


def decoded(text: Column) -> Column:
    """Text of an attribute: numbered entities of any code point, and those in ``ENTITIES``."""
    code = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.regexp_extract(e, "(?i)&#x([0-9a-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "&#([0-9]+);", 1)).cast("int")
    sign = lambda e: F.when((code(e) > 0) & (code(e) < 0xD800), F.decode(F.unhex(F.lpad(F.hex(code(e).cast("long")), 8, "0")), "UTF-32")).otherwise(e)
    numbered = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    out = F.aggregate(numbered, text, lambda acc, e: F.replace(acc, e, sign(e)))
    for entity, plain in ENTITIES.items():  # the sign that begins them all is last
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def targets_of(html: Column) -> Column:
    """All addresses that a page names as its canonical one or sends readers on to, as they are written."""

    def target(tag):
        rel, equiv = F.split(F.lower(F.trim(attribute(tag, "rel"))), r"\s+"), F.lower(F.trim(attribute(tag, "http-equiv")))
        there = _first(decoded(attribute(tag, "content")), rf"(?is)(?<![\w-])url{VALUE}")
        return F.when(tag.rlike("(?i)^<link") & F.array_contains(rel, "canonical"), decoded(attribute(tag, "href"))).when(tag.rlike("(?i)^<meta") & (equiv == "refresh"), there)

    tags = F.regexp_extract_all(F.regexp_replace(html, UNSEEN, " "), F.lit(TAG), F.lit(0))
    return F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (F.trim(t) != ""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (verdict, rule), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as seen from the page ``base``: absolute, scheme-relative, root-relative or relative."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(site, path_of(base)), r"(?s)^(.*?://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(folder, target))
    )


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) URLs: canonical links and refresh redirects found in pages."""
    url, html = F.col(url_col), F.col(html_col)
    hints = F.lower(html)
    found = pages.where(url.contains("://") & (hints.contains("canonical") | hints.contains("refresh")))
    both = found.select(url.alias("src"), F.explode(F.array_distinct(targets_of(html))).alias("dst"))
    return both.select("src", _resolved(F.col("src"), F.trim("dst")).alias("dst")).where("src <> dst")


def node(url: Column) -> Column:
    """A node for a URL: the scheme and the fragment make no difference."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.xxhash64(host_of(url), path_of(url), query)


def judge(pages: DataFrame, edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict for each page. ``edges`` (src, dst) add to those in the pages."""
    found = alias_edges(pages, url_col=url_col, html_col=html_col)
    found = materialise(found if edges is None else found.unionByName(edges.select("src", "dst")), "aliases")
    ends = found.select(F.explode(F.array("src", "dst")).alias("url"))
    blocked = ends.where(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block").select(node(F.col("url")).alias("u")).distinct()
    root = components(found.select(node(F.col("src")).alias("u"), node(F.col("dst")).alias("v")))
    bad = blocked.join(root, "u", "left").select(F.coalesce("root", "u").alias("root")).distinct()
    # every node of a component that holds a blocked one, the smallest node included
    bad = root.join(bad, "root", "left_semi").select("u").union(bad.select(F.col("root").alias("u")))
    url = F.col(url_col)
    own = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node(url)).alias("u"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    out = own.join(bad.distinct().withColumn("bad", F.lit(True)), "u", "left")
    return out.select(id_col, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))


def op1_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: The same in DuckDB: rules, edges and reachability by a recursive query.
ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:[^#?]*)(\?[^#]*)', 1), '') AS query
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own,
         host || chr(0) || path || chr(0) || query AS node FROM r),
e AS (SELECT a.node AS s, b.node AS d FROM v a JOIN v b ON b.url = regexp_extract(a.html, '(?i)<link rel="canonical" href="([^"]*)"', 1) WHERE a.html ILIKE '%canonical%'),
both_ways AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
bad AS (SELECT DISTINCT node FROM v WHERE own = 'block' UNION SELECT b.d FROM bad JOIN both_ways b ON b.s = bad.node)
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' END, 'allow') AS verdict
FROM v
"""
