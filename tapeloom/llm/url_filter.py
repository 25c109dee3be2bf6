"""URL filters with redirect equivalence.

Rules of a host (it and all its subdomains) and a path prefix allow or block; the longest rule that
fits wins. Pages no rule fits take the method's verdict: canonical-link and redirect edges found in
the pages' markup join URLs into connected components; a component with a blocked URL blocks its
members, unless it also has an explicitly allowed one. A page's own rule always stands.

Nodes are URLs without scheme and fragment, host lower-cased; pages with the same node are one.
Cases: a null url, or one without ``://``, has empty host and path and no node, so it is allowed;
null html has no edges; targets that can't be resolved are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.components import components

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Ties: allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def targets(html: Column) -> Column:
    """Targets of a page's canonical links and redirects, as written (array)."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b") & t.rlike(r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b") & t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
    href = lambda t: F.concat(*(F.regexp_extract(t, r"(?is)\bhref" + value, i) for i in (1, 2, 3)))
    goal = lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)""", 1)
    found = F.concat(F.transform(canonical, href), F.transform(refresh, goal))
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def resolved(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:[^?#]*/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
        .when(~target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component."""
    rules = RULES if rules is None else rules
    url = F.col("url")
    seen = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"),
        F.transform(targets(F.col("html")), lambda t: node_of(resolved(t, url))).alias("to"),
    ).withColumn("own", by_rule(F.col("host"), F.col("path"), rules))
    seen = shared.materialize(seen)
    edges = seen.filter("node is not null").select(F.col("node").alias("a"), F.explode("to").alias("b")).filter("b is not null and a != b")
    member = shared.small(components(edges))
    part = F.coalesce(F.col("component"), F.col("node"))
    seeds = seen.filter("own is not null and node is not null").select("node", F.col("own.verdict").alias("v")).distinct()
    # a rule's verdict on URLs that only appear as targets counts too
    other = edges.select(F.col("b").alias("node")).distinct().withColumn("url", F.concat(F.lit("x://"), F.col("node")))
    other = other.select("node", by_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")).filter("v is not null")
    # a page alone in its component has its own rule's verdict already
    blocked = seeds.unionByName(other).join(member, "node").groupBy("component").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow"))
    blocked = shared.small(shared.materialize(blocked.filter("block and not allow").select("component", F.lit("block").alias("alias"))))
    out = seen.join(member, "node", "left").withColumn("component", part).join(blocked, "component", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict"), "component")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RULE_SQL = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)
#: For pages without canonical or redirect markup each node is a component.
SQL = rf"""
WITH rules AS ({_RULE_SQL}),
u AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS host0,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS rest
  FROM pages),
n AS (SELECT page_id, translate(host0, '{_UPPER}', '{_LOWER}') AS host, path,
    translate(host0, '{_UPPER}', '{_LOWER}') || CASE WHEN rest = '' THEN '/' ELSE rest END AS node FROM u),
own AS (
  SELECT n.*, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS v FROM n),
seeds AS (SELECT node FROM own WHERE v IS NOT NULL GROUP BY node HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow'))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN node IN (SELECT node FROM seeds) THEN 'block' ELSE 'allow' END) AS verdict, node AS component FROM own
"""
