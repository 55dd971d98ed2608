"""URL filters with redirect equivalence, in DataFrame operations only.

A page's own rule decides where one fits. Pages without a rule take the verdict of their aliases: redirects
(``meta refresh``, or a table of redirects) and canonical links join urls, connected components of these
links are groups of aliases, and within a group an explicit allow goes before any block. A page that
neither a rule nor an alias decides is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm.common import cut
from kinmark.llm.graph import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null or where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What two urls of one resource share: host, path and query, without scheme, fragment and last slash."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(rest, "/$", "")))


#: A name and its value. Attributes are read one after the other, so nothing inside a quoted value is taken for one.
ATTRIBUTE = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` (any case) of a tag, without its quotes; null where there is none."""
    found = F.filter(
        F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name
    )
    value = F.regexp_replace(F.get(found, F.lit(0)), r"^[^=]*=\s*", "")
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def alias_targets(url: Column, html: Column) -> Column:
    """Absolute urls that a page names as itself: canonical links and refreshes. A tag ends at its first ``>``."""
    links = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)),
        lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"),
    )
    refreshes = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)),
        lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh",
    )
    moved = F.transform(refreshes, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)[;,]\s*url\s*=\s*(.+)$", 1))
    found = F.concat(
        F.transform(links, lambda t: _attribute(t, "href")),
        F.transform(moved, lambda t: F.regexp_replace(t, r"^[\"']|[\"']\s*$", "")),
    )
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))

    def absolute(t: Column) -> Column:
        t = F.replace(F.trim(t), F.lit("&amp;"), F.lit("&"))
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(site, t))
            .when(t != "", F.concat(site, F.regexp_replace(path_of(url), "[^/]*$", ""), t))
        )

    return F.filter(F.transform(found, absolute), lambda t: t.isNotNull())


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """Rules as ``(rule_host, rule_path, rule_verdict)``; a long block list comes as a table ``(host, path, verdict)``."""
    if isinstance(rules, DataFrame):
        return rules.toDF("rule_host", "rule_path", "rule_verdict")
    rows = [(r.host, r.path, r.verdict) for r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")


def with_rule(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) plus ``rule`` and ``rule_verdict``: of the rules whose host is the
    url's or a parent of it and whose path begins the url's, the longest; of equals an allow.

    Rules meet distinct hosts first, over the hosts' own suffixes; their candidates are then joined to the
    urls by host, so a host with very many urls is one row until that join.
    """
    table = rule_table(urls.sparkSession, rules)
    hosts = urls.select("host").where("host <> ''").distinct()
    suffixes = hosts.select(
        "host",
        F.explode(
            F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 10000), '.'))")
        ).alias("rule_host"),
    )
    of_host = cut(
        suffixes.join(table, "rule_host")
        .groupBy(F.col("host").alias("__host"))
        .agg(
            F.collect_set(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("size"),
                    (F.col("rule_verdict") == "allow").alias("allow"),
                    F.col("rule_path").alias("path"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    "rule_verdict",
                )
            ).alias("__rules")
        )
    )
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return (
        urls.join(of_host, urls["host"] == of_host["__host"], "left")
        .withColumn("__best", best)
        .withColumns({"rule": F.col("__best.rule"), "rule_verdict": F.col("__best.rule_verdict")})
        .drop("__host", "__rules", "__best")
    )


def judge_pages(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)`` for every row of ``pages`` (``page_id, url, html``).

    ``redirects`` may add edges ``(src, dst)`` of urls. Null or malformed urls have empty host and path, no
    rule and no aliases, and are allowed. Null ``html`` has no links; a null in a rule fits nothing. Repeated
    rows stay and get one verdict; other columns are ignored; an empty table gives an empty result. A link to
    the page itself changes nothing. Html of any length is searched whole. Only pages that link take part in
    the component search.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = pages.select(
        node_of(F.col("url")).alias("src"), F.explode(alias_targets(F.col("url"), F.col("html"))).alias("target")
    ).select("src", node_of(F.col("target")).alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    groups = connected_components(edges.where("src is not null and dst is not null"))
    parts = groups.select(
        "node",
        "component",
        F.regexp_extract("node", r"(?s)^([^/?]*)", 1).alias("host"),
        F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1).alias("path"),
    )
    decided = cut(
        with_rule(parts, rules)
        .groupBy("component")
        .agg(
            F.max(F.col("rule_verdict") == "allow").alias("allows"),
            F.max(F.col("rule_verdict") == "block").alias("blocks"),
        )
        .where("allows or blocks")
        .select("component", F.when(F.col("allows"), "allow").otherwise("block").alias("alias_verdict"))
    )
    aliases = cut(groups.join(decided, "component").select(F.col("node").alias("__node"), "alias_verdict"))
    judged = with_rule(base.withColumn("__key", node_of(F.col("url"))), rules).join(
        aliases, F.col("__key") == F.col("__node"), "left"
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule")
        .when(F.col("alias_verdict").isNotNull(), "alias")
        .otherwise("default")
        .alias("decided_by"),
    )
