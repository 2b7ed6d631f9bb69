"""URL rules with redirect equivalence.

Rules match a host with all its subdomains and a path prefix; the longest wins.
Pages that redirect to each other or name the same canonical address form one
class (connected components over those links), and a class hands a block
decision to its members without a rule of their own unless a rule explicitly
allows one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upslope.operators.graph import connected_components
from upslope.scratch import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


PRODUCTION_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)",
)


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _AZ, _AZ.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """Identity of an address: host, path and query; scheme and fragment don't count. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    key = F.concat(url_host(url), F.when(url_path(url) == "", "/").otherwise(url_path(url)), query)
    return F.when(url_host(url) != "", key)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = PRODUCTION_RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null; between equally long ones allow wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) from each page to its canonical address and its refresh target, as ``url_key``s."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    targets = F.array(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in _CANONICAL))
    links = pages.where(html.rlike(r"(?i)canonical|refresh")).select(url.alias("u"), F.explode(targets).alias("t")).where("t is not null")
    t, u = F.col("t"), F.col("u")
    site = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*", 0)
    full = (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .otherwise(F.concat(site, F.regexp_replace(F.when(url_path(u) == "", "/").otherwise(url_path(u)), r"[^/]*$", ""), t))
    )
    return links.select(url_key(u).alias("src"), url_key(full).alias("dst"), u.alias("src_url"), full.alias("dst_url")).where("src is not null and dst is not null")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[UrlRule, ...] = PRODUCTION_RULES,
    extra_links: DataFrame | None = None,
) -> DataFrame:
    """Host, path, rule and verdict of every page.

    ``extra_links`` adds recorded redirects as (src_url, dst_url).  A page with a
    fitting rule follows it.  Any other page is blocked if its class holds an
    address that a rule blocks and none that a rule allows; else it is allowed.
    Linked addresses count even if no page has them, and so does every spelling of an
    address (with and without the slash after the host) among the links.

    A null url, or one without ``://``, has empty host and path, belongs to no
    class and is allowed; null html has no links; repeated urls share a class; a page that links to
    itself is alone in its class; other columns are left out; an empty table gives no rows.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), url_key(url).alias("__key"))
    judged = judged.withColumn("__own", rule_of(F.col("host"), F.col("path"), rules))
    links = page_links(pages, url_col, html_col).select("src", "dst", "src_url", "dst_url")
    if extra_links is not None:
        s, d = F.col("src_url"), F.col("dst_url")
        links = links.unionByName(extra_links.select(url_key(s).alias("src"), url_key(d).alias("dst"), "src_url", "dst_url"))
    links = materialize(links, "url-links")
    own, fallback = F.col("__own"), F.lit("allow")
    if links.limit(1).count():
        classes = connected_components(links)
        ends = links.select(F.col("src").alias("node"), F.col("src_url").alias("u")).union(links.select("dst", "dst_url"))
        decided = ends.select("node", rule_of(url_host(F.col("u")), url_path(F.col("u")), rules)["verdict"].alias("v"))
        decided = decided.where("v is not null").distinct()  # a node may have several spellings, of which a rule may fit some only
        by_class = (
            classes.join(decided, "node").groupBy("component")
            .agg(F.bool_or(F.col("v") == "block").alias("blocked"), F.bool_or(F.col("v") == "allow").alias("allowed"))
            .where("blocked and not coalesce(allowed, false)")
        )
        blocked = classes.join(by_class, "component").select(F.col("node").alias("__node"))
        judged = judged.join(blocked, F.col("__key") == F.col("__node"), "left")
        fallback = F.when(F.col("__node").isNotNull(), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", own["rule"].alias("rule"), F.coalesce(own["verdict"], fallback).alias("verdict"))
