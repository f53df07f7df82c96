"""Admission of addresses, audits and crawl state."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first check that holds, null if none does; an undecided check doesn't hold."""
    out = F.lit(None).cast("string")
    for name, test in reversed(checks):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def scope_col(url: Column, base_domain: Column, allowed_subdomains: Column | None = None, allowed_paths: Column | None = None) -> Column:
    """In scope: an allowed host exactly as it is written, or without such a list the base domain
    and what lies below it; and one of the allowed path starts, if there are any."""
    netloc, path = urls.netloc_col(url), urls.path_col(url)
    host = urls.in_domain_col(url, base_domain)
    if allowed_subdomains is not None:
        host = F.when(F.size(allowed_subdomains) > 0, F.array_contains(allowed_subdomains, netloc)).otherwise(host)
    if allowed_paths is not None:
        host = host & ((F.size(allowed_paths) == 0) | F.exists(allowed_paths, lambda p: path.startswith(p)))
    return host


SCOPE = "allowed_subdomains array<string>, allowed_paths array<string>, outside_depth int, max_depth int, lang string"


def scopes_of(tenants: DataFrame, config: str = "config") -> DataFrame:
    """Tenants with ``scope``, read from their JSON settings; missing settings and unreadable ones
    give empty lists and no hop outside."""
    raw = F.from_json(F.col(config), SCOPE)
    none = F.array().cast("array<string>")
    return tenants.withColumn("scope", F.struct(F.coalesce(raw["allowed_subdomains"], none).alias("allowed_subdomains"), F.coalesce(raw["allowed_paths"], none).alias("allowed_paths"), F.coalesce(raw["outside_depth"], F.lit(0)).alias("outside_depth"), raw["max_depth"].alias("max_depth")))


def patched_config_col(config: Column, patch: dict[str, str]) -> Column:
    """JSON settings of plain values with some of them set; null counts as no settings."""
    old = F.coalesce(F.from_json(config, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*patch))
    return F.to_json(F.map_concat(kept, F.create_map(*[F.lit(x) for kv in sorted(patch.items()) for x in kv])))


def seed_urls(scopes: DataFrame) -> DataFrame:
    """``url``: every host with every path of a scope (``hosts``, ``paths``), https, without repeats."""
    paths = F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("/")))
    return scopes.select(F.explode("hosts").alias("host"), paths.alias("paths")).select("host", F.explode("paths").alias("path")).select(F.concat(F.lit("https://"), "host", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))).alias("url")).distinct()


# --- robots and sitemaps


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """``domain, allow, prefix`` of the groups for ``agent`` (or ``*``), of answers below 400.

    A domain with a failed fetch has no rule, so all is allowed there.
    """
    kind = T.ArrayType(T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("prefix", T.StringType())]))

    def one(body: str | None) -> list[dict]:
        groups: dict[str, list] = {}
        names, open_group = [], False
        for line in (body or "").splitlines():
            key, _, value = line.partition("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent":
                names = [*names, value.lower()] if open_group else [value.lower()]
                open_group = True
            elif key in ("allow", "disallow"):
                open_group = False
                if value:
                    for n in names:
                        groups.setdefault(n, []).append({"allow": key == "allow", "prefix": value})
        return groups.get(agent.lower(), groups.get("*", []))

    @F.pandas_udf(kind)
    def rules(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return robots.where(F.col("status") < 400).select("domain", F.explode(rules("body")).alias("r")).select("domain", "r.allow", "r.prefix").distinct()


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages with ``allowed``: the longest rule that the path starts with decides, of equal ones the
    permission; without a rule it is allowed.  Rules are a few a domain; pages are joined by domain."""
    keyed = pages.withColumn("__host", urls.host_col(F.col(url))).withColumn("__path", urls.path_col(F.col(url)))
    per = rules.groupBy(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("__host")).agg(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("__rules"))
    hit = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["prefix"])))
    return keyed.join(per, "__host", "left").withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("__host", "__path", "__rules")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``domain, sitemap``: the robots files' sitemap lines, else the usual place."""
    named = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    listed = F.when((F.col("status") < 400) & (F.size(named) > 0), named).otherwise(F.array(F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml"))))
    return robots.select("domain", F.posexplode(listed).alias("ord", "sitemap"))


def sitemap_urls(starts: DataFrame, sitemaps: DataFrame, max_depth: int = 3) -> DataFrame:
    """``url, ord``: pages listed by the start sitemaps, through indexes up to ``max_depth`` deep, each
    once at its first place.  ``sitemaps``: fetched files as ``url, status, xml``."""
    files = sitemaps.where("status < 400 AND xml IS NOT NULL").select(F.col("url").alias("__file"), F.expr(r"xpath(xml, '//*[local-name()=\"loc\"]/text()')").alias("locs"), F.contains(F.lower("xml"), F.lit("<sitemapindex")).alias("index"))
    level = starts.select(F.col("sitemap").alias("at"), F.array(F.col("ord").cast("int")).alias("way"))
    found = None
    for _ in range(max_depth + 1):
        opened = level.join(files, F.col("at") == F.col("__file")).select("way", "index", F.posexplode("locs").alias("n", "loc")).select("index", F.concat("way", F.array("n")).alias("way"), F.trim("loc").alias("loc"))
        pages = opened.where("NOT index").select(F.col("loc").alias("url"), "way")
        found = pages if found is None else found.unionByName(pages)
        level = opened.where("index").select(F.col("loc").alias("at"), "way")
    return found.groupBy("url").agg(F.min("way").alias("ord"))


def admissible_links(links: DataFrame, link: str, domain: Column) -> DataFrame:
    """The links with ``target``: in canonical form, below the page's domain, without skipped
    endings; links that become equal stay apart."""
    kept = links.withColumn("target", urls.canonical_url_col(F.col(link))).where(F.col("target").isNotNull())
    return kept.where(urls.in_domain_col(F.col("target"), domain) & ~urls.skipped_url_col(F.col("target")))


def persisted(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """``url`` of the pages that are stored: with html that isn't blank, or as the source of a redirect."""
    whole = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?U)\S")).select("url")
    return whole.unionByName(redirects.select(F.col("source").alias("url"))).distinct()


# --- audits


def status_scan(records: DataFrame, status: int) -> tuple[DataFrame, DataFrame]:
    """(``url, depth`` of the records with that status, the smallest depth a url; one row of counts)."""
    match = records.where((F.col("status_code") == status) & F.col("normalized_url").isNotNull()).groupBy(F.col("normalized_url").alias("url")).agg(F.min("depth").alias("depth"))
    counts = records.agg(F.count("*").alias("scanned"), F.count_if(F.col("normalized_url").isNull() | F.col("status_code").isNull()).alias("corrupt"))
    return match, counts


def requeue(matches: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the queue with the matches it lacks, one row: requeued, already_queued, deleted)."""
    queued = queue.select("url").distinct().withColumn("__queued", F.lit(True))
    marked = matches.join(queued, "url", "left")
    added = marked.where("__queued IS NULL").select("url", "depth")
    counts = marked.agg(F.count_if(F.col("__queued").isNull()).alias("requeued"), F.count_if(F.col("__queued")).alias("already_queued"), F.count("*").alias("deleted"))
    return queue.select("url", "depth").unionByName(added), counts


def purge(records: DataFrame, matches: DataFrame, key: str = "normalized_url") -> tuple[DataFrame, DataFrame]:
    """(the records left, the records removed) where those of the matched addresses go."""
    gone = matches.select(F.col("url").alias(key)).distinct()
    return records.join(gone, key, "left_anti"), records.join(gone, key, "left_semi")


def domain_roots(entries: DataFrame, order: str) -> DataFrame:
    """``slug, root``: of each first path segment the root of its earliest entry."""
    url = F.coalesce("final_url", "url")
    keyed = entries.select(urls.first_segment_col(url).alias("slug"), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1).alias("origin"), F.col(order).alias("o"), url.alias("u")).where("origin <> ''")
    return keyed.groupBy("slug").agg(F.min_by("origin", F.struct("o", "u")).alias("origin")).select("slug", F.concat("origin", F.lit("/"), "slug").alias("root"))


def checkpoint_state(checkpoints: DataFrame, root: str) -> DataFrame:
    """Frontier checkpoints with ``state``: ``ok``, ``corrupt`` (a field is missing or of another
    type) or ``incompatible-root-url``."""
    whole = F.col("root_url").isNotNull() & F.col("queue").isNotNull() & F.col("visited").isNotNull() & (F.col("pages_saved") >= 0) & (F.col("pages_skipped") >= 0) & (F.col("errors") >= 0) & ~F.exists("queue", lambda q: q["url"].isNull() | q["depth"].isNull() | (q["depth"] < 0)) & ~F.exists("visited", lambda v: v.isNull())
    return checkpoints.withColumn("state", F.when(~F.coalesce(whole, F.lit(False)), "corrupt").when(F.col("root_url") != root, "incompatible-root-url").otherwise("ok"))


def worth_retrying(fetches: DataFrame) -> DataFrame:
    """Fetches that are tried again: status 202, an html content type, a blank body."""
    return fetches.where((F.col("status_code") == 202) & F.coalesce(F.contains(F.lower("content_type"), F.lit("html")), F.lit(False)) & ~F.coalesce("html", F.lit("")).rlike(r"(?U)\S"))


