"""Endpoints from stored pages: links, forms, scripts, script endpoints, sitemaps, robots files, recorded requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.catalog.fixed import JS_ENDPOINT_PATTERNS, ROBOTS_PATTERN, SITEMAP_PATTERN, SKIP_INPUT_TYPES, SKIP_LINK_PREFIXES
from wardlight.functions.cols import any_of, endpoint_key, endpoint_url, explode_once, host_of, query_pairs, resolve_url, url_part
from wardlight.operators.dedup import dedup_first_seen, first_by

ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
FORM = r"(?is)<form\b.*?</form>"
FIELD = r"(?i)<(?:input|textarea|select)\b[^>]*>"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"


def attribute(tag, name: str) -> Column:
    """Attribute value inside a tag text, empty when absent."""
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, target)``: same-host http(s) links, script, mail and fragment links left out."""
    a = explode_once(pages, ["page_id", "url"], F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)), "href")
    skip = any_of([F.startswith("href", F.lit(p)) for p in SKIP_LINK_PREFIXES])
    t = a.filter((F.col("href") != "") & ~skip).select("page_id", "url", resolve_url(F.col("url"), F.col("href")).alias("target"))
    return t.filter((host_of(F.col("target")) == host_of(F.col("url"))) & url_part(F.col("target"), "PROTOCOL").isin("http", "https"))


def page_forms(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, url, method, params)``: same-host forms with their named inputs (name, location, default)."""
    f = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(FORM), F.lit(0))).alias("pos", "form"))
    head = F.regexp_extract("form", r"(?is)^<form\b[^>]*>", 0)
    method = F.upper(F.when(attribute(head, "method") == "", "GET").otherwise(attribute(head, "method")))
    g = f.select("page_id", "pos", "page_url", "form", method.alias("method"), attribute(head, "action").alias("action"))
    g = g.withColumn("url", F.when(F.col("action") == "", F.col("page_url")).otherwise(resolve_url(F.col("page_url"), F.col("action"))))
    g = g.filter(host_of(F.col("url")) == host_of(F.col("page_url")))
    tags = F.filter(
        F.regexp_extract_all("form", F.lit(FIELD), F.lit(0)),
        lambda x: (attribute(x, "name") != "") & ~F.lower(attribute(x, "type")).isin(SKIP_INPUT_TYPES))
    where = F.when(F.col("method") == "POST", "body").otherwise("query")
    params = F.transform(tags, lambda x: F.struct(attribute(x, "name").alias("name"), where.alias("location"), attribute(x, "value").alias("default")))
    return g.select("page_id", "pos", "url", "method", params.alias("params"))


def page_scripts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, kind, value)``: inline script text and same-host script addresses."""
    s = explode_once(pages, ["page_id", "url"], F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(0)), "tag")
    head = F.regexp_extract("tag", r"(?is)^<script\b[^>]*>", 0)
    src = attribute(head, "src")
    inline = F.regexp_extract("tag", r"(?is)^<script\b[^>]*>(.*)</script>$", 1)
    k = s.select("page_id", "url", F.when(src != "", "src").otherwise("inline").alias("kind"),
                 F.when(src != "", resolve_url(F.col("url"), src)).otherwise(inline).alias("value"))
    return k.filter((F.col("value") != "") & ((F.col("kind") == "inline") | (host_of(F.col("value")) == host_of(F.col("url")))))


def js_endpoints(scripts: DataFrame) -> DataFrame:
    """``(page_id, url, endpoint)`` of same-host addresses in script text ``value``; all patterns in one pass."""
    all_hits = F.flatten(F.array(*[F.regexp_extract_all("value", F.lit("(?i)" + p), F.lit(1)) for p in JS_ENDPOINT_PATTERNS]))
    c = explode_once(scripts, ["page_id", "url"], F.array_distinct(F.transform(all_hits, lambda x: F.trim(x))), "c")
    c = c.filter(F.startswith("c", F.lit("/")) | F.startswith("c", F.lit("http")))
    full = c.select("page_id", "url", resolve_url(F.col("url"), F.col("c")).alias("endpoint"))
    return full.filter(host_of(F.col("endpoint")) == host_of(F.col("url"))).distinct()


def per_host_cap(df: DataFrame, n: int, order: list, host: str = "host") -> DataFrame:
    """First ``n`` rows per host; the limit is applied per task before the shuffle as well (window group limit)."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(host).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def sitemap_urls(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """``(host, target)``: same-host addresses of sitemap texts ``(url, body)``; with ``cap`` the first per host by address."""
    u = documents.select(host_of(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("body", F.lit(SITEMAP_PATTERN), F.lit(1))).alias("target"))
    own = u.filter(host_of(F.col("target")) == F.col("host")).distinct()
    return own if cap is None else per_host_cap(own, cap, ["target"])


def robots_paths(documents: DataFrame) -> DataFrame:
    """``(url, target)``: addresses of the paths a robots text allows or disallows."""
    p = documents.select("url", F.explode(F.regexp_extract_all("body", F.lit(ROBOTS_PATTERN), F.lit(1))).alias("p"))
    return p.select("url", resolve_url(F.col("url"), F.col("p")).alias("target")).distinct()


def query_endpoints(pages: DataFrame) -> DataFrame:
    """Pages that carry a query string as GET endpoints: ``(seq, method, url, params)``."""
    pairs = query_pairs(url_part(F.col("url"), "QUERY"))
    params = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), F.lit("query").alias("location"), p["value"].alias("default")))
    e = pages.select(F.col("page_id").alias("seq"), F.lit("GET").alias("method"), "url", params.alias("params"))
    return e.filter(F.size("params") > 0)


def recorded_request_endpoints(requests: DataFrame) -> DataFrame:
    """``requests(seq, page_url, url, method, post_data)`` of the page's host as endpoints with body parameters."""
    own = requests.filter(host_of(F.col("url")) == host_of(F.col("page_url")))
    pairs = query_pairs(F.coalesce("post_data", F.lit("")))
    params = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), F.lit("body").alias("location"), p["value"].alias("default")))
    return own.select("seq", F.upper("method").alias("method"), "url", params.alias("params"))


def endpoint_union(*parts: DataFrame) -> DataFrame:
    """All endpoints, first seen per method and address kept."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keyed = out.withColumn("key", endpoint_key(F.col("method"), F.col("url")))
    return dedup_first_seen(keyed, ["key"])


def endpoint_merge(endpoints: DataFrame) -> DataFrame:
    """``(key, url, method, params)``: one row per method and address, parameters joined by name, first default wins.

    Parameters are reduced to one per (key, name) first, so an address seen very often collects its distinct names only.
    """
    k = endpoints.select(endpoint_key(F.col("method"), F.col("url")).alias("key"), F.upper("method").alias("method"), endpoint_url(F.col("url")).alias("url"), "seq", "params")
    p = k.select("key", "seq", F.posexplode("params").alias("pos", "p")).select("key", "seq", "pos", "p.name", "p.location", "p.default")
    one = first_by(p, ["key", "name"], ["seq", "pos"])
    merged = one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "name", "location", "default"))).alias("_p"))
    base = k.select("key", "method", "url").distinct()
    j = base.join(merged, "key", "left")
    arr = F.transform("_p", lambda x: F.struct(x["name"].alias("name"), x["location"].alias("location"), x["default"].alias("default")))
    return j.select("key", "method", "url", arr.alias("params"))
