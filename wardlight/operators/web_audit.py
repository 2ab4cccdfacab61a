"""Audits of recorded responses. Nothing here sends a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import (
    COOKIE_CHECKS, DB_ERROR_PATTERNS, DIFF_MAX_SIMILARITY, DIFF_MIN_LENGTH_DELTA,
    ENTITY_INDICATORS, HEADER_CHECKS, HSTS_MIN_AGE, INTERNAL_INDICATORS, LATENCY_MIN_MS, LATENCY_OVER_BASELINE_MS, METHOD_CHECKS, RISKY_METHODS,
    SERVER_PRODUCTS, UNIX_FILE_INDICATORS, WINDOWS_FILE_INDICATORS,
)
from wardlight.functions.cols import any_of, contains_any, explode_once, first_contained, let, lit_map
from wardlight.operators.findings import severity_from_cvss


def header(name: str) -> Column:
    """Value of a header whatever the case of its name, last one on repeats, empty when absent."""
    hit = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.try_element_at(hit, F.lit(-1))["value"], F.lit(""))


def with_metadata(df: DataFrame, table: dict, key: str = "check") -> DataFrame:
    """Severity, score, CWE, OWASP and confidence of a check from its fixed table."""
    for i, name in enumerate(("severity", "cvss_score", "cwe", "owasp", "confidence")):
        df = df.withColumn(name, F.try_element_at(lit_map({k: v[i] for k, v in table.items()}), F.col(key)))
    return df


def header_audit(responses: DataFrame, keep: tuple[str, ...] = ("resp_id", "url")) -> DataFrame:
    """One row per failed header check; every response is judged in its own row."""
    names = {
        "hsts": "strict-transport-security", "csp": "content-security-policy", "xfo": "x-frame-options",
        "xcto": "x-content-type-options", "rp": "referrer-policy", "pp": "permissions-policy", "fp": "feature-policy",
        "server": "server", "powered": "x-powered-by", "cache": "cache-control",
    }
    r = responses.select(*keep, *[header(n).alias(k) for k, n in names.items()])
    h = {k: F.col(k) for k in names}
    part = F.get(F.filter(F.transform(F.split(h["hsts"], ";"), lambda p: F.trim(p)), lambda p: F.contains(F.lower(p), F.lit("max-age"))), F.lit(0))
    age = F.trim(F.get(F.split(part, "="), F.lit(1))).try_cast("bigint")
    has = lambda c, s: F.contains(c, F.lit(s))
    hsts, csp, xfo, rp, cache = h["hsts"], h["csp"], h["xfo"], h["rp"], h["cache"]
    frame = has(F.lower(csp), "frame-ancestors")
    tests = {
        "hsts_missing": hsts == "",
        "hsts_max_age_short": (hsts != "") & has(hsts, "max-age") & F.coalesce(age < HSTS_MIN_AGE, F.lit(False)),
        "hsts_no_subdomains": (hsts != "") & ~has(F.lower(hsts), "includesubdomains"),
        "csp_missing": csp == "",
        "csp_unsafe_inline": has(csp, "unsafe-inline"),
        "csp_unsafe_eval": has(csp, "unsafe-eval"),
        "csp_permissive": (csp != "") & (has(csp, "default-src *") | (~has(csp, "default-src 'none'") & ~has(csp, "script-src"))),
        "frame_missing": (xfo == "") & ~frame,
        "frame_misconfigured": (xfo != "") & ~F.upper(xfo).isin("DENY", "SAMEORIGIN") & ~frame,
        "nosniff_missing": ~has(F.lower(h["xcto"]), "nosniff"),
        "referrer_missing": rp == "",
        "referrer_permissive": F.lower(rp).isin("unsafe-url", "no-referrer-when-downgrade"),
        "permissions_missing": (h["pp"] == "") & (h["fp"] == ""),
        "server_banner": contains_any(F.lower(h["server"]), SERVER_PRODUCTS),
        "powered_by": h["powered"] != "",
        "cache_control": ~has(cache, "no-store") & ~has(cache, "private"),
    }
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests.items()]))
    return with_metadata(explode_once(r, list(keep), failed, "check"), HEADER_CHECKS)


def cookie_audit(cookies: DataFrame, keep: tuple[str, ...] = ("resp_id",)) -> DataFrame:
    """``cookies`` is ``(resp_id, name, http_only, secure, same_site)``; one row per failed check."""
    weak = ~F.lower(F.coalesce("same_site", F.lit(""))).isin("strict", "lax")
    failed = F.array_compact(F.array(
        F.when(~F.coalesce("http_only", F.lit(False)), "cookie_http_only"), F.when(~F.coalesce("secure", F.lit(False)), "cookie_secure"),
        F.when(weak, "cookie_same_site")))
    return with_metadata(cookies.select(*keep, "name", F.explode(failed).alias("check")), COOKIE_CHECKS)


def cors_audit(responses: DataFrame, probe_origin: str) -> DataFrame:
    """Probe origin (or ``*``) allowed together with credentials."""
    acao, acac = header("access-control-allow-origin"), F.lower(header("access-control-allow-credentials"))
    kind = F.when(F.contains(acao, F.lit(probe_origin)) & (acac == "true"), "reflected").when((acao == "*") & (acac == "true"), "wildcard")
    return responses.select("resp_id", "url", kind.alias("kind"), acao.alias("allow_origin")).filter("kind is not null")


def methods_audit(responses: DataFrame, marker: str) -> DataFrame:
    """Dangerous methods, judged on recorded answers."""
    allow = F.upper(header("allow"))
    listed = F.filter(F.array(*[F.lit(m) for m in RISKY_METHODS]), lambda m: F.contains(allow, m))
    m, s = F.upper("method"), F.col("status")
    hit = any_of([
        (m == "OPTIONS") & ~s.isin(0, 400, 405) & (F.size(listed) > 0),
        (m == "TRACE") & (s == 200) & F.contains("body", F.lit(marker)),
        (m == "PUT") & s.isin(200, 201, 204), (m == "DELETE") & s.isin(200, 204), (m == "CONNECT") & s.isin(200, 201),
    ])
    rows = responses.filter(hit).select("resp_id", "url", m.alias("check"), F.when(m == "OPTIONS", F.array_join(listed, ", ")).otherwise(m).alias("methods"))
    return with_metadata(rows, METHOD_CHECKS)


def db_error_scan(responses: DataFrame, patterns: list[str] = DB_ERROR_PATTERNS, gate: list[str] | None = None) -> DataFrame:
    """First database error in each body: ``(resp_id, url, pattern_no, matched)``.

    Each of the standard patterns needs one of a few short texts, which is tested first.
    """
    if gate is None and patterns is DB_ERROR_PATTERNS:
        gate = ["sql", "syntax", "quot", "ora-", "oracle", "pg::", "pg_query"]
    r = responses.select("resp_id", "url", F.lower("body").alias("_b"))
    if gate:
        r = r.filter(let(F.col("_b"), lambda b: contains_any(b, gate)))
    found = F.coalesce(*[
        F.when(F.col("_b").rlike(p), F.struct(F.lit(i + 1).alias("pattern_no"), F.regexp_extract("_b", p, 0).alias("matched"))) for i, p in enumerate(patterns)])
    return r.select("resp_id", "url", found.alias("f")).filter("f is not null").select("resp_id", "url", "f.*")


def indicator_scan(responses: DataFrame) -> DataFrame:
    """First indicator of each kind in a body: ``(resp_id, url, kind, indicator)``."""
    body, low = F.col("body"), F.lower("body")

    def folded(words):
        return let(low, lambda b: F.coalesce(*[F.when(F.contains(b, F.lit(w.lower())), F.lit(w)) for w in words]))

    kinds = {
        "file": F.coalesce(first_contained(body, UNIX_FILE_INDICATORS), folded(WINDOWS_FILE_INDICATORS)),
        "entity": first_contained(body, ENTITY_INDICATORS),
        "internal": folded(INTERNAL_INDICATORS),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("indicator")) for k, v in kinds.items()])
    return explode_once(responses, ["resp_id", "url"], F.filter(arr, lambda x: x["indicator"].isNotNull()), "i").select("resp_id", "url", "i.*")


def reflection_check(requests: DataFrame) -> DataFrame:
    """Rows ``(…, input, body)`` whose input stands verbatim in the body."""
    return requests.filter((F.col("input") != "") & F.contains("body", F.col("input")))


def expected_value_check(requests: DataFrame) -> DataFrame:
    """Rows ``(…, expected, body)`` whose evaluated result stands in the body."""
    return requests.filter((F.col("expected") != "") & F.contains("body", F.col("expected")))


def baseline_exclude(hits: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Drop hits whose expected value already stands in the baseline body of the same request."""
    b = baseline.select(*[F.col(k).alias("_" + k) for k in keys], F.col("body").alias("_base"))
    cond = F.contains(F.col("_base"), F.col("expected"))
    for k in keys:
        cond = cond & (F.col(k) == F.col("_" + k))
    return hits.join(b, cond, "left_anti")


def redirect_check(responses: DataFrame, domain: str) -> DataFrame:
    """Location header or a redirect step that names the domain; the header is reported first."""
    location = header("location")
    step = F.get(F.filter("redirects", lambda u: F.contains(u, F.lit(domain))), F.lit(0))
    out = responses.select("resp_id", "url", F.when(F.contains(location, F.lit(domain)), F.concat(F.lit("Location header: "), location))
                           .when(step.isNotNull(), F.concat(F.lit("Redirect chain included: "), step)).alias("evidence"))
    return out.filter("evidence is not null")


def latency_anomaly(responses: DataFrame, baseline: DataFrame, key: str, min_ms: int = LATENCY_MIN_MS, over: int = LATENCY_OVER_BASELINE_MS) -> DataFrame:
    """Responses slow in absolute terms and against the baseline ``(key, baseline_ms)``.

    The absolute test runs before the join, so only slow responses are shuffled.
    """
    slow = responses.filter(F.col("ms") >= min_ms)
    return slow.join(baseline.select(key, "baseline_ms"), key).filter(F.col("ms") >= F.col("baseline_ms") + over)


def response_pairs(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of ``pairs(pair_id, a_id, b_id)`` in one row."""
    side = lambda p: responses.select(F.col("resp_id").alias(f"{p}_id"), F.col("url").alias(f"{p}_url"), F.col("status").alias(f"{p}_status"), F.col("body").alias(f"{p}_body"))
    return pairs.join(side("a"), "a_id").join(side("b"), "b_id")


def response_diff(paired: DataFrame, similarity: bool = True, min_delta: int = DIFF_MIN_LENGTH_DELTA, max_similarity: float = DIFF_MAX_SIMILARITY) -> DataFrame:
    """``(pair_id, status_changed, length_delta, similarity, significant)``.

    The word overlap is computed for pairs that status and length leave open; for decided pairs it is null. Without
    ``similarity`` only status and length decide.
    """
    d = paired.select(
        "pair_id", (F.col("a_status") != F.col("b_status")).alias("status_changed"),
        F.abs(F.length("a_body") - F.length("b_body")).alias("length_delta"), "a_body", "b_body")
    decided = F.col("status_changed") | (F.col("length_delta") >= min_delta)
    if not similarity:
        return d.select("pair_id", "status_changed", "length_delta", decided.alias("significant"))
    closed = d.filter(decided).select("pair_id", "status_changed", "length_delta", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("significant"))
    open_ = word_overlap(d.filter(~decided), "pair_id", "a_body", "b_body")
    return closed.unionByName(open_.select("pair_id", "status_changed", "length_delta", "similarity", (F.col("similarity") <= max_similarity).alias("significant")))


def word_overlap(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``pairs`` with ``similarity``: twice the words both whole texts share over the words of both, repeats counted.

    Words of both sides are counted in one shuffle by (key, word), so the work is linear in the texts and the words of a
    very long body are spread; two texts without words are equal.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z_]+"), lambda w: w != "")
    left = pairs.select(F.col(key).alias("_p"), F.explode(words(F.col(a))).alias("_w"), F.lit(1).alias("_x"), F.lit(0).alias("_y"))
    right = pairs.select(F.col(key).alias("_p"), F.explode(words(F.col(b))).alias("_w"), F.lit(0).alias("_x"), F.lit(1).alias("_y"))
    counts = left.unionByName(right).groupBy("_p", "_w").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    shared = counts.groupBy("_p").agg((2 * F.sum(F.least("_x", "_y")) / F.sum(F.col("_x") + F.col("_y"))).alias("_s"))
    return pairs.join(shared, pairs[key] == shared["_p"], "left").withColumn("similarity", F.coalesce("_s", F.lit(1.0))).drop("_p", "_s")


def edit_similarity(a, b) -> Column:
    """One minus edit distance over the longer length, for short values."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def diff_evidence(paired: DataFrame, param: str) -> DataFrame:
    """Readable evidence for a pair of responses.

    The percentage is rounded by the value of the double, as ``printf`` does; ``%.2f`` of Java rounds its shortest decimal
    form and so shows 99.845, which is a little less in binary, as 99.85.
    """
    percent = F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6 * 100
    text = F.format_string(
        "Boolean difference in parameter '%s': true %s status %d length %d, false %s status %d length %d, delta %d, similarity %s%%",
        F.lit(param), "a_url", "a_status", F.length("a_body"), "b_url", "b_status", F.length("b_body"),
        F.abs(F.length("a_body") - F.length("b_body")), F.format_number(percent, 2))
    return word_overlap(paired, "pair_id", "a_body", "b_body").select("pair_id", text.alias("evidence"))


def canary_echo(responses: DataFrame, issued: DataFrame) -> DataFrame:
    """Issued ids ``(resp_id, canary)`` found in the body of their own response."""
    return responses.join(issued, "resp_id").filter(F.contains("body", F.col("canary"))).select("resp_id", "url", "canary")


def canary_callback(probes: DataFrame, callbacks: DataFrame, timeout_seconds: int, pattern: str = "id-[0-9]+") -> DataFrame:
    """Probes with the callbacks that carry their id in the path, or in the column ``body`` if there is one, within the timeout.

    Both sides meet on (id, time slot of one timeout length); a probe covers at most two slots, so an id with very
    many callbacks is split over its slots.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (timeout_seconds * 1_000_000))
    p = probes.withColumn("_s", F.explode(F.array(slot("issued_at"), slot("issued_at") + 1)))
    text = F.concat_ws("\n", "path", "body") if "body" in callbacks.columns else F.col("path")
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    c = callbacks.withColumn("canary", F.explode(ids)).withColumn("_s", slot("received_at"))
    late = F.col("issued_at") + F.expr(f"interval {timeout_seconds} seconds")
    return p.join(c, ["canary", "_s"]).filter((F.col("received_at") >= F.col("issued_at")) & (F.col("received_at") <= late)).drop("_s")


def audit_findings(responses: DataFrame, probe_origin: str = "https://probe.example", marker: str = "track(", domain: str = "other.example") -> DataFrame:
    """Header, cookie, CORS, method, error, indicator and redirect findings of a response log in one shape.

    Cookies are read where the log has a column ``cookies`` (array of name, http_only, secure, same_site), redirect
    steps where it has ``redirects``. ``probe_origin``, ``marker`` and ``domain`` are what the recorded requests sent.
    """
    def shaped(df, rule, cls, severity, score, evidence):
        return df.select("resp_id", "url", rule.alias("rule_id"), F.lit(cls).alias("vuln_class"), severity.alias("severity"), score.cast("double").alias("cvss_score"), evidence.alias("evidence"))

    fixed = lambda v: (severity_from_cvss(F.lit(v)), F.lit(v))
    log = responses if "redirects" in responses.columns else responses.withColumn("redirects", F.array().cast("array<string>"))
    parts = [
        shaped(header_audit(log), F.col("check"), "Misconfiguration", F.col("severity"), F.col("cvss_score"), F.col("check")),
        shaped(cors_audit(log, probe_origin), F.concat(F.lit("cors_"), "kind"), "CORS", *fixed(7.5), F.col("allow_origin")),
        shaped(methods_audit(log, marker), F.concat(F.lit("method_"), F.lower("check")), "Misconfiguration", F.col("severity"), F.col("cvss_score"), F.col("methods")),
        shaped(db_error_scan(log), F.lit("db_error"), "SQLi", *fixed(9.8), F.col("matched")),
        shaped(indicator_scan(log), F.concat(F.lit("indicator_"), "kind"), "Information Disclosure", *fixed(7.5), F.col("indicator")),
        shaped(redirect_check(log, domain), F.lit("open_redirect"), "Open Redirect", *fixed(6.1), F.col("evidence")),
    ]
    if "cookies" in responses.columns:
        flat = log.select("resp_id", "url", F.explode("cookies").alias("k")).select("resp_id", "url", "k.*")
        parts.append(shaped(cookie_audit(flat, ("resp_id", "url")), F.col("check"), "Insecure Cookie", F.col("severity"), F.col("cvss_score"), F.col("name")))
    return reduce(DataFrame.unionByName, parts)

