"""Finding projections: severity dialects, paths, fingerprints, scores, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import CLASS_CVSS, DEFAULT_CVSS, DIALECTS, REPORT_CVSS, SEVERITY_FALLBACK_CVSS
from wardlight.functions.cols import lit_map


def severity_normalize(col, dialect: str) -> Column:
    """Canonical severity of a tool's own word."""
    tests, exact, default, missing = DIALECTS[dialect]
    word = F.lower(F.trim(col))
    expr = F.when(col.isNull() | (col == ""), F.lit(missing))
    for texts, sev in tests:
        for t in texts:
            expr = expr.when((word == t) if exact else F.contains(word, F.lit(t)), F.lit(sev))
    return expr.otherwise(F.lit(default))


def path_normalize(col) -> Column:
    """Forward slashes; everything up to ``temp/<folder>/`` is dropped."""
    slashed = F.replace(col, F.lit("\\"), F.lit("/"))
    # everything through the first segment "temp" and the one after it
    cut = F.regexp_replace(slashed, r"^(?:[^/]*/)*?temp(?:$|/[^/]*(?:/|$))", "")
    return F.when(F.contains(slashed, F.lit("temp")), cut).otherwise(slashed)


def fingerprint(tool, path, line, issue, digest: bool = False) -> Column:
    """Stable id of a finding: lower-case hex of ``tool:path:line:issue``, or its SHA-256."""
    base = F.concat_ws(":", tool, path, line.cast("string"), issue)
    return F.sha2(base, 256) if digest else F.lower(F.hex(F.encode(base, "UTF-8")))


def normalize_findings(raw: DataFrame) -> DataFrame:
    """Canonical rows of raw scanner findings; rows without issue, path or tool are dropped."""
    clean = raw.select(
        F.lower(F.coalesce("tool", F.lit(""))).alias("tool"),
        path_normalize(F.coalesce("file", F.lit(""))).alias("file_path"),
        F.coalesce(F.col("line"), F.lit(0)).cast("bigint").alias("start_line"),
        F.trim(F.coalesce("issue", F.lit(""))).alias("snippet"),
        severity_normalize(F.coalesce("severity", F.lit("Low")), "agent").alias("severity"),
    ).filter("tool <> '' and file_path <> '' and snippet <> ''")
    return clean.select(
        fingerprint(F.col("tool"), F.col("file_path"), F.col("start_line"), F.col("snippet")).alias("id"),
        "tool", "severity", "file_path", "start_line", F.col("start_line").alias("end_line"), "snippet",
    )


def standardize_tool_report(reports: DataFrame) -> DataFrame:
    """Two report shapes in JSON to one row per result; results without a file are dropped.

    Results are read as string maps, so a missing key (``unknown``) differs from a null one (dropped).
    """
    results = reports.select(
        "report_id", "tool", F.explode(F.from_json("content", "results array<map<string,string>>")["results"]).alias("r")
    )

    def field(key, default):
        return F.when(F.map_contains_key("r", key), F.try_element_at("r", F.lit(key))).otherwise(F.lit(default))

    none = "No description provided"
    extra = F.try_element_at("r", F.lit("extra"))
    bandit = F.col("tool") == "bandit"
    out = results.select(
        "report_id", "tool",
        F.when(bandit, field("filename", "unknown")).otherwise(field("path", "unknown")).alias("file"),
        F.when(bandit, F.try_element_at("r", F.lit("line_number")).cast("bigint")).alias("line"),
        F.when(bandit, field("issue_text", none)).otherwise(F.coalesce(F.get_json_object(extra, "$.message"), F.lit(none))).alias("issue"),
        F.when(bandit, severity_normalize(F.try_element_at("r", F.lit("issue_severity")), "bandit"))
        .otherwise(severity_normalize(F.get_json_object(extra, "$.severity"), "semgrep")).alias("severity"),
    )
    return out.filter("file is not null and file not in ('null', '')")


def cvss_resolve(score, vuln_class, severity) -> Column:
    """Explicit score, else the class score, else the severity fallback, else 5.0."""
    return F.coalesce(
        score, F.try_element_at(lit_map(CLASS_CVSS), vuln_class),
        F.try_element_at(lit_map(SEVERITY_FALLBACK_CVSS), severity), F.lit(DEFAULT_CVSS),
    )


def report_cvss(rule_score, rule_vector, vuln_class) -> tuple[Column, Column]:
    """Score and vector shown in a report: the rule's own, else those of the class, else null."""
    scores = lit_map({k: v[0] for k, v in REPORT_CVSS.items()})
    vectors = lit_map({k: v[1] for k, v in REPORT_CVSS.items()})
    return (
        F.coalesce(rule_score, F.try_element_at(scores, vuln_class)),
        F.coalesce(rule_vector, F.try_element_at(vectors, vuln_class)),
    )


def severity_from_cvss(score) -> Column:
    return F.when(score >= 9.0, "Critical").when(score >= 7.0, "High").when(score >= 4.0, "Medium").otherwise("Low")


def secret_evidence(name, value, mask: bool = True) -> Column:
    """``name = "value"``; by default the value is masked except its first four characters, its length kept."""
    shown = value
    if mask:
        shown = F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))))
    return F.concat(name, F.lit(' = "'), shown, F.lit('"'))


def taint_trace_build(steps: DataFrame, key: str = "seq") -> DataFrame:
    """Ordered path rows ``(key, ord, line, description)`` to one array of numbered steps per key."""
    rows = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "line", "description"))).alias("r"))
    numbered = F.transform("r", lambda x, i: F.struct((i + 1).alias("step"), x["line"].alias("line"), x["description"].alias("description")))
    return rows.select(key, numbered.alias("taint_trace"))


def finding_rule_enrich(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the rule's severity (unless overridden), confidence, cwe, owasp, texts and scores; unknown rules drop the row."""

    from wardlight.operators.rules_match import unique_rules

    one = unique_rules(rules).select(
        "rule_id", F.col("vuln_class").alias("rule_class"), F.col("severity").alias("rule_severity"),
        F.col("confidence").alias("rule_confidence"), "cwe", "owasp", F.col("cvss_score").alias("rule_score"),
        F.col("cvss_vector").alias("rule_vector"), "issue", "message", "remediation",
    )
    j = hits.join(one, "rule_id")
    score, vector = report_cvss(F.col("rule_score"), F.col("rule_vector"), F.col("vuln_class"))
    keep = [c for c in hits.columns if c not in ("severity_override", "confidence_override")]
    return j.select(
        *keep,
        F.coalesce("severity_override", "rule_severity", F.lit("Medium")).alias("severity"),
        F.coalesce("confidence_override", "rule_confidence", F.lit("Confirmed")).alias("confidence"),
        "cwe", "owasp", score.alias("cvss_score"), vector.alias("cvss_vector"),
        F.coalesce("issue", F.concat("vuln_class", F.lit(" vulnerability detected"))).alias("issue"),
        F.coalesce("message", F.lit("")).alias("description"), F.coalesce("remediation", F.lit("")).alias("remediation"),
    )


def findings_union(*parts: DataFrame) -> DataFrame:
    """All finding sets below each other, missing columns filled with null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
