"""Whole static scan: files in, deduplicated and enriched findings with scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import ADVISORIES, CONFIG_CHECK_BY_NAME
from wardlight.operators import extract, flows, secrets, structure_checks, taint, triage
from wardlight.operators.dedup import dedup_shortest_trace
from wardlight.operators.files import basename, prescan_gate, with_language
from wardlight.operators.findings import findings_union, fingerprint, report_cvss
from wardlight.operators.lines import source_lines
from wardlight.operators.rules_match import unique_rules
from wardlight.operators.scoring import scan_score
from wardlight.sources.records import manifest_read

# class, severity and confidence of findings that come from a detector instead of a rule
DETECTORS = [
    ("secret_api_key", "Hardcoded Secret", "High", "Confirmed"), ("secret_assignment", "Hardcoded Secret", "High", "Confirmed"),
    ("secret_cloud_key_id", "Hardcoded Secret", "High", "Confirmed"), ("secret_sk_token", "Hardcoded Secret", "High", "Confirmed"),
    ("secret_ghp_token", "Hardcoded Secret", "High", "Confirmed"), ("secret_xoxb_token", "Hardcoded Secret", "High", "Confirmed"),
    ("secret_entropy", "Hardcoded Secret", "High", "Probable"), ("secret_credential", "Hardcoded Secret", "High", "Confirmed"),
    ("secret_file", "Hardcoded Secret", "High", "Probable"), ("redos_pattern", "ReDoS", "High", "Probable"),
    ("config_env_debug", "Misconfiguration", "High", "Confirmed"), ("config_privileged", "Misconfiguration", "Critical", "Confirmed"),
    ("config_outdated_package", "Vulnerable Dependency", "High", "Confirmed"),
]


def raw_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(file, line, rule_id, taint_trace, trace_len, evidence, severity_override, confidence_override)`` of every detector.

    Configuration files are routed by name first; the keyword gate is for code and text. What a detector saw (statement,
    call, masked value) is its evidence, so nothing is read again for it.
    """
    config = files.filter(F.lower(basename(F.col("file"))).isin(list(CONFIG_CHECK_BY_NAME)))
    gated = prescan_gate(files, rules)
    code = with_language(gated).filter("language is not null").select("file", "language", "content")
    facts = taint.CodeFacts(code, rules)
    none = F.lit(None).cast("string")

    def shape(df, line="line", rule=None, evidence=None):
        own = lambda c: F.col(c) if c in df.columns else none
        at = F.col(line).cast("bigint") if line else F.lit(None).cast("bigint")
        shown = evidence if evidence is not None else none
        used = F.array(F.struct(F.lit(1).alias("step"), at.alias("line"), F.concat(F.lit("used here: "), F.coalesce(shown, F.lit(""))).alias("description")))
        return df.select(
            "file", at.alias("line"), (F.lit(rule) if rule else F.col("rule_id")).alias("rule_id"), (F.col("taint_trace") if "taint_trace" in df.columns else used).alias("taint_trace"),
            shown.alias("evidence"), own("severity_override").alias("severity_override"), own("confidence_override").alias("confidence_override")).withColumn("trace_len", F.size("taint_trace"))

    lines = source_lines(gated.select("file", "content"))
    config_lines = source_lines(config.select("file", "content"))
    # a file name can be telling whatever the content holds, so names are taken before the gate
    secret_hits = secrets.secret_fp_filter(secrets.secret_dispatch(lines, files.select("file")))
    adv = files.sparkSession.createDataFrame(ADVISORIES, "pkg string, prefixes array<string>, severity string")
    manifests = config.filter("regexp_replace(file, '^.*/', '') = 'package.json'").select("file", "content")
    masked = F.concat(F.substring("value", 1, 4), F.repeat(F.lit("*"), F.greatest(F.length("value") - 4, F.lit(0))))
    return findings_union(
        shape(flows.taint_paths(facts), "sink_line", evidence=F.col("sink_text")),
        shape(structure_checks.detect_shell_true(facts.calls, rules), evidence=F.col("full_text")),
        shape(structure_checks.detect_weak_crypto(facts.calls, rules), evidence=F.col("pattern")),
        shape(secret_hits, evidence=masked), shape(secrets.detect_redos(extract.extract_strings(lines)), rule="redos_pattern", evidence=F.col("pattern")),
        shape(triage.detect_env_debug(config_lines), rule="config_env_debug", evidence=F.col("evidence")),
        shape(triage.detect_privileged_container(config_lines), rule="config_privileged", evidence=F.col("evidence")),
        shape(triage.advisory_match(manifest_read(manifests), adv), line=None, rule="config_outdated_package", evidence=F.concat_ws(" ", "pkg", "version")),
    )


def static_scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of ``files(file, content)``: one per (file, rule, line), the one with the shortest trace, as whole records.

    A record has an id, class, severity, confidence, score and vector, CWE, OWASP, issue, description, remediation,
    evidence, and every step from where the value came in to where it is used.
    """
    hits = raw_hits(files, rules).withColumn("vuln_class", F.lit(""))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = dedup_shortest_trace(hits.withColumn("seq", F.concat_ws("|", *[blank(c) for c in ("severity_override", "confidence_override", "evidence")])))
    own = files.sparkSession.createDataFrame(DETECTORS, "rule_id string, vuln_class string, severity string, confidence string")
    known = unique_rules(rules).select("rule_id", "vuln_class", "severity", "confidence", "cwe", "owasp", "cvss_score", "cvss_vector", "issue", "message", "remediation")
    known = known.unionByName(own, allowMissingColumns=True).select(*[F.col(c).alias(c if c == "rule_id" else "r_" + c) for c in known.columns])
    j = one.drop("vuln_class").join(known, "rule_id")
    score, vector = report_cvss(F.col("r_cvss_score"), F.col("r_cvss_vector"), F.col("r_vuln_class"))
    trace = F.transform("taint_trace", lambda x: F.struct(x["step"].alias("step"), x["line"].alias("line"), F.col("file").alias("file"), x["description"].alias("description")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        fingerprint(F.lit("wardlight"), F.col("file"), F.coalesce("line", F.lit(0)), F.col("rule_id"), digest=True).alias("id"), "file", "line", "rule_id", F.col("r_vuln_class").alias("vuln_class"),
        F.coalesce("severity_override", "r_severity").alias("severity"), F.coalesce("confidence_override", "r_confidence").alias("confidence"), score.alias("cvss_score"), vector.alias("cvss_vector"),
        text("r_cwe").alias("cwe"), text("r_owasp").alias("owasp"), F.coalesce("r_issue", F.concat("r_vuln_class", F.lit(" detected"))).alias("issue"), text("r_message").alias("description"),
        text("evidence").alias("evidence"), trace.alias("taint_trace"), text("r_remediation").alias("remediation"), F.lit("wardlight").alias("tool"), "trace_len")


def static_scan_scores(files: DataFrame, findings: DataFrame, project) -> DataFrame:
    """Score per project; ``project`` is a column of the file path. Projects without findings score 100."""
    projects = files.select(project.alias("scan_id")).distinct()
    return scan_score(projects, findings.withColumn("scan_id", project))
