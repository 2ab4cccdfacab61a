"""Whole audit of recorded responses and stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.cols import endpoint_url, host_of
from wardlight.operators import web_audit
from wardlight.operators.dedup import first_by
from wardlight.operators.scoring import scan_score
from wardlight.sources.records import response_log_read


def response_findings(responses: DataFrame) -> DataFrame:
    """Findings of a response log, first seen per (rule, address) kept."""
    log = response_log_read(responses)
    found = web_audit.audit_findings(log).select(F.col("resp_id").alias("seq"), "rule_id", "vuln_class", endpoint_url(F.col("url")).alias("url"), "severity", "cvss_score", "evidence")
    return first_by(found, ["rule_id", "url"], ["seq", "evidence"])


def response_scores(responses: DataFrame) -> DataFrame:
    """Score per host over the deduplicated findings; hosts without findings score 100."""
    hosts = responses.select(host_of(F.col("url")).alias("host")).distinct()
    f = response_findings(responses).withColumn("host", host_of(F.col("url")))
    return scan_score(hosts, f, by="host")
