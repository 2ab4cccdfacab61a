"""Severity counts, scores, grades and rule-independent aggregates over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import GRADE_CUTS, LOWEST_GRADE, SEVERITIES, SEVERITY_WEIGHT
from wardlight.operators.findings import cvss_resolve


def severity_count_cols(prefix: str = "n_") -> list[Column]:
    """One conditional count per fixed severity; other words count nowhere."""
    return [F.count_if(F.col("severity") == s).alias(prefix + s.lower()) for s in SEVERITIES]


def severity_counts(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """One row per group with five counts, zeros kept; one map-side combined aggregation."""
    return findings.groupBy(by).agg(*severity_count_cols())


def grade_of(score) -> Column:
    expr = F.when(score >= GRADE_CUTS[0][0], GRADE_CUTS[0][1])
    for cut, grade in GRADE_CUTS[1:]:
        expr = expr.when(score >= cut, grade)
    return expr.otherwise(LOWEST_GRADE)


def score_parts(findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """Counts and highest CVSS per group."""
    cvss = cvss_resolve(F.col("cvss_score"), F.col("vuln_class"), F.col("severity"))
    return findings.withColumn("_cvss", cvss).groupBy(by).agg(*severity_count_cols(), F.max("_cvss").alias("_max"), F.count("*").alias("n_findings"))


def scan_score(scans: DataFrame, findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """Score, grade, counts and highest CVSS for every scan, empty scans included (100 / A / 0.0).

    Score is ``max(0, 100 - 15 C - 10 H - 5 M - 2 L)``. Findings are reduced to one row per scan before they meet the
    scans, so a scan with very many findings costs one row in the join.
    """
    parts = score_parts(findings, by)
    j = scans.join(parts, by, "left")
    counts = [F.coalesce(F.col("n_" + s.lower()), F.lit(0)).alias("n_" + s.lower()) for s in SEVERITIES]
    base = j.select(*[c for c in scans.columns], *counts, F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
                    F.bround(F.coalesce("_max", F.lit(0.0)), 1).alias("max_cvss"))
    cost = sum((F.col("n_" + s.lower()) * w for s, w in SEVERITY_WEIGHT.items() if w), F.lit(0))
    scored = base.withColumn("score", F.greatest(F.lit(0), 100 - cost).cast("bigint"))
    return scored.withColumn("grade", grade_of(F.col("score")))


def scan_score_worst(scans: DataFrame, findings: DataFrame, by: str = "scan_id") -> DataFrame:
    """The documented alternative: ``max(0, int(100 - 10 * highest CVSS))``."""
    cvss = cvss_resolve(F.col("cvss_score"), F.col("vuln_class"), F.col("severity"))
    worst = findings.groupBy(by).agg(F.max(cvss).alias("_max"))
    return scans.join(worst, by, "left").select(
        *scans.columns, F.greatest(F.lit(0), F.floor(100 - 10 * F.coalesce("_max", F.lit(0.0)))).cast("bigint").alias("score")
    )


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(F.count("*").alias("n_findings"))
