"""Dashboard roll-ups over scans and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import RECENT_SCANS, RISK_CUTS, RISK_WORST, SCAN_TYPE_LABELS, TREND_DAYS
from wardlight.functions.cols import lit_map
from wardlight.operators.scoring import scan_score, severity_count_cols, severity_counts

SCAN_TYPES = ["sast", "dast", "port", "secret", "dependency"]


def counted_scans(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with their number of findings (zero kept)."""
    n = findings.groupBy("scan_id").agg(F.count("*").alias("n_findings"))
    return scans.join(n, "scan_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def type_severity(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity counts per scan type over the whole history; findings are reduced per scan before the join."""
    per = severity_counts(findings)
    sums = [F.sum(c).alias(c) for c in per.columns if c != "scan_id"]
    return scans.select("scan_id", "scan_type").join(per, "scan_id").groupBy("scan_type").agg(*sums)


def trend(scans: DataFrame, findings: DataFrame, as_of: str, days: int = TREND_DAYS) -> DataFrame:
    """Findings per day and type for the last ``days`` calendar days up to ``as_of``, zero-filled."""
    end = F.to_date(F.lit(as_of))
    first = F.date_sub(end, days - 1)
    recent = scans.filter((F.col("ts") >= first) & (F.col("ts") < F.date_add(end, 1)))  # on the column itself, so the scan can prune
    own = findings.join(recent.select("scan_id"), "scan_id", "left_semi")
    per = counted_scans(recent, own).groupBy(F.to_date("ts").alias("day"), "scan_type").agg(F.sum("n_findings").alias("n_findings"))
    spine = scans.sparkSession.range(1).select(F.explode(F.sequence(first, end)).alias("day")).select(
        "day", F.explode(F.array(*[F.lit(s) for s in SCAN_TYPES])).alias("scan_type")
    )
    return spine.join(per, ["day", "scan_type"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def risk_of(score) -> Column:
    """Risk word for an average score; a high score is a low risk."""
    expr = F.when(score >= RISK_CUTS[0][0], RISK_CUTS[0][1])
    for cut, word in RISK_CUTS[1:]:
        expr = expr.when(score >= cut, word)
    return expr.otherwise(RISK_WORST)


def summary(scans: DataFrame, as_of: str) -> DataFrame:
    """Number of scans, rounded average score, risk word and minutes since the last scan."""
    a = scans.agg(F.count("*").alias("total_scans"), F.floor(F.avg(F.coalesce("score", F.lit(0))) + 0.5).alias("average_score"), F.max("ts").alias("_last"))
    return a.select(
        "total_scans", "average_score", risk_of(F.col("average_score")).alias("risk"),
        F.expr(f"timestampdiff(MINUTE, cast(_last as timestamp), timestamp '{as_of}')").alias("minutes_since"),
    )


def recent_scans(scans: DataFrame, findings: DataFrame, n: int = RECENT_SCANS) -> DataFrame:
    """Latest ``n`` scans with severity counts; only their findings are read past the join filter."""
    top = scans.orderBy(F.desc("ts"), F.desc("scan_id")).limit(n)
    counts = findings.join(F.broadcast(top.select("scan_id")), "scan_id", "left_semi").groupBy("scan_id").agg(*severity_count_cols())
    j = top.join(F.broadcast(counts), "scan_id", "left")
    return j.select(*scans.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "scan_id"])


def history_card(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One card per scan: type label, grade, score, number of findings and severity counts."""
    scored = scan_score(scans.select("scan_id", "scan_type"), findings)
    return scored.withColumn("label", F.coalesce(F.try_element_at(lit_map(SCAN_TYPE_LABELS), F.col("scan_type")), "scan_type"))
