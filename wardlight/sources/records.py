"""Readers and writers of manifests, recorded responses, history, findings and the scan cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.catalog.fixed import BINARY_TYPE_PREFIXES
from wardlight.functions.cols import any_of


def manifest_read(files: DataFrame) -> DataFrame:
    """``(file, pkg, version)`` of package manifests; development entries win, malformed texts give no row."""
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    both = files.select("file", deps.alias("d")).select(
        "file", F.coalesce("d.dependencies", empty).alias("a"), F.coalesce("d.devDependencies", empty).alias("b")
    )
    only_a = F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k))
    return both.select("file", F.explode(F.map_concat(only_a, F.col("b"))).alias("pkg", "version"))


def response_log_read(responses: DataFrame) -> DataFrame:
    """Recorded responses without binary bodies; bodies are kept whole."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    binary = any_of([F.startswith(kind, F.lit(p)) for p in BINARY_TYPE_PREFIXES])
    return responses.filter(~binary)


# ---------------------------------------------------------------------------- history
def history_append(scans: DataFrame, path: str) -> None:
    """Append scans, one folder per day, so a reader of recent days opens recent folders only."""
    scans.withColumn("scan_date", F.to_date("ts")).write.mode("append").partitionBy("scan_date").parquet(path)


def history_load(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All scans, or those of the days from ``since`` (yyyy-mm-dd) on; older folders are then not opened."""
    scans = spark.read.parquet(path)
    return (scans if since is None else scans.filter(F.col("scan_date") >= F.to_date(F.lit(since)))).drop("scan_date")


def history_read(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; with a limit this is a top-k, without one a range-partitioned sort."""
    out = scans.orderBy(F.desc("ts"), F.desc("scan_id"))
    return out.limit(limit) if limit and limit > 0 else out


# ---------------------------------------------------------------------------- findings as JSON
FINDING_JSON = (
    "id string, rule_id string, vuln_class string, scan_type string, file string, line bigint, url string, "
    "severity string, confidence string, cwe string, owasp string, cvss_score double, cvss_vector string, issue string, "
    "description string, evidence string, "
    "taint_trace array<struct<step:int,line:bigint,file:string,description:string>>, remediation string, tool string"
)
FINDING_DEFAULTS = {
    "id": "", "rule_id": "", "vuln_class": "", "scan_type": "sast", "file": "", "severity": "Medium",
    "confidence": "High", "issue": "", "description": "", "evidence": "", "remediation": "", "tool": "wardlight",
}


def findings_json_export(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per finding, nested trace and scores included; absent values are left out."""
    names = [p.strip().split(" ")[0] for p in FINDING_JSON.replace("array<struct<step:int,line:bigint,file:string,description:string>>", "x").split(",")]
    present = [n for n in names if n in findings.columns]
    return findings.select(*keep, F.to_json(F.struct(*present)).alias("json"))


def findings_json_import(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON objects back to findings; every missing field takes its default."""
    d = texts.select(*keep, F.from_json("json", FINDING_JSON).alias("f")).select(*keep, "f.*")
    for name, default in FINDING_DEFAULTS.items():
        d = d.withColumn(name, F.coalesce(name, F.lit(default)))
    return d.withColumn("taint_trace", F.coalesce("taint_trace", F.array().cast(d.schema["taint_trace"].dataType)))
