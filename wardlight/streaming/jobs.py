"""Streaming forms of the incremental scan, the callback join and the findings trend.

Each job writes to a folder with its own checkpoint, so it can be stopped, restarted and run continuously or with an
``availableNow`` trigger. Tables written by a run are read back with ``spark.read``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.catalog.fixed import CACHE_TTL_DAYS


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """File stream over a parquet table with the schema it has now; the table may be a folder or a single file.

    The stream source takes a single file only behind a glob, hence the one-letter class at the end of the path.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(df: DataFrame, folder: str, mode: str = "append") -> str:
    """Process what is there and stop; returns the folder of the result."""
    out = f"{folder.rstrip('/')}/out"
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder.rstrip('/')}/state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def run_available_updates(df: DataFrame, folder: str) -> str:
    """Run an update-mode aggregation; every micro-batch writes its changed rows with the batch number."""
    out = f"{folder.rstrip('/')}/out"

    def write(batch: DataFrame, number: int) -> None:
        # one folder per batch number: a repeated batch overwrites itself
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written row per key of an update-mode result."""
    df = spark.read.parquet(path).drop("n")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("r")).select(*keys, "r.*").drop("batch")


def incremental_files(files: DataFrame, at: str = "ts", ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    """Files whose content was not seen during the last ``ttl_days``: what a scan still has to read."""
    keyed = files.withColumn("k", F.sha2(F.concat("file", "content"), 256))
    return keyed.withWatermark(at, f"{ttl_days} days").dropDuplicatesWithinWatermark(["k"])


def stream_incremental_scan(files: DataFrame, folder: str, at: str = "ts", ttl_days: int = CACHE_TTL_DAYS) -> str:
    """New or changed files through the secret patterns, appended to the result folder."""
    from wardlight.operators.lines import source_lines
    from wardlight.operators.secrets import detect_secret_patterns

    fresh = incremental_files(files, at, ttl_days)
    hits = detect_secret_patterns(source_lines(fresh, keep=("file", "k", at)), keep=("file", "k", at, "line"))
    return run_available(hits, folder)


def stream_canary_join(probes: DataFrame, callbacks: DataFrame, folder: str, timeout_seconds: int, delay: str = "1 hour") -> str:
    """Probes with callbacks carrying their id in path or body within the timeout; both sides forget rows behind their watermark."""
    p = probes.withColumn("issued_at", F.col("issued_at").cast("timestamp")).withWatermark("issued_at", delay)
    text = F.concat_ws("\n", "path", "body") if "body" in callbacks.columns else F.col("path")
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit("id-[0-9]+"), F.lit(0)))
    c = callbacks.withColumn("received_at", F.col("received_at").cast("timestamp")).withColumn("cb_canary", F.explode(ids)).withWatermark("received_at", delay)
    late = F.expr(f"received_at >= issued_at and received_at <= issued_at + interval {timeout_seconds} seconds")
    joined = p.join(c, (p["canary"] == c["cb_canary"]) & late)
    return run_available(joined.select("canary", "probe_id", "callback_id", "issued_at", "received_at"), folder)


def stream_findings_trend(scans: DataFrame, folder: str, delay: str = "1 day") -> str:
    """Findings per day and scan type from a stream of scans ``(ts, scan_type, n_findings)``."""
    t = scans.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    agg = t.groupBy(F.window("ts", "1 day"), "scan_type").agg(F.sum("n_findings").alias("n_findings"), F.count("*").alias("n_scans"))
    rows = agg.select(F.col("window.start").alias("day"), "scan_type", "n_findings", "n_scans")
    return run_available_updates(rows, folder)
