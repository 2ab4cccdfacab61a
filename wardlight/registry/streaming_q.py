"""Queries that run the streaming jobs over the tables with an ``availableNow`` trigger."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wardlight.catalog.fixed import SECRET_PATTERNS
from wardlight.registry.core import query
from wardlight.registry.sources_q import scratch_folder
from wardlight.streaming import jobs
from wardlight.views import CALLBACK_COLS, PROBE_COLS, SCAN_COLS, duck, lit


def stream(t, name):
    return jobs.stream_table(t.spark, os.path.join(t.sf_dir, f"{name}.parquet"))


PSQL = " union all ".join(f"select key, line, '{r}' as rule_id, unnest(regexp_extract_all(text, {lit(p)}, 0)) as match from ls" for r, p in SECRET_PATTERNS)


@query("stream_incremental_scan", duck(f"select key, line, rule_id, match from ({PSQL})",
       ls="select key, unnest(generate_series(1,len(string_split(text,chr(10))))) as line, unnest(string_split(text,chr(10))) as text from (select distinct source || ' ' || sha256(source || text) as key, text from documents)"))
def stream_incremental_scan(t):
    """Documents arriving twice a file per source: equal content of one source is scanned once."""
    docs = stream(t, "documents").select(
        F.col("source").alias("file"), F.col("text").alias("content"),
        (F.expr("timestamp '2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, cast(doc_id % 86400 as decimal(18,6)))")).alias("ts"))
    out = jobs.stream_incremental_scan(docs, scratch_folder(t, "stream"))
    return t.spark.read.parquet(out).select(F.concat_ws(" ", "file", "k").alias("key"), "line", "rule_id", "match")


@query("stream_canary_join", duck("""
select p.canary, p.probe_id, c.callback_id from probes p join callbacks c on regexp_extract(c.path,'id-[0-9]+') = p.canary and c.received_at between p.issued_at and p.issued_at + interval 30 minute""", "probes", "callbacks"))
def stream_canary_join(t):
    probes = stream(t, "events").filter("event_type = 'signup'").selectExpr(*PROBE_COLS)
    callbacks = stream(t, "events").filter("event_type = 'purchase'").selectExpr(*CALLBACK_COLS)
    out = jobs.stream_canary_join(probes, callbacks, scratch_folder(t, "stream"), 1800)
    return t.spark.read.parquet(out).select("canary", "probe_id", "callback_id")


@query("stream_findings_trend", duck(
    "select cast(ts::date as varchar) as day, scan_type, count(*) as n_scans, sum(score)::bigint as n_findings from scans group by 1, 2", "scans"))
def stream_findings_trend(t):
    """Daily roll-up per type; the number of findings of a scan stands in its score column here."""
    scans = stream(t, "events").selectExpr(*SCAN_COLS).select("ts", "scan_type", F.col("score").cast("bigint").alias("n_findings"))
    out = jobs.stream_findings_trend(scans, scratch_folder(t, "stream"))
    d = jobs.latest_updates(t.spark, out, ["day", "scan_type"])
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "scan_type", "n_scans", "n_findings")
