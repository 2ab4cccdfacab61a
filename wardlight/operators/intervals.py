"""Point-in-interval joins by bucket, so a group never meets all of its intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 256


def _bucketed(spans: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    return spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))


def enclosing_function(points: DataFrame, spans: DataFrame, key: str = "file", line: str = "line", bucket: int = BUCKET) -> DataFrame:
    """Add ``func`` (innermost span that holds the line, else ``<module>``) and ``func_start`` (0 for the module).

    ``spans`` is ``(key, name, start_line, end_line)``. Points and spans meet on ``(key, bucket)``; the innermost span
    is taken by a map-side combined ``max_by``.
    """
    s = _bucketed(spans.select(key, F.col("name").alias("_n"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e")), "_s", "_e", bucket)
    p = points.select(key, line).distinct().withColumn("_b", F.floor(F.col(line) / bucket))
    inside = p.join(s, [key, "_b"]).filter(F.col(line).between(F.col("_s"), F.col("_e")))
    best = inside.groupBy(key, line).agg(F.max(F.struct("_s", "_n")).alias("_f"))
    return points.join(best, [key, line], "left").select(
        *points.columns, F.coalesce("_f._n", F.lit("<module>")).alias("func"), F.coalesce("_f._s", F.lit(0)).cast("bigint").alias("func_start")
    )


def module_scope_filter(points: DataFrame, spans: DataFrame, key: str = "file", line: str = "line", bucket: int = BUCKET) -> DataFrame:
    """Rows outside every span."""
    s = _bucketed(spans.select(key, F.col("start_line").alias("_s"), F.col("end_line").alias("_e")), "_s", "_e", bucket)
    p = points.withColumn("_b", F.floor(F.col(line) / bucket))
    cond = (p[key] == s[key]) & (p["_b"] == s["_b"]) & p[line].between(s["_s"], s["_e"])
    return p.join(s, cond, "left_anti").drop("_b")
