"""Texts to numbered lines and back to snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_lines(files: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """One row per line with its 1-based number; row-local, no shuffle."""
    # the outer form keeps the optimizer from splitting every text a second time for a size filter
    rows = files.select(*keep, F.posexplode_outer(F.split("content", r"\r?\n")).alias("_p", "text")).filter(F.col("text").isNotNull())
    return rows.select(*keep, (F.col("_p") + 1).cast("bigint").alias("line"), "text")


def evidence_snippet(hits: DataFrame, files: DataFrame, context: int = 1) -> DataFrame:
    """Numbered lines around each distinct hit ``(file, line)`` of ``files(file, content)``, the hit itself marked.

    Hits are gathered per file (no more numbers than it has lines) and the lines are cut inside the file's own row, so
    only files with hits are taken apart and no line is shuffled.
    """
    wanted = hits.select("file", "line").distinct().groupBy("file").agg(F.collect_set("line").alias("_at"))
    rows = files.select("file", "content").join(wanted, "file").select("file", "_at", F.split("content", r"\r?\n").alias("_l"))
    cut = f"""transform(_at, x -> struct(x as line, array_join(transform(
        sequence(greatest(x - {context}, 1), least(x + {context}, cast(size(_l) as bigint))),
        i -> concat(if(i = x, '→ ', '  '), cast(i as string), ': ', element_at(_l, cast(i as int)))), '\\n') as evidence))"""
    return rows.select("file", F.inline(F.expr(cut)))


def text_cap(col, n: int):
    """First ``n`` characters of a text column."""
    return F.substring(col, 1, n)


def line_event_order(assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """Assignments and calls as one stream in line order, assignments first on the same line."""
    a = assignments.select("file", "line", F.lit(0).alias("kind_ord"), F.lit("assignment").alias("kind"), "seq", "name")
    c = calls.select("file", "line", F.lit(1).alias("kind_ord"), F.lit("call").alias("kind"), "seq", "name")
    return a.unionByName(c).orderBy("file", "line", "kind_ord", "seq")
