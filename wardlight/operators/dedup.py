"""Deduplication and ordered picks, written as map-side combined aggregations instead of windows.

``min_by`` keeps one candidate per key and task before the shuffle, so a key that holds a third of all rows sends one
row per task rather than its whole group to one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """One row per key: the least in ``order`` (give a total order)."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        df.groupBy(*keyed).agg(F.min_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*")
    )


def dedup_shortest_trace(findings: DataFrame, per_file_class: bool = False) -> DataFrame:
    """Shortest trace per key, earliest ``seq`` on ties.

    Keys: ``(file, vuln_class, line)`` inside an analysis, or ``(file, rule_id, line)`` over all results.
    """
    second = "vuln_class" if per_file_class else "rule_id"
    keys = [F.coalesce("file", F.lit("")), F.coalesce(second, F.lit("")), F.coalesce("line", F.lit(0))]
    return first_by(findings, keys, ["trace_len", "seq"])


def dedup_first_seen(df: DataFrame, keys: list[Column | str], seq: str = "seq") -> DataFrame:
    """First row per key in ``seq`` order."""
    return first_by(df, keys, [seq])


def first_match(text, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first regular expression, in list order, found in ``text``; null when none is."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns])
