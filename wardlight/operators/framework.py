"""Framework detection and the sources each framework adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import FRAMEWORK_ORDER, FRAMEWORK_SIGNALS, FRAMEWORK_SOURCES, GENERIC_CONFIDENCE
from wardlight.functions.cols import lit_map
from wardlight.operators.dedup import first_by


def framework_detect(files: DataFrame) -> DataFrame:
    """Add ``framework`` and ``confidence``: the weights of all signals found, highest sum wins, first declared on ties.

    The signals are a fixed list, so each file is decided in its own row.
    """
    low = F.lower("content")
    scored = []
    for i, name in enumerate(FRAMEWORK_ORDER):
        total = F.lit(0.0)
        for lang, fw, pattern, weight in FRAMEWORK_SIGNALS:
            if fw == name:
                total = total + F.when((F.col("language") == lang) & low.rlike(pattern), weight).otherwise(0.0)
        scored.append(F.struct(total.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("n")))
    best = F.array_max(F.array(*scored))
    out = files.withColumn("_b", best)
    return out.select(
        *files.columns, F.when(F.col("_b.s") > 0, F.col("_b.n")).otherwise("generic").alias("framework"),
        F.when(F.col("_b.s") > 0, F.round(F.least("_b.s", F.lit(1.0)), 6)).otherwise(GENERIC_CONFIDENCE).alias("confidence"),
    )


def framework_sources(framework) -> Column:
    """Sources of a framework together with the generic ones."""
    table = {k: F.array(*[F.lit(s) for s in v]) for k, v in FRAMEWORK_SOURCES.items()}
    flat = [x for k, v in table.items() for x in (F.lit(k), v)]
    return F.array_union(F.try_element_at(F.create_map(*flat), framework), table["generic"])


def framework_augment(detected: DataFrame, rules: DataFrame) -> DataFrame:
    """``(language, framework, rule_id, sources)`` for the frameworks that occur: rule, framework and generic sources.

    A file takes its rules through its framework. The list depends on the framework only, so it is made once per
    framework and not once per file. ``detected`` is the result of ``framework_detect``.
    """
    seen = detected.groupBy("language", "framework").agg(F.count("*").alias("n_files"))
    r = first_by(rules.select("language", "rule_id", "sources"), ["language", "rule_id"], ["sources"])
    return seen.join(r, "language").select("language", "framework", "n_files", "rule_id", F.array_union("sources", framework_sources(F.col("framework"))).alias("sources"))
