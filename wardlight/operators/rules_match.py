"""Joining texts with rules: sink lookup, scans, sources, sanitizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.cols import explode_once
from wardlight.operators.dedup import first_by
from wardlight.operators.patterns import PatternSet, patterns_of
from wardlight.session import dealt

SPLIT = r"[.\s:>(]+"


def tokens_of(text) -> Column:
    """Lower-case whole text, its parts longer than one character and its last dotted part."""
    t = F.lower(F.trim(text))
    parts = F.filter(F.split(t, SPLIT), lambda p: F.length(p) > 1)
    last = F.when(F.contains(t, F.lit(".")), F.array(F.substring_index(t, ".", -1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(t), parts, last))


def rule_index_build(rules: DataFrame) -> DataFrame:
    """Inverted index ``(language, token, rule_id)``; a set of rows, so a token in every rule stays spread out.

    Rules meet by id before their tokens are taken, so tokens are compared within a part and not shuffled.
    """
    s = dealt(rules.select("language", "rule_id", "sinks"), "language", "rule_id", grows=16).withColumn("sink", F.explode("sinks"))
    return explode_once(s, ["language", "rule_id"], tokens_of(F.col("sink")), "token").distinct()


def unique_rules(rules: DataFrame) -> DataFrame:
    """One row per rule id; of several the least over all fields, so the pick does not depend on the order of rows."""
    return first_by(rules, ["rule_id"], [c for c in rules.columns if c != "rule_id"])


def sink_candidates(calls: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("file", "line", "col"), sinks: PatternSet | None = None) -> DataFrame:
    """``(keep…, function_name, rule_id)``: rules with a sink that shares a token with the call head and lies inside the call.

    All sinks inside a call are found in one pass over its text, whatever their number; tokens are compared on these
    hits only, and the rules of a sink are looked up by equality.
    """
    sinks = sinks or PatternSet(rules, "sinks")
    c = calls.select("language", *keep, "function_name", F.lower("full_text").alias("_t"), F.lower("function_name").alias("_f"))
    head = F.array_union(tokens_of(F.col("_f")), tokens_of(F.substring_index("_t", "(", 1)))
    hit = sinks.contained(c, F.concat_ws("\n", "_t", "_f")).filter(F.arrays_overlap(tokens_of(F.col("pattern")), head))
    return hit.join(sinks.looked_up, ["language", "pattern"]).select(*keep, "function_name", "rule_id").distinct()


def pattern_scan(df: DataFrame, text, rules: DataFrame, kind: str) -> DataFrame:
    """``df`` with one row per rule and pattern of ``kind`` contained in ``text`` (columns ``rule_id``, ``pattern``)."""
    return PatternSet(rules, kind).matches(df, text)


def sink_match_scan(calls: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("file", "line", "col")) -> DataFrame:
    """Sinks inside a call or its name, by trying every sink of the language on every call: the plain measure of the index.

    Its time grows with the number of rules; ``sink_candidates`` is the one to use.
    """
    both = F.lower(F.concat_ws("\n", "full_text", "function_name"))
    c = calls.select("language", *keep, "function_name", both.alias("_t")).join(patterns_of(rules, "sinks"), "language")
    return c.filter(F.contains("_t", F.col("pattern"))).select(*keep, "function_name", "rule_id").distinct()


def source_attribution(df: DataFrame, text: str, rules: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``(keep…, rule_id)``: rules one of whose sources occurs in the text."""
    return pattern_scan(df.select("language", *keep, text), F.col(text), rules, "sources").select(*keep, "rule_id").distinct()


def sanitizer_exclude(hits: DataFrame, rules: DataFrame, text: str = "full_text") -> DataFrame:
    """Drop hits whose text contains one of the rule's sanitizers."""
    san = rules.select("rule_id", F.explode("sanitizers").alias("_s")).select("rule_id", F.lower("_s").alias("_s")).distinct()
    cond = (hits["rule_id"] == san["rule_id"]) & F.contains(F.lower(hits[text]), san["_s"])
    return hits.join(san, cond, "left_anti")
