"""Checks on single calls that need no flow: shell flag and weak digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import SHELL_FUNCTIONS, WEAK_CRYPTO_TEXTS
from wardlight.functions.cols import contains_any, first_contained
from wardlight.operators.dedup import first_by


def _class_rule(rules: DataFrame, vuln_class: str) -> DataFrame:
    """Least rule id of the class per language; languages without such a rule report nothing."""
    return rules.filter(F.col("vuln_class") == vuln_class).groupBy("language").agg(F.min("rule_id").alias("rule_id"))


def detect_shell_true(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Subprocess calls with the shell flag, once per line; a plain literal command is Low / Tentative."""
    hit = calls.filter(contains_any(F.lower("function_name"), SHELL_FUNCTIONS) & F.contains(F.lower("full_text"), F.lit("shell=true")))
    arg = F.trim(F.get("args", F.lit(0)))
    literal = (arg.rlike('^".*"$') | arg.rlike("^'.*'$")) & ~F.contains(arg, F.lit("+")) & ~F.contains(arg, F.lit("%"))
    h = hit.join(F.broadcast(_class_rule(rules, "CMDi")), "language").select(
        "file", "line", "col", "rule_id", "full_text", F.when(literal, "Low").alias("severity_override"), F.when(literal, "Tentative").alias("confidence_override"))
    return first_by(h, ["file", "line"], ["col"])


def detect_weak_crypto(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls that name a broken algorithm, first listed text wins, once per line."""
    word = first_contained(F.lower("full_text"), [w.lower() for w in WEAK_CRYPTO_TEXTS])
    hit = calls.withColumn("pattern", word).filter("pattern is not null")
    h = hit.join(F.broadcast(_class_rule(rules, "Weak Crypto")), "language").select("file", "line", "col", "rule_id", "pattern")
    return first_by(h, ["file", "line"], ["col"])
