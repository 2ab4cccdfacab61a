"""Checks and statistics over rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import (
    ALLOWED_CLASSES, ALLOWED_CONFIDENCE, BOILERPLATE_REMEDIATION, FORBIDDEN_SINKS, MESSAGE_MIN, REMEDIATION_MIN,
    RULE_FIELDS, SANITIZER_LIKE, TENTATIVE_RULES,
)
from wardlight.functions.cols import contains_any
from wardlight.operators.rules_match import tokens_of


def rule_lint(rules: DataFrame, level: str = "basic") -> DataFrame:
    """``(rule_id, violation, detail)``: all violations of every rule.

    Tests of one rule are row-local; repeated ids come from one aggregation over the ids.
    """
    lists = ("sources", "sinks", "sanitizers")
    checks = []

    def add(cond, name, detail):
        checks.append(F.when(cond, F.struct(F.lit(name).alias("violation"), detail.alias("detail"))))

    for f in RULE_FIELDS:
        empty = F.col(f).isNull() if f in lists or f == "cvss_score" else (F.col(f).isNull() | (F.col(f) == ""))
        add(empty, "missing or empty", F.lit(f))
    add(~F.coalesce(F.trim("vuln_class"), F.lit("")).isin(ALLOWED_CLASSES), "class not allowed", F.coalesce("vuln_class", F.lit("")))
    add(~F.coalesce(F.trim("confidence"), F.lit("")).isin(ALLOWED_CONFIDENCE), "confidence not allowed", F.coalesce("confidence", F.lit("")))
    add(F.length(F.trim(F.coalesce("message", F.lit("")))) < MESSAGE_MIN[level], "message too short", F.lit(str(MESSAGE_MIN[level])))
    add(F.length(F.trim(F.coalesce("remediation", F.lit("")))) < REMEDIATION_MIN[level], "remediation too short", F.lit(str(REMEDIATION_MIN[level])))
    add(F.contains(F.lower(F.coalesce("remediation", F.lit(""))), F.lit(BOILERPLATE_REMEDIATION)), "boilerplate remediation", F.lit(""))
    add(F.col("rule_id").isin(TENTATIVE_RULES) & (F.coalesce("confidence", F.lit("")) != "Tentative"), "must be tentative", F.coalesce("confidence", F.lit("")))
    scalar = F.filter(F.array(*checks), lambda c: c.isNotNull())

    def from_list(col, words, name):
        hit = F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda s: contains_any(F.lower(s), [w.lower() for w in words]))
        return F.transform(hit, lambda s: F.struct(F.lit(name).alias("violation"), s.alias("detail")))

    all_of = F.concat(scalar, from_list("sinks", FORBIDDEN_SINKS, "forbidden sink"), from_list("sources", SANITIZER_LIKE, "sanitizer in sources"))
    local = rules.select("rule_id", F.explode(all_of).alias("v")).select("rule_id", "v.violation", "v.detail")
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n")).filter("n > 1")
    return local.unionByName(twice.select("rule_id", F.lit("duplicate id").alias("violation"), F.col("n").cast("string").alias("detail")))


def rule_corpus_profile(rules: DataFrame) -> DataFrame:
    """``(dimension, value, n_rules)`` over language, class, severity and confidence in one pass, with the number of sink tokens."""
    dims = ["language", "vuln_class", "severity", "confidence"]
    sets = rules.select(*dims).groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count("*").alias("n_rules"), F.grouping_id(*dims).alias("_g"))
    # in the grouping id a zero bit marks the one column that is kept
    codes = {15 - (1 << (3 - i)): d for i, d in enumerate(dims)}
    name = F.coalesce(*[F.when(F.col("_g") == c, F.lit(d)) for c, d in codes.items()])
    out = sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n_rules")
    toks = rules.select(F.explode("sinks").alias("s")).select(F.explode(tokens_of(F.col("s"))).alias("t")).agg(F.countDistinct("t").alias("n_rules"))
    return out.unionByName(toks.select(F.lit("tokens").alias("dimension"), F.lit("").alias("value"), "n_rules"))


def rule_set_hash(rules: DataFrame) -> DataFrame:
    """Digest of a rule set that changes when any rule changes, bodies included, whatever the order of the rows.

    Each rule is hashed in its row; four slices of the hashes are summed and the sums hashed, so no task ever holds
    the whole set.
    """
    body = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in RULE_FIELDS if f not in ("sources", "sinks", "sanitizers", "cvss_score")],
                       F.concat_ws(",", "sources"), F.concat_ws(",", "sinks"), F.concat_ws(",", "sanitizers"))
    h = rules.select(F.sha2(body, 256).alias("h"))
    part = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = h.agg(F.count("*").alias("n_rules"), *part)
    return sums.select("n_rules", F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))
