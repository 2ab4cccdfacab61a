"""Detectors on lines and string literals: secrets, entropy, credentials, sensitive files, risky patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import (
    CREDENTIAL_EXCLUDED, CREDENTIAL_MIN_LENGTH, CREDENTIAL_NAMES, ENTROPY_MIN_BITS, ENTROPY_MIN_LENGTH,
    PLACEHOLDER_VALUES, REDOS_MIN_LENGTH, REDOS_PATTERNS, SECRET_PATTERNS, SENSITIVE_FILE_PATTERN,
    SKIPPED_PATH_PARTS,
)
from wardlight.functions.cols import contains_any, entropy_bits, explode_once
from wardlight.operators.dedup import first_by
from wardlight.operators.files import basename

QUOTED_ASSIGNMENT = r"""[A-Za-z_][\w.-]*\s*=\s*(?:"[^"]*"|'[^']*'|`[^`]*`)"""


def detect_secret_patterns(lines: DataFrame, patterns=SECRET_PATTERNS, keep: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """``(keep…, rule_id, ord, pos, match)`` for every match of every pattern.

    All patterns are evaluated in one pass over the rows. Every shipped pattern needs ``=`` or a token prefix, so with
    these a plain substring test drops most lines before any expression runs; a caller's patterns see every line.
    """
    gate = contains_any(F.col("text"), ["=", "sk-", "ghp_", "xoxb-"]) if patterns is SECRET_PATTERNS else F.col("text").isNotNull()
    found = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(rule).alias("rule_id"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"))
        for i, (rule, p) in enumerate(patterns)
    ])
    rows = explode_once(lines.filter(gate), list(keep), F.filter(found, lambda x: F.size(x["m"]) > 0), "f")
    return rows.select(*keep, "f.rule_id", "f.ord", F.posexplode("f.m").alias("pos", "match"))


def unquote(literal) -> Column:
    return F.regexp_replace(F.regexp_replace(literal, "^[\"'`]+", ""), "[\"'`]+$", "")


def detect_secret_entropy(strings: DataFrame, min_length: int = ENTROPY_MIN_LENGTH, min_bits: float = ENTROPY_MIN_BITS) -> DataFrame:
    """Literals longer than ``min_length`` whose entropy exceeds ``min_bits`` bits per character."""
    s = strings.withColumn("value", unquote(F.col("literal"))).filter(F.length("value") > min_length)
    return s.withColumn("bits", entropy_bits(F.col("value"))).filter(F.col("bits") > min_bits)


def quoted_assignments(lines: DataFrame, keep: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """``name = "literal"`` wherever it stands on a line."""
    m = explode_once(lines.filter(F.contains("text", F.lit("="))), list(keep), F.regexp_extract_all("text", F.lit(QUOTED_ASSIGNMENT), F.lit(0)), "_m")
    return m.select(
        *keep, F.regexp_extract("_m", r"^([A-Za-z_][\w.-]*)", 1).alias("target"),
        F.regexp_extract("_m", r"(?s)=\s*(.*)$", 1).alias("literal"),
    )


def detect_credential_variable(assigned: DataFrame) -> DataFrame:
    """Names that speak of a credential with a literal of at least eight characters that is no placeholder."""
    name = F.translate(F.lower("target"), "-.", "__")
    value = unquote(F.col("literal"))
    return assigned.filter(contains_any(name, CREDENTIAL_NAMES)).withColumn("value", value).filter(
        (F.length("value") >= CREDENTIAL_MIN_LENGTH) & ~contains_any(F.lower("value"), CREDENTIAL_EXCLUDED)
    )


def detect_sensitive_file(files: DataFrame) -> DataFrame:
    return files.filter(basename(F.col("file")).rlike(SENSITIVE_FILE_PATTERN))


def secret_fp_filter(hits: DataFrame, value: str = "value") -> DataFrame:
    """Drop hits in test folders, placeholder values and blanks."""
    v = F.lower(F.trim(F.col(value)))
    return hits.filter(
        ~contains_any(F.lower("file"), SKIPPED_PATH_PARTS) & (v != "") & ~contains_any(v, PLACEHOLDER_VALUES)
    )


def secret_dispatch(lines: DataFrame, files: DataFrame, min_bits: float = ENTROPY_MIN_BITS) -> DataFrame:
    """All secret detectors, one row per ``(file, line, rule_id)``."""
    from wardlight.operators.extract import extract_strings

    a = detect_secret_patterns(lines).select("file", "line", "rule_id", F.col("match").alias("value"))
    b = detect_secret_entropy(extract_strings(lines), min_bits=min_bits).select("file", "line", F.lit("secret_entropy").alias("rule_id"), "value")
    c = detect_credential_variable(quoted_assignments(lines)).select("file", "line", F.lit("secret_credential").alias("rule_id"), "value")
    d = detect_sensitive_file(files).select("file", F.lit(0).cast("bigint").alias("line"), F.lit("secret_file").alias("rule_id"), basename(F.col("file")).alias("value"))
    return first_by(a.unionByName(b).unionByName(c).unionByName(d), ["file", "line", "rule_id"], ["value"])


def clean_pattern(literal) -> Column:
    """Pattern text of a literal: quotes, ``r`` prefixes, or slashes with flags removed."""
    return (
        F.when(F.startswith(literal, F.lit("/")) & literal.rlike("(?s)^/.*/"), F.regexp_extract(literal, "(?s)^/(.*)/[^/]*$", 1))
        .when(literal.rlike("^r[\"']"), F.expr("substring({0}, 3, greatest(length({0}) - 3, 0))".format("literal")))
        .when(literal.rlike("^[\"']"), F.expr("substring({0}, 2, greatest(length({0}) - 2, 0))".format("literal")))
        .otherwise(literal)
    )


def detect_redos(strings: DataFrame) -> DataFrame:
    """Literals with nested, repeated-alternative or adjacent unbounded repetition; one hit per line."""
    fit = strings.filter(F.length("literal") >= REDOS_MIN_LENGTH)
    p = fit.withColumn("pattern", clean_pattern(F.col("literal")))
    # the first expression in two linear steps: a repetition inside an open group, then a repeated closing bracket behind it
    behind = F.regexp_extract_all("pattern", F.lit(r"\([^()]*(?:[+*]|\{\d+,?\d*\})(.*)"), F.lit(1))
    nested = F.exists(behind, lambda rest: rest.rlike(r"\)[+*]"))
    shape = F.when(nested, 1).when(F.contains("pattern", F.lit("|")) & F.col("pattern").rlike(REDOS_PATTERNS[1]), 2).when(F.col("pattern").rlike(REDOS_PATTERNS[2]), 3)
    hit = p.withColumn("shape", shape).filter("shape is not null").select("file", "line", "shape", "pattern")
    return first_by(hit, ["file", "line"], ["shape", "pattern"])
