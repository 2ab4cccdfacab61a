"""File routing, the keyword gate and path tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import CONFIG_CHECK_BY_NAME, LANGUAGE_BY_EXT, MIN_KEYWORD_LEN, STRING_MARKS
from wardlight.functions.cols import lit_map
from wardlight.operators.patterns import PatternSet


def basename(path) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def extension(path) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def with_language(files: DataFrame) -> DataFrame:
    """Add ``language`` by extension (null for unknown); a literal map, so no join and no shuffle."""
    return files.withColumn("language", F.try_element_at(lit_map(LANGUAGE_BY_EXT), extension(F.col("file"))))


def file_route(files: DataFrame) -> DataFrame:
    """``(file, ext, language, config_check)``: which extractor or configuration check takes the file."""
    base = F.lower(basename(F.col("file")))
    return with_language(files.select("file")).select(
        "file", extension(F.col("file")).alias("ext"), "language",
        F.try_element_at(lit_map(CONFIG_CHECK_BY_NAME), base).alias("config_check"),
    )


def keywords(patterns: list[str]) -> list[str]:
    """Dotted parts longer than two characters, lower case."""
    parts = {p.lower() for text in patterns for p in text.replace("::", ".").split(".")}
    return sorted(p for p in parts if len(p) >= MIN_KEYWORD_LEN)


def prescan_gate(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep files that hold a string mark, or a keyword (see ``keywords``) of a sink or a source of any rule.

    The cheap marks come first; the keywords are looked for, all in one pass, only in the few files without any of them.
    """
    content = F.col("content")
    marks = F.lit(False)
    for m in STRING_MARKS:
        marks = marks | F.contains(content, F.lit(m))
    both = F.concat(F.coalesce("sinks", F.array().cast("array<string>")), F.coalesce("sources", F.array().cast("array<string>")))
    parts = F.filter(F.flatten(F.transform(both, lambda p: F.split(F.replace(p, F.lit("::"), F.lit(".")), r"\."))), lambda w: F.length(w) >= MIN_KEYWORD_LEN)
    words = PatternSet(rules.select(F.lit("").alias("language"), F.lit("").alias("rule_id"), parts.alias("words")), "words")
    return files.filter(marks | (F.size(words.inside(F.when(~marks, content), language=F.lit(""))) > 0))


def static_asset_filter(df: DataFrame, suffixes: list[str], url: str = "url") -> DataFrame:
    """Drop rows whose URL path ends in an asset suffix."""
    path = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")))
    pattern = "(" + "|".join("\\Q" + s + "\\E" for s in suffixes) + ")$"
    return df.filter(~path.rlike(pattern))
