"""Data steps around replies and patches: advisories, prompts, fences, patch application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import REFUSAL_PHRASES, REPLY_MIN_CHARS
from wardlight.functions.cols import contains_any


def advisory_match(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages ``(file, pkg, version)`` whose version starts with a prefix of their advisory ``(pkg, prefixes, severity)``."""
    j = deps.join(advisories, "pkg")
    return j.filter(F.exists("prefixes", lambda p: F.startswith(F.col("version"), p))).select("file", "pkg", "version", "severity")


def detect_env_debug(lines: DataFrame) -> DataFrame:
    """Lines of ``.env`` files that switch debugging on; blank and comment lines skipped."""
    t = F.trim("text")
    on = F.contains(F.upper(t), F.lit("DEBUG")) & (F.contains(F.upper(t), F.lit("TRUE")) | F.contains(t, F.lit("1")))
    return lines.filter(F.lower(F.regexp_replace("file", "^.*/", "")) == ".env").filter((t != "") & ~F.startswith(t, F.lit("#")) & on).select("file", "line", t.alias("evidence"))


def detect_privileged_container(lines: DataFrame) -> DataFrame:
    """Compose lines that ask for privileged mode."""
    base, low = F.lower(F.regexp_replace("file", "^.*/", "")), F.lower("text")
    on = F.contains(low, F.lit("privileged: true")) | F.contains(low, F.lit('privileged: "true"'))
    return lines.filter(base.isin("docker-compose.yml", "docker-compose.yaml") & on).select("file", "line", F.trim("text").alias("evidence"))


def prompt_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One request text per finding ``(seq, file, line, issue)`` with the content of its file; missing files drop out."""
    j = findings.join(files.select("file", "content"), "file")
    text = F.concat(F.lit("A scan reported: "), "issue", F.lit("\nWhere: "), "file", F.lit(", line "), F.col("line").cast("string"),
                    F.lit("\nRewrite the file below so that the report no longer applies; answer with the file only.\n---\n"), "content")
    return j.select("seq", "file", text.alias("prompt"))


def fence_strip(text):
    """First fenced block of a reply, else the whole reply, trimmed."""
    block = F.regexp_extract(text, r"(?s)```\w*\n(.*?)\n```", 1)
    return F.trim(F.when(block != "", block).otherwise(text), F.lit(" \n\r\t"))


def reply_quality_filter(replies: DataFrame, text: str = "text") -> DataFrame:
    """Replies of at least fifty characters without a refusal."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\r\t"))
    return replies.filter((F.length(t) >= REPLY_MIN_CHARS) & ~contains_any(F.lower(t), REFUSAL_PHRASES))


def patch_apply(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Contents with all patches ``(file, seq, old, new)`` applied in order, each replacing every occurrence.

    Applying patches is a fold in order per file. Findings are unique per line and rule, so the list folded for one file
    is bounded by its own text. Empty texts and files without content are skipped.
    """
    good = patches.filter("old <> '' and new <> ''")
    lists = good.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("_p"))
    j = files.join(lists, "file")
    return j.select("file", F.aggregate("_p", F.col("content"), lambda c, p: F.replace(c, p["old"], p["new"])).alias("content"), F.size("_p").alias("n_patches"))
