"""Result cache as tables: load, look up, scan what is new, evict, save, statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.catalog.fixed import CACHE_MAX_ENTRIES, CACHE_TTL_DAYS
from wardlight.operators.ordered import newest_rows


def content_key(*parts):
    """Digest of path and content; the key of a cached result."""
    return F.sha2(F.concat(*parts), 256)


def scan_cache_load(cache: DataFrame, rule_hash: str, as_of: str, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    """Entries of the current rule set that are young enough; an unreadable time counts as expired."""
    at = F.try_to_timestamp("stored_at")
    return cache.filter((F.col("rule_hash") == rule_hash) & (at >= F.expr(f"timestamp '{as_of}' - interval {ttl_days} days")))


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with ``hit`` true or false by content key; the misses are what has to be scanned again."""
    known = cache.select("k", F.lit(True).alias("_hit")).dropDuplicates(["k"])
    return files.join(known, "k", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache.select("k"), "k", "left_anti")


def cache_evict(cache: DataFrame, keep: int = CACHE_MAX_ENTRIES) -> DataFrame:
    """The ``keep`` entries used most often, ties by key (a top-k)."""
    return cache.orderBy(F.desc("access_count"), "k").limit(keep)


def cache_trim_half(cache: DataFrame) -> DataFrame:
    """Newest half (rounded down) by storage time, ties by key; unreadable times count as oldest."""
    timed = cache.withColumn("_s", F.coalesce(F.unix_seconds(F.try_to_timestamp("stored_at")), F.lit(-1).cast("bigint")))
    return newest_rows(timed, cache.count() // 2, "_s", "k").drop("_s")


def scan_cache_save(cache: DataFrame, folder: str, keep: int | None = None) -> str:
    """Write one new version of the whole cache; readers of older versions are not disturbed. With ``keep`` only the entries
    used most often are kept, which is for the caller to ask."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    (cache if keep is None else cache_evict(cache, keep)).write.mode("overwrite").parquet(path)
    return path


def stored_results(spark: SparkSession, folder: str, digest: str, as_of: str, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame | None:
    """``(k, findings)`` of the rule set ``digest``, the newest entry of each key; only this rule set's folder is read. None
    when nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    found = scan_cache_load(spark.read.parquet(folder), digest, as_of, ttl_days)
    return found.groupBy("k").agg(F.max_by("findings", F.try_to_timestamp("stored_at")).alias("findings"))


def incremental_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], digest: str, folder: str, as_of: str, ttl_days: int = CACHE_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """Findings of all ``files (file, content)``, scanning only what is not stored, and the files that were scanned.

    A file is known by path and content under one digest of the rules (``rule_set_hash``), so a change of any of the three
    scans it again. Known files give their stored findings; all others go through ``scan`` (findings with a column
    ``file``), and their results, empty ones too, are appended to the table in ``folder``, a folder for each rule set. The
    append is committed as a whole or not at all, so a run that dies leaves the table as it was. ``files`` has one row per
    path; an entry holds the findings of one file. The first result has a column ``cached``.
    """
    from wardlight.session import checkpointed

    spark = files.sparkSession
    keyed = files.withColumn("k", content_key(F.col("file"), F.lit("\0"), F.col("content")))
    known = stored_results(spark, folder, digest, as_of, ttl_days)
    if known is None:
        misses, hits = checkpointed(keyed), None
    else:
        hits = checkpointed(keyed.select("file", "k").join(known, "k"))
        misses = checkpointed(keyed.join(hits.select("k"), "k", "left_anti"))
    found = checkpointed(scan(misses.select("file", "content")))
    per_file = found.groupBy("file").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "file"])).alias("findings"))
    kind = per_file.schema["findings"].dataType
    entries = misses.select("file", "k").join(per_file, "file", "left").withColumn("findings", F.coalesce("findings", F.array().cast(kind)))
    entries.select("k", "findings", F.lit(as_of).alias("stored_at"), F.lit(digest).alias("rule_hash")).write.mode("append").partitionBy("rule_hash").parquet(folder)
    out = found.withColumn("cached", F.lit(False))
    if hits is not None:
        old = hits.select("file", F.explode("findings").alias("f")).select("file", "f.*").select(*found.columns)
        out = out.unionByName(old.withColumn("cached", F.lit(True)))
    return out, misses.select("file", "k")


def load_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cache_stats(lookups: DataFrame, stored: DataFrame, evicted: DataFrame) -> DataFrame:
    """Hits, misses, total, hit rate in percent, entries stored and evicted."""
    a = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("total"))
    s = stored.agg(F.count("*")).scalar()
    e = evicted.agg(F.count("*")).scalar()
    rate = F.when(F.col("total") > 0, F.round(100.0 * F.col("hits") / F.col("total"), 1)).otherwise(F.lit(0.0))
    return a.select("hits", "misses", "total", rate.alias("hit_rate"), s.alias("stored"), e.alias("evicted"))
