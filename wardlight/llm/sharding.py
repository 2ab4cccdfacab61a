"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards sit in racks, racks in regions. A row descends the tree: at each level every child gets an exponential draw
``-ln(u) / weight`` from a hash of the row's key and the child's name, and the smallest draw wins, so a child receives a
share in proportion to the weight below it. A change of one shard's weight changes weights only on its own path: between
regions rows move only to or from its region, inside it only to or from its rack, and subtrees beside the path keep
theirs. ``grown`` opens a region of its own for the new shard; it then takes rows only into itself.

Slots number the rows of a shard without gaps and without a task per shard: placed rows are written once into a folder
per shard, and a row's slot is its index in its file plus the rows of the files before it.

Defined results: the placement depends on the key and the tree only; rows with a null key are placed by their text, and
repeated rows go together; null texts have size 1 and the checksum of the empty text; an empty table gives no rows; a
shard of weight 0 receives nothing; columns other than key and text do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.session import scratch_path

BROADCAST_FILES = 50_000  # the table of files is broadcast up to this many (some 100 bytes each), else joined in a shuffle


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Equal shards, filled rack by rack."""
    return [Shard(s // (racks * per_rack), s // per_rack, s) for s in range(shards)]


def grown(leaves: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, alone in a new rack of a new region."""
    new = [max(getattr(x, level) for x in leaves) + 1 for level in ("region", "rack", "shard")]
    return [*leaves, Shard(*new, weight)]


def winner(key: list[Column], name: str, weights: dict[int, float]) -> Column:
    """The child with the smallest weighted draw; the name of the level and the child salt the hash."""
    draws = []
    for child, weight in sorted(weights.items()):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{name}/{child}"), *key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def place(rows: DataFrame, leaves: list[Shard], key: list[Column], out: str) -> DataFrame:
    """Adds the shard of every row; one projection per level."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")

    def level(parents: str | None, name: str) -> dict[int | None, dict[int, float]]:
        found: dict[int | None, dict[int, float]] = {}
        for x in live:
            below = found.setdefault(getattr(x, parents) if parents else None, {})
            below[getattr(x, name)] = below.get(getattr(x, name), 0.0) + x.weight
        return found

    rows = rows.withColumn("_region", winner(key, "region", level(None, "region")[None]))
    for parent, name, column in (("region", "rack", "_rack"), ("rack", "shard", out)):
        choice = F.lit(None).cast("int")
        for k, weights in level(parent, name).items():
            choice = F.when(F.col(f"_{parent}") == k, winner(key, name, weights)).otherwise(choice)
        rows = rows.withColumn(column, choice)
    return rows.drop("_region", "_rack")


def shard_rows(docs: DataFrame, leaves: list[Shard], after: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (the shard in the tree ``after``, if given)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("_alt"))
    key = [F.col("_id"), F.col("_alt")]
    rows = place(rows, leaves, key, "shard")
    rows = place(rows, after, key, "grown_shard") if after else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.drop("_alt")
    path = scratch_path(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    stored = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = W.partitionBy("_s").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.groupBy(F.col("shard").alias("_s"), "_file").agg(F.count("*").alias("_n"))
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if len(stored.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    out = stored.join(starts, "_file").withColumn("slot", F.col("_start") + F.col("_row"))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")
