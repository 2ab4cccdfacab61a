"""Running numbers and last-value lookups that stay parallel inside one hot group, and exact large top-n.

A plain window puts a whole group into one task. Here each group is cut into chunks of its integer order column;
the window runs per chunk, and only one summary row per chunk takes part in the carry between chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 100_000


def running_number(df: DataFrame, keys: list[str], order: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for an integer ``order`` column."""
    base = df.withColumn("_c", F.floor(F.col(order) / chunk))
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    counts = base.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = base.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_c").orderBy(order)))
    return numbered.join(offsets, [*keys, "_c"]).select(*df.columns, (F.col("_o") + F.col("_r")).alias(out))


def last_before(df: DataFrame, keys: list[str], order: str, value, out: str, chunk: int = CHUNK) -> DataFrame:
    """Largest non-null ``value`` on a strictly earlier row of the same group (values must grow with ``order``)."""
    base = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", value)
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    carry = base.groupBy(*keys, "_c").agg(F.max("_v").alias("_m")).select(*keys, "_c", F.max("_m").over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_c").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = base.withColumn("_l", F.max("_v").over(inside))
    return local.join(carry, [*keys, "_c"]).select(*df.columns, F.coalesce("_l", "_carry").alias(out))


def newest_rows(df: DataFrame, n: int, second: str, key: str) -> DataFrame:
    """Exactly the first ``n`` rows in the order ``second`` descending, ``key`` ascending, for any ``n``.

    ``second`` is a whole number of seconds, ``key`` a hex digest. Three small histograms find the cut: by second,
    by four leading digits inside the boundary second, and by row inside the boundary prefix. Rows on either side of
    the cut are never sorted or moved.
    """
    if n <= 0:
        return df.limit(0)

    def cut(hist: DataFrame, order, want: int):
        """First bucket whose running count reaches ``want`` and the rows before it."""
        run = hist.withColumn("_run", F.sum("_n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        row = run.filter(F.col("_run") >= want).orderBy("_run").select("_b", (F.col("_run") - F.col("_n")).alias("_before")).first()
        return (row["_b"], row["_before"]) if row else (None, 0)

    by_sec = df.groupBy(F.col(second).alias("_b")).agg(F.count("*").alias("_n"))
    sec, before = cut(by_sec, F.desc("_b"), n)
    if sec is None:
        return df
    rest = n - before
    edge = df.filter(F.col(second) == sec)
    by_prefix = edge.groupBy(F.substring(key, 1, 4).alias("_b")).agg(F.count("*").alias("_n"))
    prefix, before = cut(by_prefix, F.asc("_b"), rest)
    rest -= before
    last = edge.filter(F.substring(key, 1, 4) == prefix).orderBy(key).limit(rest)
    whole = df.filter((F.col(second) > sec) | ((F.col(second) == sec) & (F.substring(key, 1, 4) < prefix)))
    return whole.unionByName(last)
