"""Benchmark decontamination with SimHash fingerprints of item-sized windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are five consecutive words (an item of fewer words is one shingle).

1. Windows as long as an item are taken where a document holds one of that item's shingles, laid so that the shared
   shingle falls on its place in the item. A similarity of 0.8 needs shared shingles, so no leak is without a window.
2. Each window and item gets a 64-bit SimHash of its words, weighted by how often they occur in it.
3. Multi-index: the fingerprint is cut into ``RADIUS + 1`` blocks. Two fingerprints that differ in at most ``RADIUS`` bits
   agree in one block at least, so joining on (length, block, bits) finds every item within the radius of a window.
4. A leak may lie beyond the radius (changed or missing words move more than ``RADIUS`` bits), so an item is also compared
   with every window that holds one of its rarest shingles: of m shingles a similarity of s needs ceil(s m), so at least one
   of any m - ceil(s m) + 1 is in the window. No item that reaches the threshold is lost.
5. Candidates are verified by the exact weighted Jaccard similarity of shingles (minimum over maximum of their counts), for
   windows that the item itself lays.

Only the shingles of the benchmark are broadcast, and only up to ``BROADCAST_SHINGLES``; larger ones are joined in a shuffle.

Defined results: one row per document row and item, for the most similar window (the first on ties); null or wordless
documents and items match nothing; a window may hang over an end of its document, where it has fewer shingles; repeated
items with one id are one; rows that repeat an id are told apart by ``_k``, the hash of their text; an empty table gives no
rows; other columns, such as a column ``text`` on both sides, do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.session import written

WORDS = 5
THRESHOLD = 0.8
RADIUS = 14
BROADCAST_SHINGLES = 2_000_000


def words_of(text: str) -> str:
    return f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x != '')"


def shingled(words: str, k: int) -> str:
    """Hashes of the ``k``-word shingles of an array of words."""
    return f"if(size({words}) >= {k}, transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k}))), cast(array() as array<long>))"


def simhash(features: str) -> str:
    """64-bit SimHash of an array of hashes; a feature counts as often as it occurs."""
    return (f"aggregate(sequence(0, 63), 0L, (acc, j) -> acc | if(2 * aggregate({features}, 0L, (a, h) -> a + (shiftrightunsigned(h, j) & 1L)) > size({features}),"
            " shiftleft(1L, j), 0L))")


def blocks(fingerprint: str, radius: int) -> str:
    """(block, bits) of a fingerprint, ``radius + 1`` of them."""
    n = radius + 1
    cuts = [b * 64 // n for b in range(n + 1)]
    each = [f"struct({b} as block, shiftrightunsigned({fingerprint}, {lo}) & {(1 << (hi - lo)) - 1}L as bits)" for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return f"explode(array({', '.join(each)}))"


# the item lays the window: they share a shingle at one place
LAID = "exists(zip_with(s, slice(t, greatest(-start, 0) + 1, size(t)), (x, y) -> x <=> y), z -> z)"

# sum of the smaller counts of each common hash
OVERLAP = "aggregate(array_intersect(s, t), 0L, (a, x) -> a + least(size(filter(s, y -> y = x)), size(filter(t, y -> y = x))))"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, similarity, first_word, ``_k``) of every document row and item with a window of at least ``threshold``."""
    items = benchmark.select("item_id", F.expr(words_of("text")).alias("w")).filter("size(w) > 0").distinct()
    items = items.withColumn("len", F.size("w")).withColumn("k", F.least(F.lit(WORDS), F.col("len")))
    items = items.withColumn("t", F.expr(" ".join(["case k", *(f"when {k} then {shingled('w', k)}" for k in range(1, WORDS + 1)), "end"])))
    items = items.withColumn("fp", F.expr(simhash("transform(w, x -> xxhash64(x))"))).withColumn("item", F.xxhash64("item_id", "t", "k"))
    items = written(items.select("item", "item_id", "len", "k", "t", "fp"), "items")
    places = written(items.select("len", "k", F.posexplode("t").alias("at", "h")).distinct(), "places")
    kinds = sorted(r["k"] for r in places.select("k").distinct().collect())  # at most WORDS values
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_k"), F.expr(words_of(f"`{text_col}`")).alias("w"))
    hits = None
    for k in kinds:
        each = rows.select("_id", "_k", F.posexplode(F.expr(shingled("w", k))).alias("pos", "h"))
        each = each.join(places.filter(F.col("k") == k).drop("k"), "h").select("_id", "_k", (F.col("pos") - F.col("at")).alias("start"), "len", F.lit(k).alias("k"), "h", "pos")
        hits = each if hits is None else hits.union(each)
    if hits is None:
        hits = rows.limit(0).select("_id", "_k", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("pos"))
    hits = written(hits, "hits")
    exact = written(sharing(hits, items, threshold), "sharing")
    wanted = written(hits.groupBy("_id", "_k").agg(F.collect_set(F.struct("start", "len", "k")).alias("wins")), "windows")
    wanted = wanted.select(F.col("_id").alias("_id2"), F.col("_k").alias("_k2"), "wins")

    found = rows.join(wanted, (F.col("_k") == F.col("_k2")) & F.col("_id").eqNullSafe(F.col("_id2"))).select("_id", "_k", "w", "wins")
    cut = "transform(wins, x -> struct(x.start as start, x.len as len, x.k as k, slice(w, greatest(x.start, 0) + 1, x.len + least(x.start, 0)) as w))"
    wins = found.select("_id", "_k", F.explode(F.expr(cut)).alias("x")).select("_id", "_k", "x.*")
    wins = wins.withColumn("s", F.expr(" ".join(["case k", *(f"when {k} then {shingled('w', k)}" for k in range(1, WORDS + 1)), "end"])))
    wins = wins.withColumn("fp", F.expr(simhash("transform(w, x -> xxhash64(x))"))).select("_id", "_k", "start", "len", "k", "s", "fp")
    laid = written(wins, "laid")
    wins = laid.select("*", F.expr(blocks("fp", radius)).alias("b")).select("_id", "_k", "start", "len", "k", "fp", "b.*")
    index = items.select("item", "len", F.col("fp").alias("fp2"), F.expr(blocks("fp", radius)).alias("b")).select("item", "len", "fp2", "b.*")

    pairs = wins.join(index, ["len", "block", "bits"]).filter(F.expr(f"bit_count(fp ^ fp2) <= {radius}"))
    names = ["_id", "_k", "start", "len", "k", "item"]
    pairs = pairs.select(names).union(exact.select(names)).distinct().withColumnsRenamed({"_id": "_id2", "_k": "_k2", "start": "start2", "len": "len2", "k": "k2"})
    same = F.col("_id").eqNullSafe(F.col("_id2")) & F.expr("_k = _k2 and start = start2 and len = len2 and k = k2")
    pairs = laid.drop("fp").join(pairs, same).join(items.select("item", "item_id", "t"), "item").filter(F.expr(LAID))
    pairs = pairs.withColumn("o", F.expr(OVERLAP)).withColumn("similarity", F.col("o") / (F.size("s") + F.size("t") - F.col("o")))
    best = pairs.filter(F.col("similarity") >= threshold).groupBy("_id", "_k", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("n"))).alias("m"))
    return best.select(F.col("_id").alias(id_col), "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.n")).alias("first_word"), "_k")


def sharing(hits: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(id, window, item) of each window that holds one of the item's rarest shingles, so many that a leak cannot lack all."""
    each = items.select("item", "len", "k", F.size("t").alias("m"), F.posexplode("t").alias("at", "h"))
    each = each.join(each.groupBy("k", "h").agg(F.count("*").alias("c")), ["k", "h"])
    rare = each.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy("c", "h", "at"))).filter(F.expr(f"r <= m - ceil({threshold} * m - 1e-9) + 1"))
    rare = rare.select("item", F.col("len").alias("len2"), "k", "h").distinct()
    held = hits.select("_id", "_k", "k", "h", "pos").distinct().join(rare, ["k", "h"])
    held = held.select(F.col("_id").alias("_id2"), F.col("_k").alias("_k2"), F.col("k").alias("k2"), "len2", "pos", "item", F.floor(F.col("pos") / F.col("len2")).alias("slot2"))
    slots = F.array(F.floor(F.col("start") / F.col("len")), F.floor(F.col("start") / F.col("len")) + 1)  # a window touches two
    laid = hits.select("_id", "_k", "start", "len", "k").distinct().withColumn("slot", F.explode(slots))
    same = F.col("_id").eqNullSafe(F.col("_id2")) & F.expr("_k = _k2 and k = k2 and len = len2 and slot = slot2 and pos between start and start + len - k")
    return laid.join(held, same).select("_id", "_k", "start", "len", "k", "item").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns."""
    bad = written(contamination(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_id2"), F.col("_k").alias("_k2")).distinct(), "leaks")
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_id2")) & (F.xxhash64(docs[text_col]) == F.col("_k2")), "left_anti")
