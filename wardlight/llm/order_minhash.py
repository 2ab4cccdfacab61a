"""Near-duplicate classes by Order MinHash with a banded alignment behind it.

A text is its sequence of shingles of five words, each labelled with its occurrence number, so repeats count. For each
of ``SKETCHES`` permutations the ``PICK`` smallest labelled shingles are taken and put back in text order; their hash is
a bucket key. Two texts meet in a bucket when they share these shingles in the same order, which follows their edit
similarity. (Texts of more than ``SAMPLE`` shingles first keep the ``SAMPLE`` with the smallest hashes, a sample that two
texts draw alike.) The minima are drawn without replacement, so at a similarity of 0.8 two texts of some hundred
shingles miss all buckets with a chance of 3e-6, and of 25 shingles together with 2e-5, if what they share is in order.

Shorter texts would miss more often (all of them below ``PICK`` shingles), so texts of up to ``SHORT`` shingles have exact
buckets too: a similarity of s needs ceil(s n) common labelled shingles, so two such texts share one of their
n - ceil(s n) + 1 rarest ones, each by the same order of all shingles of short texts.

The similarity of two texts with n and m shingles is L / (n + m - L), L the length of their longest common subsequence
of shingles: the Jaccard similarity of aligned shingles. It is computed exactly by a bit-parallel alignment in a band as
wide as a similarity of ``threshold`` allows. Classes are connected components of the pairs that reach it.

Equal texts are one node, whatever their number. A bucket emits no pair list: each member meets one leader (two rounds;
the first leader is the member in the largest buckets, which is the centre of a group of copies), verified pairs form
classes, and buckets inside one class are closed. In the buckets that are left, texts outside a bucket's largest class are
compared with texts of other classes by an exact prefix filter: the shingles of a text are ordered by the number of open
texts that hold them, and two texts that reach the threshold share a shingle at places i and j that leave
min(n - i, m - j) >= L common ones. Shingles of one text alone come first, so copies that differ from all others in a
ninth of their shingles meet nobody, whatever the size of their group. Each text also carries a bitmap of ``BITS`` bits of
its labelled shingles, which bounds L from above as well. Only pairs within both bounds are made and aligned, and none that
meets in a bucket and reaches the threshold is lost.

Defined results: texts without words (and nulls) are classes of one row; texts of one to four words are one shingle;
repeated rows and equal word sequences share a class; class ids are the smallest id of the class, null ids aside; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.components import components
from wardlight.llm.text import Flat, get, mix, rolling, sequences, slices
from wardlight.session import written

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 32
PICK = 5
SAMPLE = 256
BITS = 1024
SHORT = 25
STAR_ROUNDS = 2


def shingles(flat: Flat, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the text of each; a shorter text is one shingle."""
    h = flat.words(1)
    got, doc = [rolling(h, words, 21)], [np.flatnonzero(flat.inside(words))]
    got[0] = got[0][doc[0]] if len(doc[0]) else np.empty(0, dtype=np.uint64)
    doc[0] = flat.doc[doc[0]]
    for k in range(1, words):
        short = np.flatnonzero(flat.counts == k)
        if len(short):
            got.append(rolling(h, k, 21 + k)[flat.first[short]])
            doc.append(short)
    got, doc = np.concatenate(got), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    return got[order], doc[order]


def text_keys(flat: Flat) -> list[bytes]:
    """128-bit hash of each text's word sequence."""
    both = [sequences(flat.words(seed), flat.first, 30 + seed) for seed in (1, 2)]
    return [x.tobytes() for x in np.stack(both, axis=1)]


def labelled(sh: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingle hashes joined with their occurrence number in the text."""
    key = sh ^ mix(doc.astype(np.uint64) + np.uint64(99))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    nth = np.empty(len(sh), dtype=np.uint64)
    nth[order] = np.arange(len(sh)) - np.repeat(edge, np.diff(np.append(edge, len(sh))))
    return mix(sh + nth * np.uint64(0xD6E8FEB86659FD93))


def bitmaps(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Bitmap of the labelled shingles of each text, as ``BITS // 64`` whole numbers."""
    flags = np.zeros((n, BITS), dtype=bool)
    flags[doc, (x >> np.uint64(20)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(flags, axis=1).view(np.int64)


def sketches(x: np.ndarray, doc: np.ndarray, n: int, count: int = SKETCHES, pick: int = PICK, sample: int = SAMPLE) -> np.ndarray:
    """Bucket keys from labelled shingles, texts x ``count``; rows of texts without shingles are 0."""
    out = np.zeros((n, count), dtype=np.uint64)
    if not len(x):
        return out
    order = np.lexsort((x, doc))
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    keep = np.sort(order[np.arange(len(x)) - first[doc] < sample])  # doc is sorted: rank within the text
    x, doc = x[keep], doc[keep]
    size = np.minimum(size, sample)
    first = np.cumsum(size) - size
    a = mix(np.arange(count, dtype=np.uint64) + np.uint64(1))[None, :, None]
    b = mix(np.arange(count, dtype=np.uint64) + np.uint64(7777))[None, :, None] | np.uint64(1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = 0
    for width in sorted({min(sample, max(pick + 1, 1 << int(s).bit_length())) for s in size[size > 0]}):
        some = np.flatnonzero((size > low) & (size <= width))
        low = width
        for k in range(0, len(some), 32):
            at = some[k : k + 32]
            cell = np.arange(width)[None, :]
            valid = cell < size[at][:, None]
            value = x[np.minimum(first[at][:, None] + cell, len(x) - 1)]
            v = (value[:, None, :] ^ a) * b
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x94D049BB133111EB)
            v = np.where(valid[:, None, :], v, top)
            small = np.sort(np.argpartition(v, pick - 1, axis=2)[:, :, :pick], axis=2)
            taken = np.take_along_axis(np.broadcast_to(value[:, None, :], v.shape), small, axis=2)
            taken = np.where(np.take_along_axis(np.broadcast_to(valid[:, None, :], v.shape), small, axis=2), taken, np.uint64(0))
            key = np.broadcast_to(a[0, :, 0], (len(at), count)).copy()
            for p in range(pick):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + taken[:, :, p])
            out[at] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned Jaccard similarity of two shingle sequences, or 0 when it is below ``threshold``."""
    n, m = len(a), len(b)
    need = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
    if not n or not m or min(n, m) < need:
        return 0.0
    if len(np.intersect1d(a, b)) * max(np.unique(a, return_counts=True)[1].max(), 1) < need:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    band = max(n, m) - need
    same = head + tail
    if x and y:
        where: dict[int, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row, strip = full, (1 << (2 * band + 1)) - 1
        for j, c in enumerate(y):
            hit = where.get(c, 0)
            if hit:
                hit &= strip << (j - band) if j >= band else strip >> (band - j)
                u = row & hit
                row = ((row + u) | (row - u)) & full
        same += len(x) - row.bit_count()
    similarity = same / (n + m - same)
    return similarity if same >= need else 0.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts reach ``threshold``, with their similarity."""

    def align(batches):
        for part in slices(slices(batches, "_ta"), "_tb"):
            sides = []
            for c in ("_ta", "_tb"):
                sh, doc = shingles(Flat(get(part, c)), words)
                sides.append((sh, np.searchsorted(doc, np.arange(part.num_rows + 1))))
            (sa, fa), (sb, fb) = sides
            s = np.array([aligned(sa[fa[k] : fa[k + 1]], sb[fb[k] : fb[k + 1]], threshold) for k in range(part.num_rows)])
            ok = pa.array(np.flatnonzero(s > 0))
            yield pa.record_batch([get(part, "a").take(ok), get(part, "b").take(ok), pa.array(s).take(ok)], ["a", "b", "similarity"])

    left = texts.select(F.col("key").alias("a"), F.col("_t").alias("_ta"))
    right = texts.select(F.col("key").alias("b"), F.col("_t").alias("_tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb").mapInArrow(align, "a binary, b binary, similarity double")


def prefixes(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """(key, x, i): labelled shingles ``x`` of each text and their places ``i`` when the text's shingles are ordered by the
    number of texts that hold them; only those places that a common shingle of two near copies can have first."""

    def each(batches):
        for part in slices(batches, "_t"):
            sh, doc = shingles(Flat(get(part, "_t")), words)
            x = labelled(sh, doc) if len(sh) else sh
            size = np.bincount(doc, minlength=part.num_rows)
            yield pa.record_batch([get(part, "key").take(pa.array(doc)), pa.array(x.view(np.int64)), pa.array(size[doc])], ["key", "x", "n"])

    rows = texts.select("key", "_t").mapInArrow(each, "key binary, x long, n long")
    rows = written(rows, "open_shingles")
    held = rows.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1")  # a shingle of one text stands first and is shared with none
    lists = rows.join(held, "x").groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "x"))).alias("r"))
    spare = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)
    room = F.greatest(spare + 1 - (F.col("n") - F.size("r")), F.lit(0)).cast("int")
    at = lists.select("key", (F.col("n") - F.size("r")).alias("own"), F.posexplode(F.slice("r", 1, room)).alias("p", "e"))
    return at.select("key", F.col("e.x").alias("x"), (F.col("own") + F.col("p")).alias("i"))


def short_buckets(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, n, at, bucket) of the rarest labelled shingles of short texts, so many that no two near copies share none."""
    each = nodes.filter(f"n <= {SHORT}").select("key", "n", F.explode("few").alias("x"))
    each = each.join(each.groupBy("x").agg(F.count("*").alias("c")), "x")
    rare = each.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("c", "x"))).filter(f"c > 1 and r <= n - ceil({threshold} * n - 1e-9) + 1")
    return rare.select("key", "n", F.lit(SKETCHES).alias("at"), F.xxhash64("x", F.lit("short")).alias("bucket"))


def merged(classes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``classes`` (key, label) after more ``edges`` (a, b): whole classes are joined, as single nodes."""
    if classes is None:
        return components(edges)
    for c in ("a", "b"):
        own = classes.select(F.col("key").alias(c), F.col("label").alias("_l"))
        edges = edges.join(own, c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    joined = components(edges.select("a", "b").filter("a != b"))
    after = classes.join(joined.select(F.col("key").alias("label"), F.col("label").alias("_l")), "label", "left").select("key", F.coalesce("_l", "label").alias("label"))
    return written(after.unionByName(joined.join(classes.select("key"), "key", "left_anti").select("key", "label")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, the text hash ``_k`` and ``_label``, the class as a key
    that is null only for texts without words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_k", F.xxhash64("_t"))
    kind = rows.schema["_id"].dataType.simpleString()

    def sketch(batches):
        for part in slices(batches, "_t"):
            flat = Flat(get(part, "_t"))
            sh, doc = shingles(flat, words)
            x = labelled(sh, doc) if len(sh) else sh
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(flat.n + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1))) for v in (sketches(x, doc, flat.n).view(np.int64), bitmaps(x, doc, flat.n))]
            n = np.bincount(doc, minlength=flat.n)
            few = np.where(n <= SHORT, n, 0)
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(few))).astype(np.int32)), pa.array(x[few[doc] > 0].view(np.int64))))
            yield pa.record_batch([get(part, "_id"), get(part, "_k"), pa.array(text_keys(flat), pa.binary()), pa.array(n), *lists], ["_id", "_k", "key", "n", "sk", "bm", "few"])

    table = written(rows.mapInArrow(sketch, f"_id {kind}, _k long, key binary, n long, sk array<long>, bm array<long>, few array<long>"), "sketches")
    nodes = table.filter("n > 0").groupBy("key").agg(F.min("_id").alias("_id"), F.min(F.struct("_id", "_k")).alias("row"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("bm").alias("bm"), F.first("few").alias("few"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    every = nodes.select("key", "n", F.posexplode("sk").alias("at", "bucket")).union(short_buckets(nodes, threshold))
    shared = every.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    several = every.join(shared, "bucket").withColumn("hub", F.sum("c").over(W.partitionBy("key"))).drop("c")  # a key has ``SKETCHES`` rows and a few
    members = written(several.join(nodes.select("key", "bm"), "key"), "members")

    wanted = members.select("key").distinct().join(nodes.select("key", F.col("row._id").alias("_id2"), F.col("row._k").alias("_k")), "key")
    texts = rows.join(wanted, (rows["_k"] == wanted["_k"]) & rows["_id"].eqNullSafe(F.col("_id2"))).select("key", "_t")
    texts = written(texts.dropDuplicates(["key"]), "texts")

    need = f"ceil({threshold / (1 + threshold)} * (n + m) - 1e-9)"
    missing = ["+".join(f"bit_count({a}[{k}] & ~{b}[{k}])" for k in range(BITS // 64)) for a, b in (("bm", "bm2"), ("bm2", "bm"))]
    close = F.expr(f"least(n, m) >= {need} and n - ({missing[0]}) >= {need} and m - ({missing[1]}) >= {need}")
    pair = [F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")]
    tested = classes = None
    open_members = members.withColumn("class", F.col("key"))
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            rank = F.struct("hub", "key") if turn == 0 else F.struct(F.xxhash64("key", "bucket"), "key")
            lead = open_members.groupBy("bucket").agg(F.max_by(F.struct("key", "n", "class", "bm"), rank).alias("_l"))
            pairs = open_members.join(lead, "bucket").select("key", "n", "class", "bm", F.col("_l.key").alias("other"), F.col("_l.n").alias("m"), F.col("_l.class").alias("c2"), F.col("_l.bm").alias("bm2"))
            pairs = pairs.filter("class != c2").filter(close).select(*pair)
        else:
            sizes = open_members.groupBy("bucket", "class").agg(F.count("*").alias("c"))
            main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "class")).alias("_m")).select("bucket", F.col("_m.class").alias("main"))
            placed = open_members.join(main, "bucket").groupBy("key").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.first("bm").alias("bm"), F.max(F.col("class") != F.col("main")).alias("aside"))
            placed = written(placed, "placed")
            rare = prefixes(texts.join(placed.select("key"), "key", "left_semi"), threshold, words).join(placed.drop("bm"), "key")
            band = lambda c: F.floor(F.log(c) / math.log(1.02)).cast("int")
            least = F.ceil(threshold * F.col("n") - 1e-9)
            most = F.floor((F.col("n") - F.col("i")) * (1 + threshold) / threshold - F.col("n") + 1e-6)  # lengths of texts that can still reach it
            rare = written(rare.withColumns({"own": band(F.col("n")), "least": least, "most": most}).filter("most >= least").withColumn("fits", F.sequence(band(F.col("least")), band(F.col("most")))), "prefixes")
            left = rare.filter("aside").select("key", "x", "i", "n", "class", F.col("own").alias("from"), F.explode("fits").alias("to"))
            right = rare.select(F.col("key").alias("other"), "x", F.col("i").alias("j"), F.col("n").alias("m"), F.col("class").alias("c2"), F.explode("fits").alias("from"), F.col("own").alias("to"))
            met = left.join(right, ["x", "from", "to"]).filter(F.expr(f"class != c2 and n - i >= {need} and m - j >= {need}")).select("key", "other", "n", "m").distinct()
            maps = placed.select("key", "bm")
            pairs = met.join(maps, "key").join(maps.select(F.col("key").alias("other"), F.col("bm").alias("bm2")), "other").filter(close).select(*pair)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(verified(pairs, texts, threshold, words), "found")
        classes = merged(classes, found)
        if turn < STAR_ROUNDS:
            now = members.join(classes, "key", "left").select("bucket", "at", "key", "n", "hub", "bm", F.coalesce("label", "key").alias("class"))
            mixed = now.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x != y").select("bucket")
            open_members = written(now.join(mixed, "bucket"), "open")

    grouped = nodes.select("key", "_id", "copies").join(classes, "key", "left").filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "key"))
    lowest = grouped.groupBy("label").agg(F.min("_id").alias("_class"))
    by_key = grouped.select("key", "label").join(lowest, "label").select("key", "label", "_class")
    out = table.select("_id", "_k", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(by_key, "key", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_class", "_id").alias("class_id"), "_k", F.coalesce("label", "key").alias("_label"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id (texts without words stay), with all columns."""
    near = near_duplicates(docs, id_col, text_col)
    best = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("_id"), F.col("_k")))
    keep = near.filter("_label is not null").groupBy("_label").agg(best.alias("r"))
    keep = written(keep.select(F.xxhash64("r._id").alias("_i"), F.col("r._k").alias("_k")), "keep")
    rows = docs.withColumns({"_i": F.xxhash64(id_col), "_k": F.xxhash64(text_col)})
    empty = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    kept = rows.filter(~empty).join(keep, ["_i", "_k"]).dropDuplicates(["_i", "_k"])
    return kept.unionByName(rows.filter(empty)).drop("_i", "_k")
