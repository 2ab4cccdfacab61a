"""Near-duplicate classes, decontamination, secrets."""

import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.llm.components import components
from wardlight.llm.decontaminate import contamination, decontaminated
from wardlight.llm.order_minhash import aligned, deduplicated, near_duplicates
from wardlight.llm.secret_forest import labelled_findings, lexicon, redacted, secret_findings, secret_model, train_secret_model

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 40), max_size=3))
def test_alignment(a, b, cut):
    for x, y in ((a, b), (a, [v for k, v in enumerate(a) if k not in cut] + b[:2])):
        n = lcs(x, y)
        real = n / (len(x) + len(y) - n) if x and y else 0.0
        got = aligned(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64), 0.8)
        assert abs(got - (real if real >= 0.8 else 0.0)) < 1e-9


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    frame = spark.createDataFrame([(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in edges], "a binary, b binary")
    got = {int(bytes(r.key)): int(bytes(r.label)) for r in components(frame).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def classes(rows):
    shingled = {}
    for i, t in rows:
        w = (t or "").split()
        shingled[i] = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows]
    for x in ids:
        for y in ids:
            a, b = shingled[x], shingled[y]
            if x < y and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)):
                n = lcs(a, b)
                if n / (len(a) + len(b) - n) >= 0.8:
                    p, q = sorted((find(x), find(y)))
                    parent[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates_brute_force(frame):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=rng.randint(6, 160))
        for _ in range(rng.choice([1, 2, 9, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(rows)).collect()}
    assert got == classes(rows)


def test_near_duplicates_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert len(got) == odd.count() and by[1] == by[2] == by[9] == {1} and by[6] == by[10] == {6} and by[4] == {4} and None in by[None] | {None}
    kept = deduplicated(odd)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == odd.columns and ids.count("1") == 1 and "2" not in ids and "9" not in ids and "10" not in ids and {"3", "4", "5", "6", "7", "8"} <= set(ids)
    assert near_duplicates(none).count() == 0 and deduplicated(none).count() == 0


def test_contamination_edges(spark, odd, none):
    items = [(1, " ".join(f"q{k}" for k in range(30))), (2, "short item"), (3, None), (4, ""), (1, " ".join(f"q{k}" for k in range(30))), (5, "one two three four five six")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("w", F.lit("x"))
    filler = " ".join(f"f{k}" for k in range(80))
    leak = filler + " " + items[0][1].upper() + ", " + filler
    edited = filler + " " + items[0][1].replace("q2 ", "zz ") + " " + filler
    rows = [(1, leak), (2, filler), (3, "a Short, item b"), (4, None), (5, ""), (6, edited), (7, " ".join(f"q{k}" for k in range(12))), (None, leak), (1, filler), (8, "two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("len", F.lit(0))
    got = {(r.doc_id, r.item_id): round(r.similarity, 3) for r in contamination(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (None, 1): 1.0, (3, 2): 1.0, (6, 1): round(23 / 29, 3)} or got == {(1, 1): 1.0, (None, 1): 1.0, (3, 2): 1.0}
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "4", "5", "6", "7", "8"]
    assert contamination(none, bench).count() == 0 and contamination(docs, bench.limit(0)).count() == 0 and contamination(odd, bench).count() == 0


def test_secrets_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = lexicon(docs.select(F.col("text").alias("_t")))
    findings = labelled_findings(docs).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(2)))
    model = train_secret_model(findings.filter("h = 0").drop("h"), lex)
    held = findings.filter("h = 1").select(F.xxhash64("text").alias("doc_id"), "text", F.col("path").alias("source"), "start", "end", "label").toPandas()
    texts = held.drop_duplicates("doc_id")[["doc_id", "text", "source"]]
    got = secret_findings(spark.createDataFrame(texts), model).toPandas()
    place = {}
    for r in held.itertuples():
        start = len(r.text.encode()[: r.start].decode())
        place[r.doc_id, start] = r.label
    judged = [(place[r.doc_id, r.start], r.secret) for r in got.itertuples() if (r.doc_id, r.start) in place]
    assert len(judged) > 500 and np.mean([bool(a) == b for a, b in judged]) > 0.93


def test_secrets_in_documents(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secret_model(docs)
    got = secret_findings(docs, model).toPandas().merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    body = pd.Series([t[a:b] for t, a, b in zip(got["text"], got["start"], got["end"], strict=True)])
    planted = body.str.fullmatch("[0-9a-f]{40}")
    assert planted.sum() > 5 and got["secret"][planted].mean() > 0.9 and got["secret"][~planted].mean() < 0.05
    clean = redacted(docs, model)
    assert clean.columns == docs.columns and clean.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0 and clean.count() == docs.count()
    assert secret_findings(odd, model).filter("secret").count() == 0
    assert sorted(map(str, redacted(odd, model).collect())) == sorted(map(str, odd.collect()))
    assert secret_findings(none, secret_model(none)).count() == 0


def near(rng, words, share, k):
    """A text whose words are those of ``words`` but for single ones, so that about ``share`` of the shingles stay."""
    out = list(words)
    changes = max(1, round((1 - share) * len(words) / 5))
    for j, at in enumerate(rng.sample(range(2, len(words) - 2), changes)):
        out[at] = f"c{k}x{j}"
    return " ".join(out)


def test_copies_just_below_the_threshold_make_few_pairs(spark, frame, monkeypatch):
    """2,000 texts near one base, none a near copy of another: pairs grow with the texts, not with their square."""
    import wardlight.llm.order_minhash as module

    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    docs = [(k, near(rng, base, 0.86, k)) for k in range(2000)]
    made = []
    keep = module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append((name, out.count())) or out if (out := keep(df, name)) is not None and name == "pairs" else out)
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(docs, 4)).collect()}
    assert sum(n for _, n in made) < 40 * len(docs)
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    shingled = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in docs}
    ids = rng.sample(range(2000), 120)
    for a in ids:
        for b in ids:
            x, y = shingled[a], shingled[b]
            if a < b and len(x & y) / len(x | y) >= 0.8:
                assert got[a] == got[b]


def test_recall_just_above_the_threshold(spark, frame):
    """Pairs of 0.80 to 0.85, short and over ``SAMPLE`` shingles: at least 99 of 100 share a class."""
    rng = random.Random(12)
    docs, pairs = [], []
    while len(pairs) < 300:
        n = rng.choice([12, 26, 40, 90, 300, 700])
        words = [f"v{len(pairs)}y{k}" for k in range(n)]
        other = near(rng, words, 0.905, 5000 + len(pairs)).split()
        x, y = ({tuple(w[j : j + 5]) for j in range(n - 4)} for w in (words, other))
        s = len(x & y) / len(x | y)
        if 0.8 <= s <= 0.85:
            pairs.append((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(docs, 4)).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.99 * len(pairs) and len(set(got.values())) == len(docs) - found
