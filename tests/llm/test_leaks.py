"""Leaks just above the threshold, changed and truncated, against the SQL definition."""

import random

import duckdb
import pandas as pd

from wardlight.llm.decontaminate import contamination
from wardlight.llm.oracles import CONTAMINATION


def test_leaks_near_the_threshold(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(rng.randint(24, 60)))) for i in range(150)]
    items += [(900 + i, "the same opening words of many items " + " ".join(f"t{i}w{k}" for k in range(20))) for i in range(20)]
    rows = []
    for i, t in items:
        w = t.split()
        n = len(w) - 4
        rows.append((len(rows), " ".join(w[int(0.2 * n) :] + [f"a{i}x{k}" for k in range(40)])))
        rows.append((len(rows), " ".join([f"b{i}x{k}" for k in range(40)] + w[: len(w) - int(0.2 * n)])))
        at, size = rng.randrange(5, len(w) - 5), max(1, n // 9 - 4)
        rows.append((len(rows), " ".join([f"c{i}x{k}" for k in range(9)] + w[:at] + [f"z{k}" for k in range(size)] + w[at + size :] + ["end"] * 9)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = {(d, i): (round(s, 9), p) for d, i, s, p in con.execute(CONTAMINATION).fetchall()}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in contamination(docs, bench).collect()}
    assert got == want and sum(s < 0.86 for s, _ in want.values()) > 150
