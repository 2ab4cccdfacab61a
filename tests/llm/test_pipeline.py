"""Every stage on its own input, against plain definitions; the queries against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from wardlight.llm.packing import Coder
from wardlight.llm.queries import ORACLES, QUERIES, word_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from wardlight.session import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "test"))
    return out


def test_filtering_stages_keep_rows_as_they_are(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert after.columns == stages[0].columns
        assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()


def test_quality_stage(stages):
    import wardlight.llm.quality as q
    import pyarrow as pa

    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        counts, _ = q.measure(pa.array([r.text]))
        assert not (q.base_failed(counts)[0] and r.doc_id in kept)
    labels = {r.doc_id: r.quality for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    junk = [i for i in kept if labels.get(i) == 0]
    assert len(junk) <= 1


def test_near_stage_keeps_the_first_of_each_class(stages):
    def sh(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    rows = sorted((r.doc_id, sh(r.text)) for r in stages[1].collect())
    kept = {r.doc_id for r in stages[2].collect()}
    for i, s in rows:
        close = [j for j, t in rows if j != i and len(s & t) >= 0.8 * len(s | t)]
        assert (i in kept) or any(j < i for j in close)
        if i in kept:
            assert all(j not in kept for j in close)


def test_decontamination_stage(stages):
    spark = stages[0].sparkSession
    con = duckdb.connect()
    con.register("documents", stages[2].toPandas())
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    leaked = {r[0] for r in con.execute(f"select distinct doc_id from ({ORACLES['op1_simhash_decontamination']})").fetchall()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[2:4])
    assert before - after == leaked and spark is not None


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after) and stages[4].columns == stages[0].columns
    for i, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == before[i].text or "[secret]" in r.text)
        assert 'token = "' not in r.text or 'token = "[secret]"' in r.text


def test_packing_stage(stages):
    from .test_layout import check_packing

    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    got = [r.asDict() for r in stages[5].collect()]
    n, least = check_packing(rows, got, 2048, Coder(word_tokenizer()))
    assert n <= least + 1


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == want and want


def test_partitioning_does_not_change_results(spark):
    from wardlight.llm.order_minhash import near_duplicates
    from wardlight.llm.quality import quality_model, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(1)
    seen = []
    for parts in (1, rng.randint(3, 9)):
        dealt = docs.repartition(parts)
        a = near_duplicates(dealt).select("doc_id", "class_id")
        b = quality_rules(dealt, quality_model(dealt, labels)).select("doc_id", "kept")
        seen.append((sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))))
    assert seen[0] == seen[1]
