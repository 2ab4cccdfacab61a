"""Archives, chat windows, packing, sharding: round trips and brute force."""

import base64
import hashlib
import io
import random
import unicodedata
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.llm.chat import CONTROL, chat_digest, chat_windows, escape, read_window, role_in, role_out, spans, unescape
from wardlight.llm.packing import Coder, best_fit_packing, fullest, plan
from wardlight.llm.queries import word_tokenizer
from wardlight.llm.sharding import Shard, grown, shard_rows, tree
from wardlight.llm.text import Flat
from wardlight.llm.zip_warc import members, parse, read_packages, records_of, write_packages

PAGE = "page_id long, url string, html string"


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


# --- archives

def test_archives_round_trip(spark):
    rows = [(5, "http://a/ b\r\nX: 1", "same"), (2, None, "same"), (2, "http://again", "same"), (9, "http://c", None), (8, "http://d", ""), (None, "http://e", "same"), (None, "http://f", "alone"), (7, "http://g", "é\r\n\r\n" * 9000), (3, "http://h", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("x") for c in ("path", "_n", "records", "payload")})
    for package in (1, 500, 1 << 20):
        got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_packages(write_packages(pages, package=package), step=700).collect()), key=str)
        want = []
        for i, _, t in rows:
            group = [j for j, _, u in rows if (u or "") == (t or "")]
            first = min((j for j in group if j is not None), default=None)
            revisit = len(group) > 1 and i != first
            want.append((None if i is None else str(i), "revisit" if revisit else "response", str(first) if revisit else None, len((t or "").encode()), b32(t)))
        assert got == sorted(want, key=str)
    whole = {r.page_id: r.payload for r in read_packages(write_packages(pages)).filter("record_type = 'response'").collect()}
    assert bytes(whole["7"]).decode() == rows[7][2] and bytes(whole["3"]) == b"WARC/1.1\r\n\r\n"


def test_small_payloads_are_never_shared(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGE)
    got = {r.page_id: r.record_type for r in read_packages(write_packages(pages, least=5)).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(k, f"http://p/{k}", f"text {k} " * 50) for k in range(600)], PAGE).repartition(3)
    manifest = write_packages(pages)
    few = read_packages(manifest, piece=4000)
    assert few.rdd.getNumPartitions() > 10 and few.count() == 600
    used = few.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task").alias("n"), F.count_distinct("page_id").alias("pages")).first()
    assert used.n > 5 and used.pages == 600
    small = write_packages(pages, package=2000)
    assert small.count() > 20 and read_packages(small).rdd.getNumPartitions() >= small.count()


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGE)
    assert read_packages(write_packages(empty)).count() == 0


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            z.writestr(f"archive/{k}.warc", b"%d" % k * 50)
        z.comment = b"note"
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw
    found = members(io.BytesIO(raw), len(raw))
    assert {n: raw[at : at + size] for n, (_, at, size) in found.items()} == {f"archive/{k}.warc": b"%d" % k * 50 for k in range(3)}


def test_archive_without_index_and_compressed_member(spark, tmp_path):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 4\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", gzip.compress(record) * 5)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")
    got = read_packages(manifest, step=11).collect()
    assert len(got) == 5 and all((r.page_id, r.payload_bytes, bytes(r.payload)) == ("4", 3, b"abc") for r in got)
    with zipfile.ZipFile(tmp_path / "b.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc.gz", record * 50)
    with pytest.raises(Exception, match="compressed, not stored"):
        read_packages(spark.createDataFrame([(f"file://{tmp_path}/b.wacz",)], "path string")).collect()
    assert parse(record)[1] == b"abc"
    assert list(records_of(io.BytesIO(gzip.compress(record)), 0, len(gzip.compress(record)), 7)) == [record]


# --- chat

pieces = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "|", "a", "\n", "é", "<|im_", "INST]", "\\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces)
def test_escape_is_reversible(role, text):
    assert unescape(escape(text)) == text and role_in(role_out(role)) == role
    assert not any(c in escape(text) for c in CONTROL)
    framed = f"<|im_start|>{role_out(role)}\n{escape(text)}<|im_end|>\n"
    assert read_window(framed * 2) == [(role, text)] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(4, 60), min_size=1, max_size=40), st.integers(20, 90), st.integers(0, 4), st.integers(0, 1))
def test_spans(tokens, budget, history, system):
    chosen = spans(np.array(tokens), budget, history, system)
    assert [x for _, at, end in chosen for x in range(at, end)] == list(range(len(tokens)))
    for low, at, end in chosen:
        used = sum(tokens[low:end]) + (tokens[0] if system and low > 0 else 0)
        assert at - history <= low <= at and (used <= budget or end == at + 1)


def plain_digest(rows):
    groups = {}
    for c, n, role, text in rows:
        groups.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [5, 40, 100_000])
def test_chat_round_trip(spark, budget):
    rng = random.Random(2)
    rows = [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    for c in [None, *range(8)]:
        if c == 3:
            rows.append((c, 0, "system", "be kind <|im_end|>"))
        for k in range(400 if c == 3 else rng.randint(1, 9)):
            rows.append((c, rng.choice([None, k + 1, k + 1, k + 2]), rng.choice(["user", "assistant", "tool\nx", None, "system"]), rng.choice([None, "", "a b c", "x " * 30, "<|im_start|>user\n", "é\\<|im_end|>"])))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "formatted", "segment", "window", "loss")})
    windows = chat_windows(turns.repartition(4), budget=budget)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digest(windows).collect()}
    assert got == plain_digest(rows)
    if budget == 40:
        held = windows.filter("conv_id = 3").collect()
        assert max(r.segment for r in held) > 0 and len({r.window for r in held}) > 1


def test_no_turns(spark):
    assert chat_digest(chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- packing

def test_coder_equals_tokenizer():
    coder = Coder(word_tokenizer())
    rng = random.Random(5)
    chars = ["a", "B", "É", "é", "'", "'s", "'LL", "1", "23", ",", "—", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", "ſ", "İ", "日本", "ﬁ", "½", "Σ", "!!", "ª"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 25))) for _ in range(3000)]
    ids, off = coder.encode(Flat(pa.array(texts)))
    want = [e.ids + [0] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want
    assert unicodedata.normalize("NFC", "é") == "é"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6))
def test_fullest_is_optimal(capacity, counts):
    best = {0}
    for length, n in counts.items():
        best = {x + k * length for x in best for k in range(n + 1) if x + k * length <= capacity}
    used = fullest(capacity, sorted(counts, reverse=True), counts)
    assert sum(k * m for k, m in used.items()) == max(best) and all(m <= counts[k] for k, m in used.items())


def test_plan_uses_every_piece():
    rng = random.Random(6)
    histogram = {rng.randint(1, 300): rng.randint(1, 10**9) for _ in range(60)}
    total = dict.fromkeys(histogram, 0)
    bins = 0
    for times, used in plan(histogram, 300):
        assert sum(k * m for k, m in used.items()) <= 300
        bins += times
        for k, m in used.items():
            total[k] += m * times
    least = -(-sum(k * n for k, n in histogram.items()) // 300)
    assert total == histogram and bins <= least * 1.05 + 2


def check_packing(rows, got, limit, coder):
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r)
        assert any(zlib.crc32(np.array(w[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"] for w in want[r["doc_id"]])
        assert r["start"] == r["piece"] * limit and r["length"] <= limit
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda x: x["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    tokens = sum(len(w) for ws in want.values() for w in ws)
    assert sum(r["length"] for r in got) == tokens
    return len(bins), -(-tokens // limit)


@pytest.mark.parametrize("limit", [16, 2048])
def test_packing(frame, odd, none, limit):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["the", "cat", "sat", "onerheti"], k=rng.randint(0, 40)))) for k in range(150)] + [(k, "same copy here") for k in range(200, 320)]
    coder = Coder(word_tokenizer())
    got = [r.asDict() for r in best_fit_packing(frame(rows), word_tokenizer(), limit, with_ids=True).collect()]
    n, least = check_packing(rows, got, limit, coder)
    assert n <= least * 1.05 + 1 and all(len(r["ids"]) == r["length"] for r in got)
    check_packing([(r.doc_id, r.text) for r in odd.collect()], [r.asDict() for r in best_fit_packing(odd, word_tokenizer(), limit).collect()], limit, coder)
    assert best_fit_packing(none, word_tokenizer(), limit).count() == 0


# --- sharding

def placed(docs, leaves, after=None):
    return {r.doc_id: r for r in shard_rows(docs, leaves, after).collect()}


def test_movement_stays_in_its_subtree(frame):
    docs = frame([(k, f"t{k}") for k in range(6000)], 4)
    eight = tree(8)
    more = placed(docs, eight, grown(eight))
    assert all(r.grown_shard in (r.shard, 8) for r in more.values())
    assert abs(sum(r.grown_shard == 8 for r in more.values()) - 6000 / 9) < 100
    again = placed(docs, grown(eight), grown(grown(eight)))
    assert all(again[k].shard == more[k].grown_shard and again[k].grown_shard in (again[k].shard, 9) for k in more)
    heavier = [Shard(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in eight]
    new = placed(docs, heavier)
    region, rack = ({x.shard: v for x in eight for v in [getattr(x, level)]} for level in ("region", "rack"))
    for k, r in more.items():
        a, b = r.shard, new[k].shard
        if a != b:  # to region 1; within it to rack 2; within that to shard 5
            assert region[b] == 1 and (region[a] != 1 or rack[b] == 2) and (rack[a] != 2 or b == 5)
    share = np.bincount([r.shard for r in new.values()], minlength=8) / 6000
    assert abs(share[5] - 0.3) < 0.03 and abs(share[0] - 0.1) < 0.02


def test_slots_and_digests(frame, odd, none, spark):
    rows = [(k % 500, "hot copy" if k % 3 else f"t é {k}") for k in range(1500)] + [(None, None), (None, "x")]
    for docs in (frame(rows, 7), odd):
        got = shard_rows(docs, tree(8), grown(tree(8))).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert shard_rows(none, tree(8)).count() == 0
    drained = [Shard(x.region, x.rack, x.shard, 0.0 if x.shard == 2 else 1.0) for x in tree(8)]
    assert 2 not in {r.shard for r in shard_rows(frame(rows), drained).collect()}
