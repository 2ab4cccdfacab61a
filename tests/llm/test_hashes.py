"""Sequences that cancel in polynomials modulo a power of two keep apart in words, lines, windows, texts and tokens."""

import zlib

import numpy as np
import pyarrow as pa

from wardlight.llm.order_minhash import near_duplicates, text_keys
from wardlight.llm.packing import best_fit_packing
from wardlight.llm.quality import measure
from wardlight.llm.queries import word_tokenizer
from wardlight.llm.substring import substring_dedup
from wardlight.llm.text import Flat, rolling, sequences, span_hashes

SIGN = [bin(k).count("1") % 2 for k in range(4096)]


def pair(a, b, n, gap=""):
    return gap.join((a, b)[s] for s in SIGN[:n]), gap.join((b, a)[s] for s in SIGN[:n])


def test_spans_windows_and_texts():
    for n in (64, 1024, 4096):
        x, y = pair("a", "b", n)
        flat = Flat(pa.array([x, y, x]))
        for seed in range(6):
            h = flat.words(seed)
            assert h[0] != h[1] and h[0] == h[2]
    x, y = pair("one", "two", 4096, " ")
    flat = Flat(pa.array([x, y, x]))
    keys = text_keys(flat)
    assert keys[0] != keys[1] and keys[0] == keys[2]
    h = flat.words(1)
    for k in (1, 2, 3, 5, 31, 50, 64, 1024, 4096):
        w = rolling(h, k, 9)
        assert len(w) == len(h) - k + 1 and w[0] == w[8192] and w[0] != w[4096]
        want = len({tuple(h[j : j + k].tolist()) for j in range(0, len(w), 7)})
        assert len(set(w[::7].tolist())) == want
    same = sequences(np.array([5, 6, 5, 6, 6, 5], dtype=np.uint64), np.array([0, 2, 2, 4, 6]), 3)
    assert same[0] == same[2] != same[3] and same[1] != same[0]


def test_long_spans_over_several_blocks():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 700_000).astype(np.uint8)
    data[300_000:600_000] = data[:300_000]
    got = span_hashes(data, np.array([0, 300_000, 600_000, 700_000]), np.array([300_000, 600_000, 700_000, 700_000]), 2)
    assert got[0] == got[1] != got[2]


def test_operators_on_them(spark, frame):
    x, y = pair("a", "b", 1024)
    assert measure(pa.array([f"{x}\n{y}\n{x}"]))[0][0].tolist()[3] == 1  # lines: one repeats
    p, q = pair("one", "two", 1024, " ")
    docs = frame([(1, p), (2, q), (3, x), (4, y), (5, p)])
    classes = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert classes[3] != classes[4] and classes[1] == classes[5]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    want = {}
    for i, t in ((3, x), (4, y)):
        want[i] = zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")[:2048].tobytes())
    got = {r.doc_id: r.ids_crc32 for r in best_fit_packing(docs, word_tokenizer()).filter("piece = 0").collect()}
    assert {i: got[i] for i in want} == want
    cut = {r.doc_id: r.text for r in substring_dedup(docs).collect()}
    seen, gone = set(), {}
    for i, t in ((1, p), (2, q), (5, p)):
        w = t.split(" ")
        out = [False] * len(w)
        mine = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(mine):
            if g in seen:
                out[k : k + 50] = [True] * 50
        seen |= set(mine)
        gone[i] = " ".join(v for v, o in zip(w, out, strict=True) if not o)
    assert {i: cut[i] for i in gone} == gone
