"""Near copies of short texts: one word more at either end or inside, at all short lengths, against brute force."""

import random

from wardlight.llm.order_minhash import near_duplicates

from .test_pairs import classes


def test_short_texts_meet(frame):
    rng = random.Random(2)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    for size in range(1, 36):
        for turn in range(6):
            base = [f"s{size}t{turn}k{k if turn < 5 else k % 3}" for k in range(size)]
            add(base)
            add([*base, "more"] if turn % 3 == 0 else ["more", *base] if turn % 3 == 1 else [*base[: size // 2], "more", *base[size // 2 :]])
    for _ in range(60):
        add(["a", "common", "opening", "of", "texts", "here", *(f"r{rng.randrange(900)}" for _ in range(rng.randint(0, 9)))])
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(rows)).collect()}
    want = classes(rows)
    assert got == want and sum(i != c for i, c in want.items()) > 100
