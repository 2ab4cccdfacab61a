"""Chat formatting in budgeted windows.

Turns of a conversation are laid out in order; prefix sums of their tokens choose spans of whole turns that fit the
budget. A window holds the system turn (if the conversation opens with one), up to ``history`` repeated turns from before
the span, and the span. Only assistant texts of the span carry loss; repeated turns are masked, so every assistant text is
a target once. A turn longer than the budget gets a window of its own and is never cut.

A window is text: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside texts and roles get a backslash
behind their first character (and one more if there were some), which is undone when reading; line feeds and backslashes in roles are escaped too.

A conversation may hold a third of all rows: its prefix sums are built from chunks of turn numbers, and spans are chosen
apart in segments of ``SEGMENT`` budgets, each a bounded group. A segment opens with the system turn but without history.

Defined results: null roles and texts are empty; a null conv_id is a conversation of its own; turns with equal numbers
are ordered by role and text, null numbers come first; repeated rows are turns each; an empty table gives no windows;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.text import get

BUDGET = 1024
HISTORY = 2
SEGMENT = 64
CHUNK = 4096
FRAME = 4  # tokens that mark one turn

# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)
ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{TAILS}))")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?=(?:{TAILS}))")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def spans(tokens: np.ndarray, budget: int, history: int, system: int) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window over turns of ``tokens``; turn 0 is the system turn if ``system``."""
    run = np.concatenate(([0], np.cumsum(tokens)))
    fixed = int(tokens[0]) if system else 0
    out, at = [], 0
    while at < len(tokens):
        low = max(at - history, 1 if system else 0) if at else 0
        while low < at and run[at] - run[low] > max(0, budget - fixed) // 4:
            low += 1
        used = (fixed if at else 0) + run[at] - run[low]
        end = max(int(np.searchsorted(run, run[at] + budget - used, "right")) - 1, at + 1)
        out.append((low, at, end))
        at = end
    return out


def segmented(turns: DataFrame, budget: int) -> DataFrame:
    """Adds ``_seg`` from prefix sums of tokens; conversations longer than a segment get their system turn in each."""
    rows = turns.select(F.col("conv_id").alias("_c"), F.col("turn").cast("long").alias("_n"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_tok", F.regexp_count("_text", F.lit(r"\S+")).cast("long") + FRAME).withColumn("_chunk", F.floor(F.coalesce("_n", F.lit(-(1 << 62))) / CHUNK))
    order = ["_n", "_role", "_text"]
    sums = rows.groupBy("_c", "_chunk").agg(F.sum("_tok").alias("_sum"))
    before = W.partitionBy("_c").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("_c").alias("_c2"), F.col("_chunk").alias("_chunk2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    inside = W.partitionBy("_c", "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_tok").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_chunk") == F.col("_chunk2")))
    rows = rows.withColumn("_seg", F.floor((F.col("_from") + F.col("_in")) / (SEGMENT * budget))).select("_c", "_seg", *order, "_tok", F.lit(False).alias("_copy"))
    first = rows.groupBy("_c").agg(F.min(F.struct(*order, "_tok")).alias("_s"), F.max("_seg").alias("_last")).filter("_last > 0 and _s._role = 'system'")
    copies = first.select("_c", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("_seg"), "_s.*", F.lit(True).alias("_copy"))
    return rows.unionByName(copies)


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: conv_id, segment, window, text, repeated turns, tokens, and the loss as code point spans."""

    def close(key, held):
        copied = held[0][3]
        system = int(held[0][0] == "system" and (copied or key[1] == 0))
        tokens = np.array([x[2] for x in held])
        chosen = spans(tokens, budget, history, system)
        if copied:  # the copied system turn is context, never new
            chosen = [(low, max(at, 1), end) for low, at, end in chosen if end > 1]
        for k, (low, at, end) in enumerate(chosen):
            shown = ([0] if system and low > 0 else []) + list(range(low, end))
            text, loss, size = [], [], 0
            for j in shown:
                head, body = f"<|im_start|>{role_out(held[j][0])}\n", escape(held[j][1])
                if j >= at and held[j][0] == "assistant":
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                text.append(f"{head}{body}<|im_end|>\n")
                size += len(text[-1])
            yield (*key, k, "".join(text), sum(j < at for j in shown), int(tokens[shown].sum()), loss)

    names = ["_c", "segment", "window", "formatted", "repeated", "tokens", "loss"]

    def build(batches):
        key, held, out, kinds, size = None, [], [], None, 0

        def batch():
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for part in batches:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [get(part, "_c").type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), span]
            for row in zip(*(get(part, c).to_pylist() for c in ("_c", "_seg", "_role", "_text", "_tok", "_copy")), strict=True):
                if held and row[:2] != key:
                    out += close(key, held)
                    size += sum(len(x[1]) for x in held)
                    held = []
                    if size > 4 << 20:
                        if out:
                            yield batch()
                        out, size = [], 0
                key = row[:2]
                held.append(row[2:])
        if held:
            out += close(key, held)
        if out:
            yield batch()

    rows = segmented(turns, budget)
    kind = rows.schema["_c"].dataType.simpleString()
    by = [F.asc_nulls_first(c) for c in ("_c", "_seg")] + [F.desc("_copy"), F.asc_nulls_first("_n"), F.asc("_role"), F.asc("_text")]
    dealt = rows.repartition("_c", "_seg").sortWithinPartitions(*by)
    return dealt.mapInArrow(build, f"_c {kind}, segment long, window int, formatted string, repeated int, tokens long, loss array<struct<start: long, end: long>>").withColumnRenamed("_c", "conv_id")


def read_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a window."""
    return [(role_in(r), unescape(t)) for r, t in TURN.findall(formatted)]


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows in order: turns, their SHA-256, loss text and its SHA-256, characters.

    A SHA-256 runs over its input in sequence, so the windows of one conversation pass one task; they stream through it
    in order and only the two hash states are held.
    """

    def read(batches):
        state, out, kind = None, [], None

        def done():
            key, n, turns, chars, loss, size = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch():
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for part in batches:
            kind = get(part, "conv_id").type
            for key, text, repeated, loss in zip(*(get(part, c).to_pylist() for c in ("conv_id", "formatted", "repeated", "loss")), strict=True):
                if state is None or state[0] != key:
                    if state:
                        out.append(done())
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_window(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
            if len(out) > 5000:
                yield batch()
                out = []
        if state:
            out.append(done())
        if out:
            yield batch()

    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", "window")
    return rows.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
