"""Secret scan: assigned values, keys of known services and long tokens are candidates, a random forest decides which are secrets.

Candidates are (1) values of ``SHORT`` characters or more that are assigned to a secret's name, with any characters but white
space inside quotes; (2) runs with a known prefix; (3) all runs of ``LEAST`` key characters or more, words too. They may
overlap. The forest sees the candidate's length, how its characters change (changes of kind, rarity of letter pairs), how much
of it dictionary words cover, its prefix, its path (the column ``path_col``, by parts), and the words next to it.

It is trained from labelled findings (text, path, start, end, label). Where a caller has none, ``labelled_findings`` makes
them from the corpus: in a bounded sample of documents it plants secrets of public formats and decoys (checksums,
identifiers, version and word chains, numbers) among the document's own words, and labels what the documents already hold where
its form is certain: a quoted assignment to a secret's name is one, a bare number or an e-mail address is not. The
dictionary and the letter pairs come from word counts over the whole corpus.

Defined results: one row per candidate with place (code points), SHA-256 and length instead of the secret itself; null
and empty texts have none; a replacement character (U+FFFD) only ends a run; repeated rows are scanned each; without labelled findings of both kinds the forest accepts all
(only positives) or nothing; an empty table gives no rows; other columns do not matter and ``redacted`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.boosting import Trees
from wardlight.llm.forest import fit_forest
from wardlight.llm.text import Flat, get, slices

LEAST = 12  # of a run anywhere
SHORT = 8  # of a value that is assigned to a secret's name
CONTEXT = 96  # bytes looked at of each word around a candidate
SAMPLE = 3000  # documents that findings are planted in
DICTIONARY = 4000
NEAR = 4  # words looked at before a candidate

# Names that secrets are assigned to, and words that stand by harmless tokens.
SECRET_NAMES = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private_key"]
HARMLESS = ["commit", "sha", "sha256", "md5", "checksum", "digest", "uuid", "id", "ref", "version", "example", "sample", "test", "dummy", "placeholder", "order", "page", "isbn"]
PATH_PARTS = ["test", "tests", "example", "examples", "docs", "fixtures", "config", "env", "settings", "src"]

# How keys of common services begin.
PREFIX = re.compile(rb"(?<![A-Za-z0-9])(?:A[KS]IA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[srp]k_(?:live|test)_|sk-|npm_|AIza|eyJ)[A-Za-z0-9_\-]{8,}")

RUN = re.compile(rb"[A-Za-z0-9_+/=\-.]{%d,}" % LEAST)
GIVEN = re.compile(rb"[=:]+>?\s*(?:(?:bearer|basic)\s+)?(?:[rbfu]{0,2}(\\*[\"'`]))?", re.IGNORECASE)
NAMED = re.compile(rb"(?:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\w\-]*[\"'`\])\\]*\s*$", re.IGNORECASE)
BARE = re.compile(rb"[^\s\"'`<>,;]+")
INSIDE = {q: re.compile(rb"(?:\\\S|[^\s\\%b])+" % q) for q in (b'"', b"'", b"`")}
NESTED = {q: re.compile(rb"[^\s\\%b]+" % q) for q in INSIDE}  # the quote itself is escaped, so a backslash ends the value


def assigned_values(raw: bytes, low: int, high: int) -> list[tuple[int, int]]:
    """Places of the values of ``SHORT`` characters or more that ``raw[low:high]`` assigns to a secret's name."""
    out = []
    for m in GIVEN.finditer(raw, low, high):
        name = NAMED.search(raw[max(low, m.start() - CONTEXT) : m.start()])
        if not name:
            continue
        quote = m[1]
        value = (BARE if not quote else INSIDE[quote] if len(quote) == 1 else NESTED[quote[-1:]]).match(raw, m.end(), high)
        if not value:
            continue
        a, b = value.span()
        if not quote:
            at = max(low, m.start() - CONTEXT) + name.start()
            if b"&" in value[0] and re.search(rb"\?\S*$", raw[max(low, at - CONTEXT) : at]):  # one parameter of a URL
                b = a + value[0].index(b"&")
            b = a + len(raw[a:b].rstrip(b".)]}:"))
        if len(raw[a:b].decode()) >= SHORT:
            out.append((a, b))
    return out


def candidates(column: pa.Array) -> list[tuple[int, int, int, list[str], str, bool]]:
    """(text, start byte, end byte, words before, rest and word after, assigned) of every candidate in a slice of texts."""
    flat = Flat(column)
    raw = flat.data.tobytes()
    out = []
    for doc in np.flatnonzero(np.diff(flat.off) >= SHORT):
        low, high = int(flat.off[doc]), int(flat.off[doc + 1])
        values = assigned_values(raw, low, high)
        found = dict.fromkeys(values, True)
        v = 0
        for m in RUN.finditer(raw, low, high):
            a, b = m.start(), m.end()
            if not m[0].endswith(b"=="):
                b = a + len(m[0].rstrip(b".-="))
            while v < len(values) and values[v][1] <= a:
                v += 1
            given = v < len(values) and values[v][0] < b
            if given and values[v][0] == a and values[v][1] >= b and not raw[b : values[v][1]].strip(b".-="):
                continue  # the value itself
            if b - a >= LEAST and not raw[a:b].strip(b"_+/=-.") == b"":
                found.setdefault((a, b), given)
            for key in PREFIX.finditer(raw, a, m.end()):
                found.setdefault(key.span(), given)
        for a, b in sorted(found):
            w = int(np.searchsorted(flat.start, a, "right")) - 1
            first = max(int(flat.first[doc]), w - NEAR)
            before = [raw[max(flat.start[k], flat.end[k] - CONTEXT) : flat.end[k]].decode("utf-8", "ignore") for k in range(first, w)]
            head = raw[max(flat.start[w], a - CONTEXT) : a].decode("utf-8", "ignore")
            n = int(np.searchsorted(flat.start, b, "left"))
            after = raw[flat.start[n] : min(flat.end[n], flat.start[n] + CONTEXT)].decode("utf-8", "ignore") if n < flat.first[doc + 1] else ""
            called = raw[b : b + 1] in (b"(", b"[") if b < high else False
            out.append((int(doc), a - low, b - low, [*before, head], "(" + after if called else after, found[a, b]))
    return out


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


@dataclass
class Lexicon:
    words: frozenset
    pairs: np.ndarray  # log-probability of a letter after a letter, 27 x 27


@dataclass
class SecretModel:
    lexicon: Lexicon
    trees: Trees


def lexicon(texts: DataFrame, size: int = DICTIONARY) -> Lexicon:
    """The ``size`` most frequent words of four letters or more, counted over all texts, and letter pairs in them."""
    words = texts.select(F.explode(F.split(F.lower("_t"), r"[^\p{L}]+")).alias("w")).filter(F.char_length("w") >= 4)
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()
    pairs = np.ones((27, 27))
    for r in top:
        codes = [26, *(ord(c) - 97 if "a" <= c <= "z" else 26 for c in r["w"])]
        for x, y in zip(codes, codes[1:], strict=False):
            pairs[x, y] += r["n"]
    return Lexicon(frozenset(r["w"] for r in top), np.log(pairs / pairs.sum(axis=1, keepdims=True)))


def covered(text: str, words: frozenset) -> float:
    """Share of ``text`` under dictionary words, longest first from the left."""
    low, k, n = text.lower(), 0, 0
    while k < len(low):
        for size in range(min(14, len(low) - k), 3, -1):
            if low[k : k + size] in words:
                n += size
                k += size
                break
        else:
            k += 1
    return n / len(low)


NAMES = ["length", "digits", "upper", "lower", "other", "changes", "hex", "entropy", "pairs", "coverage", "assigned", "quoted", "near_secret", "near_harmless", "after_known", "repeat", *(f"path_{p}" for p in PATH_PARTS), "path_depth", "near_hash", "prefix", "called", "marked"]


def features(text: str, before: list[str], after: str, assigned: bool, path: str | None, lex: Lexicon) -> list[float]:
    n = len(text)
    kinds = [kind(c) for c in text]
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8))
    p = counts[counts > 0] / counts.sum()
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in text.lower()]
    pairs = float(np.mean([lex.pairs[x, y] for x, y in zip(codes, codes[1:], strict=False)]))
    near = [re.sub(r"[^a-z0-9_]", "", w.lower()) for w in before]
    parts = re.split(r"[/\\._\-]+", (path or "").lower())
    return [
        n, *(kinds.count(k) / n for k in range(4)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in text)), float(-(p * np.log2(p)).sum()), pairs, covered(text, lex.words),
        float(assigned), float(before[-1].endswith(('"', "'", "`"))), float(any(s in w for w in near for s in SECRET_NAMES)),
        float(any(w in HARMLESS for w in near)), float(re.sub(r"\W", "", after.lower()) in lex.words), len(set(text)) / n,
        *(float(x in parts) for x in PATH_PARTS), float(len(parts)), zlib.crc32(near[-2].encode()) % 64 if len(near) > 1 else -1.0,
        float(bool(PREFIX.match(text.encode()))), float(after.startswith("(")), float(text[0] in "$<{%[("),
    ]


def plant(text: str, seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with secrets and decoys between its words, and their (start, end, label)."""
    rng = random.Random(seed)
    hexa, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def some(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))

    own = [w for w in re.findall(r"[a-z]{3,9}", text) if w.isascii()] or ["word", "line"]
    capitals, signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!@#$%^&*?~+-_"

    def several(n, join=""):
        return join.join(rng.choices(own, k=n))

    def password(n):
        return rng.choice(letters) + "".join(rng.sample(some(letters, n - 3) + some(signs, 2), n - 1))

    def named(quoted):
        name = rng.choice(SECRET_NAMES)
        name = rng.choice([name, name, name.upper(), f"db_{name}", f"{name}_prod"])
        return rng.choice([f'{name} = "', f"{name}='", f'"{name}": "']) if quoted else rng.choice([f"{name}: ", f"{name}=", f"{name} = "])

    keys = ["AKIA" + some(capitals + "234567", 16), "AKIA" + some(capitals, 16), "ghp_" + some(letters, 36), "xoxb-" + some("0123456789", 12) + "-" + some(letters, 24), "sk_live_" + some(letters, 24)]
    secrets = [*keys, some(hexa, rng.choice([32, 40, 64])), some(letters, rng.choice([20, 24, 32, 40])), some(letters, rng.randint(8, 11)), password(rng.randint(8, 11)), password(rng.randint(12, 24)), some(capitals, rng.randint(12, 32)), some(capitals.lower(), rng.randint(8, 24)), (several(3) + "word")[:40]]
    decoys = [some(hexa, 40), f"{some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}", several(4, "-") + "-2", several(3, "_") + "_" + some("0123456789", 2),
              some("0123456789", rng.choice([13, 16, 19])), rng.choice(own).capitalize() + rng.choice(own).capitalize() + rng.choice(own).capitalize() + "1", f"{rng.choice(own)}.{rng.choice(own)}.example.com/{some('0123456789', 4)}", "EXAMPLE_" + some("X", 12) + "_KEY1",
              several(3) + "word", several(3, "-") + "-line", (several(3, "_") + "_line").upper(), several(4, "/"), rng.choice(re.findall(r"(?<![A-Za-z])[A-Za-z]{12,}(?![A-Za-z])", text) or [several(4) + "line"])]
    references = ["get_" + several(2, "_") + "(", "settings." + several(2, "_"), "${" + several(2, "_").upper() + "_KEY}", "<your-" + several(2, "-") + ">", "os.environ[", (rng.choice(own) + "fulness")]
    out, places = text, []
    for _ in range(4):
        good, odd = rng.random() < 0.5, rng.random()
        if good:
            body = rng.choice(secrets)
            lead = rng.choice(["", '"', f"{rng.choice(own)} "]) if body in keys and odd < 0.3 else named(odd < 0.75)
        elif odd < 0.25:
            body, lead = rng.choice(references), named(False)
        else:
            body, lead = rng.choice(decoys), rng.choice([f"{rng.choice(HARMLESS)} ", f"{rng.choice(HARMLESS)}: ", "", f'{rng.choice(own)} "', f'{rng.choice(own)} = "'])
        tail = lead[-1] if lead and lead[-1] in "\"'" else ""
        if out and not out[-1].isspace():
            out += " "
        start = len((out + lead).encode())
        places.append((start, start + len(body), int(good)))
        out += lead + body + tail + " " + " ".join(rng.choices(own, k=rng.randint(2, 6)))
    return out, places


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(text, path, start, end, label), places in bytes, from the ``sample`` documents whose ids hash smallest."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(path_col).cast("string").alias("_p"))
    rows = rows.withColumn("_h", F.xxhash64("_id", "_t"))
    chosen = rows.select("_h").orderBy("_h").limit(sample).distinct()
    rows = rows.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"])

    def make(batches):
        names = ["text", "path", "start", "end", "label"]
        for part in slices(batches, "_t"):
            held = []
            for text, path, h in zip(get(part, "_t").to_pylist(), get(part, "_p").to_pylist(), get(part, "_h").to_pylist(), strict=True):
                if len(text) > 100_000:  # planting copies the text once; very long texts take part with what they hold
                    full, places = text, []
                else:
                    full, places = plant(text, h)
                for _, a, b, before, _, assigned in candidates(pa.array([full])):
                    at = next((lab for s, e, lab in places if a < e and b > s), None)
                    body = full.encode()[a:b].decode()
                    if at is None and assigned and before[-1].endswith('"'):
                        at = 1
                    if at is None and (body.isdigit() or "@" in before[-1] or re.fullmatch(r"[\d.\-]+", body)):
                        at = 0
                    if at is not None:
                        held.append((full, path, a, b, at))
            yield pa.record_batch([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names)

    return rows.select("_t", "_p", "_h").mapInArrow(make, "text string, path string, start long, end long, label int")


def train_secret_model(findings: DataFrame, lex: Lexicon) -> SecretModel:
    """Forest fitted to labelled findings; they are bounded by their maker, and only their features reach the driver."""

    def measure(batches):
        for part in slices(batches, "text"):
            held, labels = [], []
            for text, path, a, b, label in zip(*(get(part, c).to_pylist() for c in ("text", "path", "start", "end", "label")), strict=True):
                for _, s, e, before, after, assigned in candidates(pa.array([text])):
                    if s < b and e > a:
                        held.append(features(text.encode()[s:e].decode(), before, after, assigned, path, lex))
                        labels.append(label)
            yield pa.record_batch([pa.array([r[k] for r in held], pa.float64()) for k in range(len(NAMES))] + [pa.array(labels, pa.int32())], [*NAMES, "label"])

    got = findings.mapInArrow(measure, ", ".join(f"{f} double" for f in NAMES) + ", label int").toArrow().to_pandas().sort_values(["label", *NAMES])
    return SecretModel(lex, fit_forest(got[NAMES].to_numpy(), got["label"].to_numpy().astype(float)))


def secret_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> SecretModel:
    return train_secret_model(labelled_findings(docs, id_col, text_col, path_col), lexicon(docs.select(F.col(text_col).alias("_t"))))


def judged(texts: pa.Array, paths: list[str | None], model: SecretModel) -> list[tuple[int, int, int, bytes, float]]:
    """(text, start byte, end byte, candidate, score) of a slice of texts."""
    found = candidates(texts)
    if not found:
        return []
    raw = {d: texts[d].as_py().encode() for d in {f[0] for f in found}}
    bodies = [raw[d][a:b] for d, a, b, *_ in found]
    x = np.array([features(body.decode(), before, after, assigned, paths[d], model.lexicon) for body, (d, _, _, before, after, assigned) in zip(bodies, found, strict=True)])
    return [(d, a, b, body, float(s)) for (d, a, b, *_), body, s in zip(found, bodies, model.trees.score(x), strict=True)]


def secret_findings(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, start and end (code points), length, sha256, score, and whether it is a secret."""

    def scan(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
        for part in slices(batches, "_t"):
            text = get(part, "_t")
            found = judged(text, get(part, "_p").to_pylist(), model)
            flat = Flat(text)
            points = np.concatenate(([0], np.cumsum((flat.data & 0xC0) != 0x80)))  # code points before each byte
            rows = []
            for d, a, b, body, score in found:
                start, end = (int(points[flat.off[d] + k] - points[flat.off[d]]) for k in (a, b))
                rows.append((start, end, end - start, hashlib.sha256(body).hexdigest(), score, score >= 0.5))
            ids = get(part, "_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.record_batch([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["_id", "start", "end", "length", "sha256", "score", "secret"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(path_col).cast("string").alias("_p"))
    out = f"_id {rows.schema['_id'].dataType.simpleString()}, start long, end long, length int, sha256 string, score double, secret boolean"
    return rows.mapInArrow(scan, out).withColumnRenamed("_id", id_col)


def redacted(docs: DataFrame, model: SecretModel, text_col: str = "text", path_col: str = "source", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in the texts replaced by ``mark``; other columns stay as they are."""

    def hide(batches):
        for part in slices(batches, text_col):
            texts = get(part, text_col)
            found = [f for f in judged(texts, get(part, path_col).cast(pa.string()).to_pylist(), model) if f[4] >= 0.5]
            if found:
                made = texts.to_pylist()
                places: dict[int, list[list[int]]] = {}
                for d, a, b, _, _ in found:
                    held = places.setdefault(d, [])
                    if held and a < held[-1][1]:  # candidates may overlap
                        held[-1][1] = max(held[-1][1], b)
                    else:
                        held.append([a, b])
                for d, spans in places.items():
                    raw, parts, at = made[d].encode(), [], 0
                    for a, b in spans:
                        parts += [raw[at:a], mark.encode()]
                        at = b
                    made[d] = b"".join([*parts, raw[at:]]).decode()
                at = part.schema.get_field_index(text_col)
                part = part.set_column(at, part.schema.field(at), pa.array(made, texts.type))
            yield part

    return docs.mapInArrow(hide, docs.schema)
