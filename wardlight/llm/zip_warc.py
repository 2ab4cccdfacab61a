"""WARC records in ZIP-packaged archives, written by tasks and read back by byte ranges.

A package is a ZIP file with stored (not compressed) members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its offset and length. The reader takes a package's tail, parses the end
record (ZIP64 too) and the central directory, finds the data of the stored members through their local headers, and
range-reads records where the index says they lie. Nothing is unpacked, and no more than ``READ`` bytes are asked for at
once unless one record is longer. A package without an index is read member by member, in steps of ``READ``.

Payloads that several rows share are kept once: the row with the smallest page_id is a response, the others are revisits
that name it. Payload digests are computed by Spark and only narrow groups of two or more come to the join.

Storage is reached with ``pyarrow.fs`` (file, hdfs, s3, gs and so on). A task writes under a name of its own and reports
it in a manifest that Spark commits, so packages of failed attempts are never read.

Defined results: null html is an empty payload; a null url is left out of the record; control characters and spaces in
urls are percent-encoded; rows that repeat the smallest page_id of a group are all responses; a row with a null page_id
revisits the group's smallest, or is a response where no row has one; an empty table gives no packages and no rows;
other columns do not matter. Members that are compressed, not stored, raise an error that names them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.text import get
from wardlight.session import scratch_path, written

PACKAGE = 32 << 20
PIECE = 8 << 20
READ = 8 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# --- writing ---------------------------------------------------------------------------------------------------------

def label(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``_sha`` (hex SHA-1 of the payload), ``_type`` and ``_refers``; payloads below ``least`` bytes are never shared."""
    rows = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "utf-8"))))
    groups = rows.filter("_sha is not null").groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(groups, "_sha", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumn("_sha", F.sha1(F.encode("html", "utf-8"))).withColumn("_refers", F.when(revisit, F.col("_first"))).drop("_first")


def address(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url: str | None, html: str, sha: str, refers) -> bytes:
    """One WARC record, not compressed."""
    payload = html.encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {address(url)}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A ZIP package under construction."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, inner = fs.FileSystem.from_uri(self.path)
        self.file = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.warc = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, data: bytes, url: str | None) -> None:
        packed = gzip.compress(data, 4, mtime=0)
        self.warc.write(packed)
        where = {"offset": self.size, "length": len(packed), "filename": "data.warc.gz"}
        self.index.append(f"{address(url or '-')} 19700101000000 {json.dumps(where)}")
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.warc.close()
        self.zip.writestr("indexes/index.cdxj", "".join(x + "\n" for x in self.index))
        self.zip.close()
        self.file.close()
        return self.path, len(self.index)


def write_packages(pages: DataFrame, folder: str | None = None, least: int = 0, package: int = PACKAGE) -> DataFrame:
    """Write all rows of (page_id, url, html); returns the manifest (path, records)."""
    folder = folder or scratch_path(pages.sparkSession, "packages")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches):
        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(inner, recursive=True)
        one, done = None, []
        for part in batches:
            for row in zip(*(get(part, c) for c in ("page_id", "url", "html", "_sha", "_refers")), strict=True):
                page_id, url, html, sha, refers = (x.as_py() for x in row)
                one = one or Package(uri)
                one.add(record(page_id, url, html, sha, refers), url)
                if one.size >= package:
                    done.append(one.close())
                    one = None
        if one:
            done.append(one.close())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return written(label(pages, least).mapInArrow(write, "path string, records long"), "manifest")


# --- reading ---------------------------------------------------------------------------------------------------------

def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """(method, offset of the data, length) of every member, from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP package: no end record")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    at = tail_at + end
    if at >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        locator = read_at(file, at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            wide = read_at(file, struct.unpack("<Q", locator[8:16])[0], 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, p, out = read_at(file, start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, plain, n, extra, note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode()
        e, stop = p + 46 + n, p + 46 + n + extra
        while e + 4 <= stop:
            tag, width = struct.unpack("<HH", directory[e : e + 4])
            if tag == 1:  # ZIP64: only the fields that are full in the short record, in this order
                wide, q = directory[e + 4 : e + 4 + width], 0
                if plain == 0xFFFFFFFF:
                    plain, q = struct.unpack("<Q", wide[q : q + 8])[0], q + 8
                if packed == 0xFFFFFFFF:
                    packed, q = struct.unpack("<Q", wide[q : q + 8])[0], q + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", wide[q : q + 8])[0]
            e += 4 + width
        p = stop + note
        local = read_at(file, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"broken local header of {name}")
        out[name] = (method, header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record; HTTP headers are cut off."""
    head, _, block = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = block[: int(headers.get("content-length", len(block)))]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def ranges(index: str):
    for line in index.splitlines():
        if "{" in line:
            where = json.loads(line[line.index("{") :])
            yield where["filename"], int(where["offset"]), int(where["length"])


def records_at(file, base: int, places: list[tuple[int, int]], step: int):
    """Records at (offset, length) of one member; neighbours share one range read of up to ``step`` bytes."""
    k = 0
    while k < len(places):
        j, first = k + 1, places[k][0]
        while j < len(places) and places[j][0] + places[j][1] - first <= step and places[j][0] >= places[j - 1][0]:
            j += 1
        data = read_at(file, base + first, max(o + n for o, n in places[k:j]) - first)
        for o, n in places[k:j]:
            one = data[o - first : o - first + n]
            yield gzip.decompress(one) if one[:2] == b"\x1f\x8b" else one
        k = j


def records_of(file, base: int, length: int, step: int):
    """Records of a gzip member-per-record archive without an index, in steps."""
    at, inflate, out = 0, zlib.decompressobj(31), []
    while at < length:
        data = read_at(file, base + at, min(step, length - at))
        at += len(data)
        while data:
            out.append(inflate.decompress(data))
            data = b""
            if inflate.eof:
                data = inflate.unused_data
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []


def pieces_of(file, path: str, piece: int):
    """(archive's place, its length, record offsets, record lengths) of runs of about ``piece`` bytes; an archive without
    an index is one run without offsets."""
    found = members(file, file.size())
    for name, (method, _, _) in found.items():
        if method != 0:
            raise ValueError(f"{path}: member {name} is compressed, not stored")
    places: dict[str, list[tuple[int, int]]] = {}
    for name, (_, at, n) in found.items():
        if name.startswith("indexes/"):
            for warc, o, m in ranges(read_at(file, at, n).decode()):
                places.setdefault(f"archive/{warc}", []).append((o, m))
    for name, (_, at, n) in found.items():
        if name.startswith("archive/"):
            if name not in places:
                yield at, n, None, None
                continue
            run: list[tuple[int, int]] = []
            for o, m in sorted(places[name]):
                run.append((o, m))
                if o + m - run[0][0] >= piece:
                    yield at, n, [x for x, _ in run], [x for _, x in run]
                    run = []
            if run:
                yield at, n, [x for x, _ in run], [x for _, x in run]


def tasks(rows: int) -> int:
    """Partitions for so many packages or runs; a given number is not coalesced."""
    return max(1, min(rows, 10_000))


def read_packages(manifest: DataFrame, step: int = READ, piece: int = PIECE) -> DataFrame:
    """All records of the packages named in column ``path``, with headers and payload facts.

    Directories and indexes are read first, a task for each package; the runs of records that they tell of are then read
    by as many tasks, so neither a table of a few packages nor one large package ends in a single task. File systems are
    opened by the address in ``path`` in each worker, with the credentials of the worker's own environment.
    """

    def look(batches):
        for part in batches:
            for path in get(part, "path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    runs = list(pieces_of(file, path, piece))
                columns = [pa.array([path] * len(runs)), pa.array(range(len(runs)), pa.int32()), *(pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))]
                yield pa.record_batch(columns, ["path", "run", "at", "size", "offsets", "lengths"])

    def read(batches):
        for part in batches:
            for path, at, n, offsets, lengths in zip(*(get(part, c).to_pylist() for c in ("path", "at", "size", "offsets", "lengths")), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    yield from batched(records_of(file, at, n, step) if offsets is None else records_at(file, at, list(zip(offsets, lengths, strict=True)), step))

    packages = manifest.select("path")
    runs = packages.repartition(tasks(manifest.count()), "path").mapInArrow(look, "path string, run int, at long, size long, offsets array<long>, lengths array<long>")
    runs = written(runs, "runs")
    return runs.repartition(tasks(runs.count()), "path", "run").mapInArrow(
        read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, stated_digest string, payload binary")


def batched(records, rows: int = 200):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    held, size = [], 0

    def batch():
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for data in records:
        headers, payload = parse(data)
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        kind = headers.get("warc-type")
        if kind == "revisit":
            n = headers.get("x-payload-length")
            facts = (int(n) if n else None, stated, stated, None)
        else:
            facts = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), stated, payload)
        held.append((headers.get("x-page-id"), headers.get("warc-target-uri"), kind, headers.get("x-refers-to-page-id"), *facts))
        size += len(payload)
        if len(held) >= rows or size >= 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
