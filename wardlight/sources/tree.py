"""Source trees and rule folders."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.catalog.fixed import CONFIG_CHECK_BY_NAME, LANGUAGE_BY_EXT, SKIP_DIRS
from wardlight.catalog.rules import RULE_SCHEMA
from wardlight.operators.files import basename, extension
from wardlight.session import written

LISTED = "path binary, file string, size bigint"
READ = "file string, size bigint, content binary"
RUN_ROWS, RUN_BYTES = 4096, 8 * 1024 * 1024
PART_FILES, MOST_PARTS = 2000, 4096


def source_tree_scan(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """``(file, ext, size, content)`` of supported files below ``path``.

    Bytes that are no UTF-8 become replacement characters. There is no size limit unless ``max_bytes`` sets one; files
    above it keep their row with null content and are not opened. Skipped folders are matched on the part of the path
    below the root.

    Folders are listed and files read in tasks, so the driver holds no names. Addresses that Arrow's file systems don't
    know, and paths that are no folder, go by Spark's own reader, whose listing lies in the driver and hides names that
    start with a dot or an underscore.
    """
    root = folder_address(spark, path)
    raw = by_reader(spark, path, max_bytes) if root is None else by_tasks(spark, root, max_bytes)
    return raw.select("file", extension(F.col("file")).alias("ext"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def entered(name) -> Column:
    """True for folders that are scanned."""
    return ~name.isin(SKIP_DIRS) & ~F.startswith(name, F.lit("."))


def supported(file) -> Column:
    return extension(file).isin(list(LANGUAGE_BY_EXT)) | F.lower(basename(file)).isin(list(CONFIG_CHECK_BY_NAME))


def folder_address(spark: SparkSession, path: str) -> str | None:
    """Full address of a folder that tasks can open by themselves, a bare path for local ones; None for anything else."""
    from pyarrow import ArrowException
    from pyarrow import fs as afs

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    address = fs.makeQualified(at).toString()
    if address.startswith("file:"):
        return re.sub(r"^file:(//(?=/))?", "", address)
    try:
        afs.FileSystem.from_uri(address)
        return address
    except (ArrowException, OSError, ValueError):
        return None


def opener(root: str):
    """Two functions for tasks: what lies in a folder, as ``(path, name, size)`` with no size for a folder, and the bytes of a file.

    A local folder is gone through entry by entry. Links are followed, but not to a folder they lie in.
    """
    import os

    from pyarrow import fs as afs

    if root.startswith("/"):
        def entries(folder):
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir():
                        if not e.is_symlink() or os.path.commonpath([os.path.realpath(folder), to := os.path.realpath(e.path)]) != to:
                            yield e.path, e.name, None
                    elif e.is_file():
                        yield e.path, e.name, e.stat().st_size

        def content(path):
            with open(path, "rb") as f:
                return f.read()
    else:
        store = afs.FileSystem.from_uri(root)[0]

        def entries(folder):
            for e in store.get_file_info(afs.FileSelector(folder.decode())):
                yield e.path.encode(), e.base_name.encode(), e.size if e.is_file else None

        def content(path):
            with store.open_input_stream(path.decode()) as f:
                return f.read()

    return entries, content


def in_runs(rows, schema, weight):
    """Record batches of at most ``RUN_ROWS`` rows, closed as soon as their weights sum up to ``RUN_BYTES``."""
    import pyarrow as pa

    run, size = [], 0
    for row in rows:
        run.append(row)
        size += weight(row)
        if len(run) == RUN_ROWS or size >= RUN_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in run], schema)
            run, size = [], 0
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in run], schema)


def by_tasks(spark: SparkSession, root: str, max_bytes: int | None) -> DataFrame:
    """``(file, size, content)``, the folders of one depth listed in a round; the names are written to the shared folder."""
    def listed(batches):
        import pyarrow as pa

        entries, _ = opener(root)
        rows = ((path, (f"{file}/" if file else "") + name.decode("utf-8", "replace"), size) for b in batches
                for folder, file in zip(b["path"].to_pylist(), b["file"].to_pylist()) for path, name, size in entries(folder))
        return in_runs(rows, pa.schema([("path", pa.binary()), ("file", pa.string()), ("size", pa.int64())]), lambda r: 0)

    def read(batches):
        import pyarrow as pa

        _, content = opener(root)
        rows = ((file, size, None if max_bytes is not None and size > max_bytes else content(path)) for b in batches
                for path, file, size in zip(*(b[c].to_pylist() for c in ("path", "file", "size"))))
        return in_runs(rows, pa.schema([("file", pa.string()), ("size", pa.int64()), ("content", pa.binary())]), lambda r: len(r[2] or b""))

    def dealt_out(df, n, each):
        return df.repartition(max(1, min(n, MOST_PARTS, max(spark.sparkContext.defaultParallelism, n // each))), "path")

    base = root if root.startswith("/") else folder_of(root)
    folders, n, files = spark.createDataFrame([(os.fsencode(base), "", None)], LISTED), 1, None
    while n:
        below = written(dealt_out(folders, n, 1).mapInArrow(listed, LISTED).filter(
            (F.col("size").isNull() & entered(basename(F.col("file")))) | (F.col("size").isNotNull() & supported(F.col("file")))), "listed")
        folders, found = below.filter("size is null"), below.filter("size is not null")
        n, files = folders.count(), found if files is None else files.unionByName(found)
    return dealt_out(files, files.count(), PART_FILES).mapInArrow(read, READ)


def folder_of(address: str) -> str:
    """Path of an address inside its Arrow file system."""
    from pyarrow import fs as afs

    return afs.FileSystem.from_uri(address)[1]


def by_reader(spark: SparkSession, path: str, max_bytes: int | None) -> DataFrame:
    """``(file, size, content)`` by Spark's binary source; ``length`` is a pushed filter of it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if max_bytes is not None:
        large = raw.filter(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
        raw = raw.filter(F.col("length") <= max_bytes).select("path", "length", "content").unionByName(large)
    root = path.rstrip("/") + "/"
    below = F.regexp_replace(F.element_at(F.split("path", "\\Q" + root + "\\E"), -1), "^file:", "")
    parts = F.split(below, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return raw.filter(F.forall(folders, entered) & supported(F.col("path"))).select(below.alias("file"), F.col("length").alias("size"), "content")


def rule_catalog_load(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a folder of YAML files, one or many documents per file; the last one (by path, then place in the file) wins
    on a repeated id.

    Files are read one by one in tasks, so a large catalog belongs into files of many documents: the time then goes by
    rules and not by files, which the driver has to list. A document that is no YAML is left out, the others of its file
    are kept. The parse is a small Arrow-batched helper.
    """
    fields = [f.name for f in RULE_SCHEMA.fields]
    lists = ["sources", "sinks", "sanitizers"]

    def parse(batches):
        import re

        import pandas as pd
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        bound = re.compile(r"^---(?=\s|$)", re.MULTILINE)

        def documents(text):
            """Documents in order; after a broken one the file is read part by part."""
            try:
                return list(yaml.load_all(text, loader))
            except yaml.YAMLError:
                good = []
                for part in bound.split(text):
                    try:
                        good.extend(yaml.load_all(part, loader))
                    except yaml.YAMLError:
                        continue
                return good

        def table(rows):
            return pd.DataFrame(rows, columns=fields + ["path", "place"])

        for pdf in batches:
            rows = []
            for p, text in zip(pdf["path"], pdf["value"]):
                for place, doc in enumerate(documents(text)):
                    if not isinstance(doc, dict) or not doc.get("rule_id"):
                        continue
                    row = {f: doc.get(f) for f in fields}
                    for f in fields:
                        if f in lists:
                            row[f] = [str(x) for x in (row[f] or [])]
                        elif f == "cvss_score":
                            try:
                                row[f] = None if row[f] is None else float(row[f])
                            except (TypeError, ValueError):
                                row[f] = None  # the rule check reports the missing score
                        elif row[f] is not None:
                            row[f] = str(row[f])
                    rows.append({**row, "path": p, "place": place})
                if len(rows) > 5000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    schema = T.StructType(RULE_SCHEMA.fields + [T.StructField("path", T.StringType()), T.StructField("place", T.LongType())])
    texts = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml")
        .text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = texts.mapInPandas(parse, schema)
    return parsed.groupBy("rule_id").agg(F.max_by(F.struct(*fields[1:]), F.struct("path", "place")).alias("r")).select("rule_id", "r.*")


def register_rules(base: DataFrame, extra: DataFrame, level: str = "basic") -> DataFrame:
    """Add user rules to a catalog: rules that fail the check are left out, user rules win over shipped ones."""
    from wardlight.operators.rules_check import rule_lint

    bad = rule_lint(extra, level).select("rule_id").distinct()
    good = extra.join(bad, "rule_id", "left_anti")
    return base.join(good.select("rule_id"), "rule_id", "left_anti").unionByName(good)
