"""Session helpers: builder, reliable checkpoints and scratch tables. Which side of a join is broadcast is left to Spark, but for
the facts of code files, whose size it takes too low (``by_key``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wardlight", cpus: str | int = 8) -> SparkSession:
    """Local session used by the tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session; a temporary one in local runs without the setting."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _local.setdefault("folder", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        shared = _local["folder"]
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives executor loss.

    With ``by`` the rows are hash-partitioned and sorted on these columns first, and the result keeps both: later joins
    on exactly these columns move and sort the other side only. The partitioning of a plan is known up front only
    without adaptive execution, which is therefore off for this one write.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if not by:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(parts, *by).sortWithinPartitions(*by).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back: lineage is cut and readers take single columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a scratch folder removed when the driver ends; results may be read lazily until then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def by_key(df: DataFrame) -> DataFrame:
    """Have joins with ``df`` move rows by key; the mark holds up to the next join.

    Spark takes a written table to be as large as its compressed file and a text that is taken apart no larger than it was, so it
    would broadcast rows that grow with the input, all of them through the driver.
    """
    return df.hint("merge")


SPREAD_BYTES_PER_CORE = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores before work that is heavy per row.

    A table of less than one usual split per core may sit in a single file and then runs in one task. Larger inputs
    already have enough splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


PART_BYTES = 1024 * 1024
MOST_PARTS = 4096


def dealt(df: DataFrame, *by: str, grows: int = 1) -> DataFrame:
    """Hash-partition ``df`` on ``by`` into parts that stay small however large the input is.

    Distinct rows of these columns are then found inside each part, with no other shuffle, so the memory of a task does
    not grow with the input. ``grows`` is how many rows a row becomes before that.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size * grows // PART_BYTES))
    return df.repartition(parts, *by)
