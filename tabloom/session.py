"""Session helpers: a local builder, and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

_OWN_DIR: dict[str, str] = {}
_OWNED = threading.local()


def local_session(app: str = "tabloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster `spark-submit` provides one."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if context.applicationId not in _OWN_DIR:
        folder = tempfile.TemporaryDirectory(prefix="tabloom-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _OWN_DIR[context.applicationId] = folder.name
    return _OWN_DIR[context.applicationId]


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tabloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Free the stored copy behind `df`, once nothing reads it any more."""
    spark, marker = df.sparkSession, f"/tabloom/{df.sparkSession.sparkContext.applicationId}/"
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if marker in folder:
            remove(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Free every stored copy of this application, when its results have been used."""
    remove(spark, scratch_root(spark))


@contextmanager
def discarding():
    """Free, at the end, all copies that this thread stores meanwhile."""
    outer, _OWNED.paths = getattr(_OWNED, "paths", None), []
    try:
        yield
    finally:
        for spark, path in _OWNED.paths:
            remove(spark, path)
        _OWNED.paths = outer


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The result has no lineage, so a lost executor costs one file scan instead of a
    recomputation; unlike `checkpoint()`, the plan runs once and the copy is columnar.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if (owner := getattr(_OWNED, "paths", None)) is not None:
        owner.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows_per_task: int = 25_000) -> DataFrame:
    """Fewer, fuller partitions for a stored table that iterative fits scan many times."""
    needed = max(1, -(-df.count() // rows_per_task))
    return df.coalesce(needed) if needed < df.sparkSession.sparkContext.defaultParallelism else df


def rows_if_small(df: DataFrame, max_rows: int = 100_000) -> list | None:
    """The rows of `df` if there are at most `max_rows`, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a stored table."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    conf = spark._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def small_table(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 << 20) -> DataFrame:
    """`df` stored, and a broadcast side if its rows and its bytes, both checked, are few.

    A larger table comes back without a hint, so the joins that use it fall back to shuffles
    planned by AQE.
    """
    table = materialize(df, "table")
    few = table.count() <= max_rows and stored_bytes(table) <= max_bytes
    return F.broadcast(table) if few else table
