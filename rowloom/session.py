"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", name: str = "rowloom", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    n = cores if str(cores).isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and hand-over tables that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="rowloom-")
    sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a cluster where it is not installed; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_rowloom_shipped", False) or sc.master.startswith("local"):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = os.path.join(tempfile.mkdtemp(prefix="rowloom-"), "rowloom.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(packed)
    sc._rowloom_shipped = True


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: lineage is cut and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column ids, for one side of a cogroup of related tables."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal rows out over the cores when the input has fewer parts than there are cores.

    For work in Python on small inputs; an input with enough splits stays where
    it is. With ``rows`` a task gets about that many at most, however many the
    table has: for short rows that are costly to work on. They are counted
    first, so ``df`` should be cheap to count.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        tasks = max(tasks, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


DEALT_ROWS = 2_000_000


def dealt(key: str, *tables: DataFrame, rows: int = DEALT_ROWS) -> list[DataFrame]:
    """The tables dealt by ``key`` to as many tasks, each with about ``rows`` rows of the longest.

    For narrow rows that shrink much on their way: Spark joins shuffle
    partitions by their compressed size, which says little about the memory
    that their rows take. The tables are counted first, so they should be cheap
    to count.
    """
    tasks = max(1, -(-max(t.count() for t in tables) // rows))
    return [t.repartition(tasks, key) for t in tables]


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; for narrow, pinned tables.

    Larger ones come back as they are and are joined by shuffle.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
