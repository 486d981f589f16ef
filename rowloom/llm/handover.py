"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.session import scratch_path


def _place(df: DataFrame, path: str):
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hand_over(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors.

    The table goes with the application, or earlier by ``discard``. What was
    shuffled for it goes as soon as it is written.
    """
    path = scratch_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    place, files = _place(out, path)
    files.deleteOnExit(place)
    out._handed_over = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove handed over tables that nothing will read again; what was made from them is written already."""
    for table in tables:
        place, files = _place(table, table._handed_over)
        files.delete(place, True)
