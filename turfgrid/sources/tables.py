"""Parquet sinks for results, and readers for them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TASK_SURFACES = 4_000  # about 110 MB before they are packed



def write_loss(history: DataFrame, path: str) -> None:
    """The table behind the loss curves; a row per epoch, so one file."""
    history.repartition(1).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row evaluation table."""
    metrics.repartition(1).write.mode("overwrite").parquet(path)


@contextmanager
def _unsorted(spark: SparkSession):
    """For long rows of numbers that lie by file already.

    Files of a task are written side by side; rows are not sorted again, which would spill surfaces. A list without nulls
    gets the short form of Parquet's lists, where its numbers are not wrapped one by one.
    """
    names = {"spark.sql.maxConcurrentOutputFileWriters": "4", "spark.sql.parquet.writeLegacyFormat": "true"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


# like neighbours pack well as they are; to look each number up in a dictionary first takes longer than to write it
_PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def by_game(located: DataFrame) -> DataFrame:
    """Passes laid out for `write_surfaces`, while a row has 1 KB and not the 28 KB of a surface.

    A task has few games, a large game lies in several tasks, and passes from the same cell follow each other.
    """
    order = ["game_id", "ball_y", "ball_x", "pass_id"]
    tasks = max(1, -(-located.count() // TASK_SURFACES))
    return located.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def write_surfaces(surfaces: DataFrame, path: str) -> None:
    """Scored surfaces, one row per pass with the cells as an array, in one folder per game.

    Nothing is shuffled: score passes that are laid out `by_game`, so that a game has few files. Surfaces from the
    same ball cell are alike, in most models over large parts, and pack well where they follow each other.
    """
    with _unsorted(surfaces.sparkSession):
        surfaces.write.mode("overwrite").partitionBy("game_id").options(**_PACKED).parquet(path)


def write_bucketed(table: DataFrame, path: str, key: str = "pass_id", buckets: int = 64, laid: bool = False, ordered: bool = True, packed: bool = False) -> DataFrame:
    """Write a table in buckets of a key, sorted within if `ordered`, and return it as stored.

    Tables in equally many buckets of the same key join and group on it without an exchange or, where they are ordered, a sort. The
    number of buckets is fixed when a table is written: take one that keeps a bucket within a task's memory.
    `laid` says that the table comes from `repartition(buckets, key)` already. `packed` is for long rows that are laid
    out and not `ordered`: they keep the order that they have, without a sort, and like neighbours pack well.
    """
    spark = table.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    parts = table if laid else table.repartition(buckets, key)
    writer = parts.write.bucketBy(buckets, key)
    writer = writer.sortBy(key) if ordered else writer
    writer = writer.format("parquet").option("path", path)
    if packed:
        with _unsorted(spark):
            writer.options(**_PACKED).saveAsTable(name)
    else:
        writer.saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # the name goes, the files stay
    return stored


def write_passes(passes: DataFrame, path: str) -> None:
    """Passes in the normal form; the input for all further work."""
    passes.write.mode("overwrite").partitionBy("game_id").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
