"""The same pass operators on a stream of game files.

Everything up to the channels is per pass and narrow, so it needs no state and no watermark. The passer
lookup over a whole game (`compat`) needs the game's file as a whole: a file arrives in one micro-batch, so each
micro-batch looks its own files' passers up and nothing is held over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turfgrid.constants import Pitch
from turfgrid.plans.jobs import prepare
from turfgrid.sources import games


def stream_table(
    spark: SparkSession, directory: str, schema: StructType, files: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def located_stream(passes: DataFrame, pitch: Pitch = Pitch()) -> DataFrame:
    return prepare(passes, pitch)


def prepared_files(
    spark: SparkSession, directory: str, path: str, checkpoint: str, files_per_trigger: int = 100, compat: bool = True, pitch: Pitch = Pitch()
) -> StreamingQuery:
    """Located passes of the game files that are there and were not read before, appended below `path`; then it stops.

    With `compat` the passer is looked up over the whole file. `pass_id` is made of the micro-batch, the file's
    rank in it and the row. A micro-batch that is repeated after a failure replaces its own folder, so each
    pass is there once. The driver gets the names of the files of a micro-batch.
    """
    listed = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.csv")
    listed = listed.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).format("binaryFile").load(directory)

    def add(batch: DataFrame, number: int) -> None:
        files = sorted(r.path for r in batch.collect())
        if files:
            passes = games.scan_passes(batch.sparkSession, files)
            numbered = passes.withColumn("pass_id", F.col("pass_id") + F.lit(number << 50))
            prepare(numbered, pitch, compat).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = listed.select("path").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def append_to(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there to a Parquet folder, then stop; exactly once per row."""
    writer = table.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
