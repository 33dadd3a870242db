"""Intermediate tables in the folder that the cluster shares; they cut lineage and outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turfgrid.session import scratch_dir


def written(table: DataFrame, label: str) -> DataFrame:
    """The table, written once as Parquet below `spark.checkpoint.dir` and read from there."""
    spark = table.sparkSession
    path = scratch_dir(spark, label)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a `written` table that is not needed any more."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
