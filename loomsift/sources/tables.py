"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table read in fewer partitions than half the cores is spread over them from this size on.
SPREAD_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder, ``<folder>/<name>.parquet`` (a file or a directory of parts)."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A small table of one or few files on all cores; a table of many partitions stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if int(str(run.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or run.toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)
