"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table below this size that comes as fewer splits than there are cores is spread over
# them. Larger tables are never shuffled here: their splits already feed every core.
SPREAD_MIN_BYTES = 1 << 20
SPREAD_MAX_BYTES = 1 << 30


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are heavy to process (whole texts).

    One small file with one row group is one task; spread it so that every core works.
    """
    df = load(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    conf = spark._jsc.hadoopConfiguration()
    size = path.getFileSystem(conf).getContentSummary(path).getLength()
    if SPREAD_MIN_BYTES < size < SPREAD_MAX_BYTES:
        return df.repartition(cores)
    return df
