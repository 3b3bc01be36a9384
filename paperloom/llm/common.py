"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from paperloom.plans.registry import Query
from paperloom.session import shared_folder

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Words everywhere in this subpackage: runs of anything but space, tab, LF, VT, FF and CR.
# bytes.split() cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of text that one numpy step handles at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of the write again, so they go as soon as it has ended.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of a batch, so that few values are Python objects at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty; never decodes, so never fails."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(data: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of the list whose texts together hold about limit bytes."""
    start = size = 0
    for i, x in enumerate(data):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(data):
        yield start, len(data)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
