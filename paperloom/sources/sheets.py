"""Sheets as rows, and partitioned output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sheets_to_rows(sheets: DataFrame) -> DataFrame:
    """Cells of ``doc_id, sheet, rows ARRAY<ARRAY<STRING>>`` in long form."""
    return (
        sheets.select("doc_id", "sheet", F.posexplode("rows").alias("row", "r"))
        .select("doc_id", "sheet", "row", F.posexplode("r").alias("col", "text"))
    )


def sheet_shapes(sheets: DataFrame) -> DataFrame:
    """Rows of each sheet and columns of its first row."""
    return sheets.select(
        "doc_id",
        "sheet",
        F.size("rows").alias("rows"),
        F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0)).alias("cols"),
    )


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", files_per_value: int = 1, keep_others: bool = False
) -> None:
    """Write one folder per value of ``by``.

    Rows of a value are dealt to ``files_per_value`` parts, so a value with a large share of
    the rows is neither one task nor one file. Adaptive execution cuts parts that outgrow its advisory
    size, since a task sorts what it writes, and joins small ones; then a value has more or fewer files. With ``keep_others`` only folders of values that occur in
    ``df`` are replaced; otherwise everything below ``path`` is.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value)).cast("int")
    spread = df.withColumn("_salt", salt).hint("rebalance", *by, "_salt").drop("_salt")
    mode = "dynamic" if keep_others else "static"
    spread.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).format(fmt).save(path)


def read_partitioned(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """What ``write_partitioned`` wrote, columns in the order and types of ``schema``.

    A filter on the partition columns reads the folders it names only; a null value is null again, an
    empty string too (the folders of both have one name).
    """
    return spark.read.schema(schema).format(fmt).load(path).select(*schema.names)
