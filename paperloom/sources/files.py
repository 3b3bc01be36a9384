"""Inventory, census and intake checks of file listings.

A listing has path, length, mtime and, for the checks of content, the first bytes (``head``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document extensions in display order, folders that are skipped, limits.
DOC_EXTENSIONS = (".hwp", ".hwpx", ".hwpml", ".docx", ".doc", ".xlsx", ".xls", ".pdf", ".pptx", ".ppt", ".md", ".txt")
SKIP_NAMES = ("node_modules", ".git", ".DS_Store", "__pycache__", "dist", "build", ".next")
READ_EXTENSIONS = (".hwp", ".hwpx", ".hwpml", ".docx", ".xlsx", ".xls", ".pdf", ".md", ".txt")
WRITE_EXTENSIONS = (".hwpx", ".docx", ".xlsx", ".md", ".txt")
ZIP_EXTENSIONS = [".hwpx", ".docx", ".xlsx"]
MAX_BYTES = 100 * 1024 * 1024
OLE2_HEAD = "D0CF11E0A1B11AE1"


def read_listing(spark: SparkSession, path: str, head_bytes: int = 0) -> DataFrame:
    """Listing of a folder tree. Without ``head_bytes`` the contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    head = [F.substring("content", 1, head_bytes).alias("head")] if head_bytes else []
    return files.select("path", "length", F.col("modificationTime").alias("mtime"), *head)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment; a leading dot is part of the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def inventory(files: DataFrame, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """Documents first, then folders, then other files, as ``rank`` and ``path`` order them.

    With ``cap`` only the first entries, sorted; with ``max_depth`` none that lie deeper.

    ``files``: path relative to the root. Hidden and build entries are skipped with all they hold.
    """
    parts = F.split("path", "/")
    bad = F.exists("parts", lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIP_NAMES))
    # A folder or file at depth d has d segments above it.
    visible = files.select("path", parts.alias("parts")).filter(~bad)
    items = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda n: F.struct(
            F.concat(
                F.array_join(F.slice(F.col("parts"), F.lit(1), n), "/"),
                F.when(n < F.size("parts"), "/").otherwise(""),
            ).alias("path"),
            (n - 1).alias("depth"),
            (n < F.size("parts")).alias("is_dir"),
        ),
    )
    entries = visible.select(F.inline(items))
    if max_depth is not None:
        entries = entries.filter(F.col("depth") <= max_depth)
    entries = entries.distinct()
    is_doc = ~F.col("is_dir") & extension(F.col("path")).isin(*DOC_EXTENSIONS)
    rank = F.when(is_doc, 0).when(F.col("is_dir"), 1).otherwise(2)
    ranked = entries.select("path", "is_dir", is_doc.alias("is_doc"), rank.alias("rank"))
    return ranked if cap is None else ranked.orderBy("rank", "path").limit(cap)


def classify_files(files: DataFrame) -> DataFrame:
    """Kind, writability and planned conversion of the readable files."""
    ext = extension(F.col("path"))
    return (
        files.withColumn("ext", ext)
        .filter(F.col("ext").isin(*READ_EXTENSIONS))
        .select(
            "path",
            "ext",
            F.when(F.col("ext").isin(".xlsx", ".xls"), "sheet")
            .when(F.col("ext").isin(".md", ".txt"), "other")
            .otherwise("doc")
            .alias("kind"),
            (F.col("ext").isin(*WRITE_EXTENSIONS) | (F.col("ext") == ".hwp")).alias("writable"),
            F.when(F.col("ext") == ".hwp", F.regexp_replace("path", r"(?i)\.hwp$", ".hwpx"))
            .when(F.col("ext") == ".xls", F.regexp_replace("path", r"(?i)\.xls$", ".xlsx"))
            .otherwise(F.col("path"))
            .alias("output_path"),
            F.when(F.col("ext") == ".hwp", ".hwp → .hwpx")
            .when(F.col("ext") == ".xls", ".xls → .xlsx")
            .alias("conversion"),
        )
    )


def triage(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Why a file is not taken in: too large, an old binary, or not what its name says."""
    ext = extension(F.col("path"))
    head = F.hex("head")
    is_ole2 = F.startswith(head, F.lit(OLE2_HEAD))
    is_zip = F.startswith(head, F.lit("504B")) & (F.length("head") >= 4)
    return files.select(
        "path",
        F.when(is_ole2, "ole2").when(is_zip, "zip").otherwise("other").alias("content_type"),
        F.when(F.col("length") > max_bytes, "too_large")
        .when((ext == ".hwp") | (is_ole2 & (ext != ".hwp") & ~ext.isin(".doc", ".xls", ".ppt")), "old_binary")
        .when(ext.isin(ZIP_EXTENSIONS) & ~is_zip, "content_mismatch")
        .otherwise("ok")
        .alias("reason"),
    )
