"""Text of files in an unknown encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.arrays import let

# Characters a Korean document usually holds, as a class of a regular expression.
COMMON = (
    r"[\t\n\r\x20-\x7E\uAC00-\uD7A3\u1100-\u11FF\u3130-\u318F\u4E00-\u9FFF\u3000-\u303F\uFF00-\uFFEF\u20A9]"
)


@F.udf(T.StringType(), useArrow=False)
def _decode(content: bytes | None, codec: str) -> str | None:
    """Replacing decoder for what the JVM functions refuse: bad sequences, and CP949.

    Plain rows: they come a hundred at a time, while an Arrow batch holds 10,000 whole files.
    """
    return None if content is None else bytes(content).decode(codec, "replace")


def garbage_score(text: Column) -> Column:
    """How unlikely a decoding is: NUL counts 3, U+FFFD 2, any other uncommon character 1."""
    uncommon = F.length(F.regexp_replace(text, f"{COMMON}+", ""))
    nul = F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return uncommon + 2 * nul + bad


def decode_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``encoding``: BOM, then strict UTF-8, then the cleanest candidate.

    Valid UTF-8 stays on the JVM; only other files cross to the Python decoder.
    """
    b = F.col("content")
    head = F.hex(F.substring(b, 1, 3))
    le, be = F.startswith(head, F.lit("FFFE")), F.startswith(head, F.lit("FEFF"))
    utf8 = ~le & ~be & F.is_valid_utf8(b.cast("string"))
    body = F.when(head == "EFBBBF", F.expr("substring(content, 4)")).otherwise(b)
    # Encodings other than UTF-8 without a BOM: UTF-16 is possible only where a NUL byte is.
    has_nul = F.contains(b, F.lit(b"\x00"))
    guess = ~le & ~be & ~utf8
    candidates = {"utf-16le": guess & has_nul, "utf-16be": guess & has_nul, "cp949": guess}
    codecs = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "cp949": "cp949"}
    out = files.withColumns(
        {
            "_bom": F.when(le, "utf-16le").when(be, "utf-16be").when(utf8, "utf-8"),
            "_body": F.when(le | be, F.expr("substring(content, 3)")).otherwise(body),
        }
    )
    for name, wanted in candidates.items():
        use = wanted | (F.col("_bom") == name)
        out = out.withColumn(f"_{name}", _decode(F.when(use, F.col("_body")), F.lit(codecs[name])))
    scored = F.array(
        *[
            F.struct(
                garbage_score(F.col(f"_{n}")).alias("score"),
                F.lit(i).alias("order"),
                F.lit(n).alias("encoding"),
                F.col(f"_{n}").alias("text"),
            )
            for i, n in enumerate(candidates)
        ]
    )
    best = let(
        F.array_min(F.filter(scored, lambda s: s["text"].isNotNull())),
        lambda s: F.struct(s["text"].alias("text"), s["encoding"].alias("encoding")),
    )
    picked = (
        F.when(F.col("_bom") == "utf-8", F.struct(F.col("_body").cast("string").alias("text"), F.lit("utf-8").alias("encoding")))
        .when(F.col("_bom") == "utf-16le", F.struct(F.col("_utf-16le").alias("text"), F.col("_bom").alias("encoding")))
        .when(F.col("_bom") == "utf-16be", F.struct(F.col("_utf-16be").alias("text"), F.col("_bom").alias("encoding")))
        .otherwise(best)
    )
    keep = [c for c in files.columns if c != "content"]
    return out.select(*keep, picked.alias("_p")).select(*keep, "_p.text", "_p.encoding")


def encoding_census(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding").agg(F.count("*").alias("files"))
