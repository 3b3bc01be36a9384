"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target over its size says how often each of its documents is taken; the whole part is
taken outright, the rest is an inclusion probability. The flight moves these probabilities along
directions that change neither the number of documents nor of words taken, until all but two of a
block are 0 or 1; the leftovers of all blocks form new blocks, and so on until one block is left.
What remains then, two documents of a source, is the landing.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from paperloom.llm.common import WORD, load, query, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
# Documents of a flight block: what one task holds at a time.
BLOCK_ROWS = 4096
SEED = 17
EPS = 1e-9


def flight(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move probabilities within the null space of (1, size) until at most two are fractional."""
    pi = list(pi)
    work: list[int] = []
    for i, p in enumerate(pi):
        if EPS < p < 1 - EPS:
            work.append(i)
        if len(work) == 3:
            a, b, c = work
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            _move(pi, work, u, rng)
            work = [j for j in work if EPS < pi[j] < 1 - EPS]
    return [0.0 if p <= EPS else 1.0 if p >= 1 - EPS else p for p in pi]


def landing(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Decide what the flight left: give up the number of documents first, then words."""
    pi = list(pi)
    work = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    while len(work) > 1:
        a, b = work[:2]
        u = (size[b], -size[a]) if size[a] and size[b] else (1.0, -1.0)
        _move(pi, [a, b], u, rng)
        work = [j for j in work if EPS < pi[j] < 1 - EPS]
    for i in work:
        pi[i] = float(rng.random() < pi[i])
    return [float(round(p)) for p in pi]


def _move(pi: list[float], at: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    up = min((1 - pi[i]) / d if d > 0 else -pi[i] / d for i, d in zip(at, u) if d)
    down = min(pi[i] / d if d > 0 else (pi[i] - 1) / d for i, d in zip(at, u) if d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in zip(at, u):
        pi[i] = min(1.0, max(0.0, pi[i] + step * d))


def targets(sizes: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of (source, source_size, target) from rows of (source, source_size), one per source.

    Sources in code-point order, null last, take the weights in turn. Targets are in proportion to
    them and sum to share of all words; none is over most times its source's size: what is over goes
    to the others by weight, until none is.
    """
    spark = sizes.sparkSession
    numbered = sizes.select(source_col, "source_size").orderBy(F.col(source_col).asc_nulls_last()).rdd.zipWithIndex()
    n = len(weights)
    weighted = spark.createDataFrame(numbered.map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % n]))), f"`{source_col}` string, source_size long, _weight double")
    weighted = staged(weighted, "mix-sources")
    cap = most * F.col("source_size")
    goal = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    # Words per weight for the sources below their cap; it only grows, so a capped one stays capped.
    level = 0.0
    while True:
        over = F.col("_weight") * level > cap
        got = weighted.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("_weight"))).alias("open")).first()
        if not got["open"]:
            break
        higher = (goal - (got["capped"] or 0.0)) / got["open"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return weighted.select(source_col, "source_size", F.least(F.col("_weight") * level, cap).alias("target"))


def _block_flight(seed: int, level: int, last: bool):
    """Flight, and landing on the last level, of one block; the same for the same rows."""

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what is left to the landing is short.
        rows = rows.sort_values(["size", "text_hash", "id"], ascending=[False, True, True], kind="stable")
        rng = random.Random(f"{seed} {level} {rows['source'].iloc[0]} {rows['block'].iloc[0]}")
        size = rows["size"].astype(float).tolist()
        pi = flight(rows["pi"].tolist(), size, rng)
        return rows.assign(pi=landing(pi, size, rng) if last else pi)

    return fly


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS, seed: int = SEED, **mix) -> DataFrame:
    """Rows of (id, text_hash, source, rows, size, source_size, target, copies).

    One row per distinct document (id, text and source); rows says how often it stands in the table,
    copies how many of them the mix holds, all of `rows` counted together.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    units = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"), words.alias("size"))
        .groupBy("id", "text_hash", "source", "size")
        .agg(F.count("*").alias("rows"))
    )
    units = staged(units, "mix-units")
    by_source = staged(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")), "mix-sizes")
    aims = targets(by_source, "source", **mix).select(F.col("source").alias("_source"), "source_size", "target")
    counts = by_source.select(F.col("source").alias("_source2"), "units")
    facts = aims.join(counts, F.col("_source").eqNullSafe(F.col("_source2"))).drop("_source2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    times = F.col("rows") * rate
    block = F.pmod(F.xxhash64("id", "text_hash", F.lit(seed)), F.ceil(F.col("units") / block_rows)).cast("int")
    open_ = units.join(facts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    open_ = (
        open_.withColumn("base", F.floor(times + EPS).cast("long"))
        .withColumn("pi", F.greatest(times - F.col("base"), F.lit(0.0)))
        .withColumn("block", block)
    )
    most_units = by_source.agg(F.max("units")).first()[0] or 0
    done, level = [], 0
    while True:
        blocks = max(1, math.ceil(most_units / block_rows))
        last = blocks == 1

        moved = staged(open_.groupBy("source", "block").applyInPandas(_block_flight(seed, level, last), open_.schema), "mix-flight")
        if last:
            done.append(moved)
            break
        fractional = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(moved.filter(~fractional))
        # Two leftovers of each block: a source that had few blocks has one from now on.
        open_ = moved.filter(fractional).withColumn("units", 2 * F.ceil(F.col("units") / block_rows)).withColumn("block", block)
        most_units, level = 2 * blocks, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "text_hash", "source", "rows", "size", "source_size", "target", (F.col("base") + F.col("pi").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, with the columns of docs, each repeated as often as it is taken.

    Null and empty texts have size 0 and are taken like others; a null source is a source; null ids
    and repeated rows are documents of their own; an empty table gives an empty table.
    """
    planned = plan(docs, id_col, text_col, source_col, **how)
    marked = docs.withColumn("_mix_hash", F.xxhash64(text_col))
    chosen = planned.select(F.col("id").alias("_mix_id"), F.col("text_hash").alias("_mix_text"), F.col("source").alias("_mix_source"), F.col("rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies"))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_hash") == F.col("_mix_text")) & F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col("_mix_source"))
    joined = marked.alias("d").join(chosen, same)
    once = joined.filter("_mix_rows = 1").withColumn("_mix_times", F.col("_mix_copies"))
    # Rows that repeat a document share its copies out among them.
    number = F.row_number().over(Window.partitionBy("_mix_id", "_mix_text", "_mix_source").orderBy("_mix_text")) - 1
    many = joined.filter("_mix_rows > 1").withColumn("_mix_number", number)
    many = many.withColumn("_mix_times", F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (F.col("_mix_number") < F.col("_mix_copies") % F.col("_mix_rows")).cast("long")).drop("_mix_number")
    both = once.unionByName(many).filter("_mix_times > 0")
    return both.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*[F.col(c) for c in docs.columns])


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    rows = planned.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("number") < F.col("copies") % F.col("rows")).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
