"""What becomes of proposals, kept as state with timers for their deadlines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.streaming.feeds import LATENESS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = "cast(unix_micros(ts) as bigint)"
# Proposals are dealt to so many groups of the state by a hash. Answers are 0 and 1.
BUCKETS = 4096
ASK = 2


@contextmanager
def timed_state(spark: SparkSession):
    """Streams started inside keep their state where timers are possible."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


class Deadlines(StatefulProcessor):
    """Per bucket of proposals: what was asked and answered and is open, and one timer for what is due next.

    A proposal is decided when the deadline of when it was first asked has passed. Proposals share the
    calls to the state store and the timer of their bucket, which are what costs time.
    """

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def _timer(self, at):
        # Milliseconds after the last microsecond that still counts.
        return (at + self.timeout) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [b.loc[b["what"] >= 0, ["name", "at", "what"]] for b in rows]
        new = [b for b in new if len(b)]
        if new:
            came = pd.concat(new)
            self.open.appendValue((_packed(came),))
            at = int(self._timer(came["at"].min()))
            due = self.due.get()
            if due is None or at < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self._next(at)
        return iter([])

    def _next(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = pd.concat([_unpacked(p[0]) for p in self.open.get()], ignore_index=True)
        of, names = pd.factorize(rows["name"])
        at, what = rows["at"].to_numpy(), rows["what"].to_numpy()
        is_ask = what == ASK
        asked = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(asked, of[is_ask], at[is_ask])
        known = np.zeros(len(names), bool)
        known[of[is_ask]] = True
        deadline = self._timer(np.where(known, asked, 0))
        done = known & (deadline <= now)
        if done.any():
            within = done[of] & ~is_ask & (at >= asked[of]) & (at - self.timeout <= asked[of])
            # A refusal is before an approval of the same time.
            answers = rows[within].assign(of=of[within]).sort_values(["at", "what"]).drop_duplicates("of")
            outcome = np.full(len(names), "expired", object)
            outcome[answers["of"].to_numpy()] = np.where(answers["what"] == 1, "approved", "rejected")
            yield pd.DataFrame({"name": names[done], "asked": asked[done], "outcome": outcome[done]})
        # An answer to what was never asked goes with its own deadline.
        timer = np.where(known[of], deadline[of], self._timer(at))
        left = timer > now
        if left.any():
            self.open.put([(_packed(rows[left]),)])
            self._next(int(timer[left].min()))
        else:
            self.open.clear()
            self.due.clear()


def _micros(spark: SparkSession, timeout: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {timeout})").first()[0]


def pending_approvals(events: DataFrame, timeout: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Outcome of each proposal of a stream: approved, rejected, or expired.

    ``events``: proposal_id, ts, type (approval-required | approval), approved. A proposal is asked
    when it first occurs; the earliest answer from then up to ``timeout`` decides, a refusal before
    an approval of the same time. It comes out once the watermark has passed its deadline, however
    the events were dealt to batches; its state goes then. A proposal that is asked again later
    is a new one. Start inside ``timed_state``.
    """
    micros = _micros(events.sparkSession, timeout)
    # A null proposal has a name of its own here.
    name = F.coalesce(F.concat(F.lit("i"), F.col("proposal_id").cast("string")), F.lit("n"))
    answer = F.when(F.col("type") == "approval", F.col("approved").cast("int"))
    what = F.when(F.col("ts").isNotNull(), F.when(F.col("type") == "approval-required", ASK).otherwise(answer))
    keyed = events.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket"),
        name.alias("name"),
        "ts",
        F.coalesce(F.expr(_MICROS), F.lit(0)).cast("bigint").alias("at"),
        F.coalesce(what, F.lit(-1)).alias("what"),
    )
    out = keyed.groupBy("bucket").transformWithStateInPandas(Deadlines(micros), "name string, asked long, outcome string", "append", "EventTime")
    number = F.when(F.col("name") != "n", F.col("name").substr(F.lit(2), F.length("name"))).cast(events.schema["proposal_id"].dataType)
    return out.select(number.alias("proposal_id"), F.timestamp_micros("asked").alias("asked_at"), "outcome")


def approval_outcomes(events: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """The same over a table that has ended: one outcome per proposal, from when it was first asked."""
    micros = _micros(events.sparkSession, timeout)
    at = F.expr(_MICROS)
    answer = F.when((F.col("type") == "approval") & F.col("approved").isNotNull(), F.struct(at.alias("at"), F.col("approved").alias("ok")))
    grouped = events.groupBy("proposal_id").agg(
        F.min(F.when(F.col("type") == "approval-required", at)).alias("asked"), F.collect_list(answer).alias("answers")
    ).filter("asked IS NOT NULL")
    within = F.filter("answers", lambda a: (a["at"] >= F.col("asked")) & (a["at"] <= F.col("asked") + micros))
    first = F.array_min(within)
    return grouped.select(
        "proposal_id",
        F.timestamp_micros("asked").alias("asked_at"),
        F.when(first.isNull(), "expired").when(first["ok"], "approved").otherwise("rejected").alias("outcome"),
    )
