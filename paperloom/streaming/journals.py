"""Journals that grow: what is appended comes out once, as records.

State per session is how far it was read, its unfinished last line and its first line; what arrives
ahead of its place waits in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.arrays import let
from paperloom.functions.text import SPACE_STRING, is_blank
from paperloom.sources.journal import record_columns, record_of

# Sessions are dealt to so many groups of the state by a hash.
BUCKETS = 4096
_OUT = "name string, head string, line_no long, lines array<string>"


class Growth(StatefulProcessor):
    """Joins the pieces of sessions by their offsets and gives out the lines that are complete.

    The sessions of a bucket share its batches; each has entries of its own in the state store, one of
    which is read and written per batch, and only for sessions with new pieces.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.read = handle.getMapState("read", "name string", "upto long, line_no long, unfinished string, head string, waiting array<long>")
        self.ahead = handle.getMapState("ahead", "name string, at long", "chunk string")

    def _lines(self, name: str, state: list, at: int, chunk: str) -> list[tuple]:
        """Reads what of a piece is new; ``state`` goes on."""
        upto, line_no, unfinished, head = state[:4]
        new = chunk[upto - at :]
        if not new:
            return []
        *lines, unfinished = (unfinished + new).split("\n")
        if head is None:
            head = next((line for line in lines if line.strip(SPACE_STRING)), None)
        state[:4] = [upto + len(new), line_no + len(lines), unfinished, head]
        return [(name, head, line_no, lines)] if lines else []

    def _piece(self, name: str, state: list, at: int, chunk: str) -> list[tuple]:
        if at <= state[0]:
            return self._lines(name, state, at, chunk)
        # Of two pieces that wait for one place the longer one holds the other.
        if at not in state[4]:
            state[4].append(at)
            self.ahead.updateValue((name, at), (chunk,))
        elif len(self.ahead.getValue((name, at))[0]) < len(chunk):
            self.ahead.updateValue((name, at), (chunk,))
        return []

    def _reached(self, name: str, state: list) -> list[tuple]:
        """Pieces that waited for a place that has been read up to."""
        found = []
        for at in sorted(state[4]):
            if at > state[0]:
                break
            found += self._lines(name, state, at, self.ahead.getValue((name, at))[0])
            self.ahead.removeKey((name, at))
            state[4].remove(at)
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states: dict[str, list] = {}
        before: dict[str, tuple] = {}
        for batch in rows:
            found = []
            for name, at, chunk in zip(batch["name"].tolist(), batch["at"].tolist(), batch["chunk"].tolist()):
                if name not in states:
                    known = self.read.getValue((name,))
                    states[name] = [*known[:4], list(known[4])] if known else [0, 0, "", None, []]
                    before[name] = (*states[name][:4], tuple(states[name][4]))
                found += self._piece(name, states[name], at, chunk)
            if found:
                yield _table(found)
        late = [r for name, state in states.items() for r in self._reached(name, state)]
        if late:
            yield _table(late)
        for name, state in states.items():
            if (*state[:4], tuple(state[4])) != before[name]:
                self.read.updateValue((name,), tuple(state))


def _table(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["name", "head", "line_no", "lines"])


def growing_journal(pieces: DataFrame) -> DataFrame:
    """Records of journals that are appended to while they are read.

    ``pieces``: session_id, at, chunk; ``chunk`` is the text of the journal from character ``at`` on
    (null: 0). A copy of the whole journal so far is a piece at 0, an append is one at the old length;
    repeated, overlapping and early pieces are all the same to the result. A line comes out once,
    when its line end has arrived, and only if the first line with text is a meta record; broken lines
    are dropped, as in ``journal_records``. A null chunk is empty. Start inside ``timed_state``.
    """
    name = F.coalesce(F.concat(F.lit("i"), F.col("session_id").cast("string")), F.lit("n"))
    keyed = pieces.select(
        F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket"),
        name.alias("name"),
        F.coalesce("at", F.lit(0)).cast("bigint").alias("at"),
        F.coalesce("chunk", F.lit("")).alias("chunk"),
    )
    grown = keyed.groupBy("bucket").transformWithStateInPandas(Growth(), _OUT, "append", "None")
    numbered = F.transform(
        "lines", lambda x, i: F.struct((F.col("line_no") + i + 1).cast("int").alias("line_no"), x.alias("line"))
    )
    records = F.transform(
        F.filter(numbered, lambda s: ~is_blank(s["line"])),
        lambda s: F.struct(s["line_no"].alias("line_no"), record_of(s["line"]).alias("r")),
    )
    kept = let(records, lambda rs: F.filter(rs, lambda x: x["r"]["type"].isNotNull()))
    session = F.when(F.col("name") != "n", F.col("name").substr(F.lit(2), F.length("name")))
    return (
        grown.filter(record_of(F.col("head"))["type"] == "meta")
        .select(session.cast(pieces.schema["session_id"].dataType).alias("session_id"), F.explode(kept).alias("x"))
        .select("session_id", *record_columns("x"))
    )
