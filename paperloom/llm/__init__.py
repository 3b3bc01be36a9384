"""Operators of a training-data pipeline, each with the query that applies it."""

from paperloom.llm import (  # noqa: F401
    archives,
    bpe,
    centroids,
    chat,
    collision,
    linededup,
    minhash,
    mixing,
    repeats,
    resample,
    rules,
    toxicity,
    wordpiece,
)
from paperloom.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
