"""Labelled rows for training: deduplicated, without held-out rows, and bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import crc_mod

#: Labelled rows that a classifier is fitted on, at most (about: rows are picked by hash).
ROWS = 20_000


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 1 modulo 3; false for a null key."""
    return F.coalesce(crc_mod(key, 3) == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """(key, y) of at most about `rows` labelled keys that aren't held out; y is the mean where a key has several labels.

    Null keys and labels are dropped. Which keys stay depends on their hash alone.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("label_key")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    n = own.count()
    if n > rows:
        own = own.where(F.pmod(F.xxhash64("label_key"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return own
