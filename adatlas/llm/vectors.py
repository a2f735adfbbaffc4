"""Checked vectors: what the two embedding operators read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """(id, label, dim, v): v holds the components as little-endian doubles, or null where the vector takes no part.

    No part is taken by vectors that are null, empty, zero, or that hold a null or non-finite component. Rows with a
    null id are dropped, other columns ignored.
    """
    own = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten()  # the items of null lists are left out
            bad = np.asarray(flat.is_null())
            x = np.asarray(flat.fill_null(0.0), np.float64)
            ends = np.cumsum(lengths)
            wrong = np.concatenate(([0], np.cumsum(bad | ~np.isfinite(x))))
            solid = np.concatenate(([0], np.cumsum(x != 0)))
            good = (wrong[ends] == wrong[ends - lengths]) & (solid[ends] > solid[ends - lengths])
            v = [x[e - n : e].tobytes() if g else None for e, n, g in zip(ends.tolist(), lengths.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.array(v, pa.binary())], ["id", "label", "dim", "v"])

    return own.mapInArrow(parse, "id long, label string, dim int, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of checked vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
