"""Bounded samples on which models are fitted (everything else in this package covers all rows), and Arrow lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Longest text that may serve for training; together with the number of rows it bounds what the driver takes.
TRAIN_CHARS = 20_000


def sample(df: DataFrame, key: str, rows: int, *columns: str, text: str | None = None) -> list[Row]:
    """``columns`` of at most 2 * rows rows, chosen by the hash of their key.

    Rows with an empty or over-long ``text`` (by default the last string column) are passed over.
    """
    strings = [c for c in columns if df.schema[c].dataType.simpleString() == "string"]
    parts = max(1, -(-df.count() // rows))
    picked = df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == 0)
    if strings:
        picked = picked.where(F.length(text or strings[-1]).between(1, TRAIN_CHARS))
    return picked.select(*columns).limit(2 * rows).collect()


def lists(counts: Sequence[int], values: pa.Array) -> pa.ListArray:
    """Column of lists of these lengths over all their values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), "int32"), values)
