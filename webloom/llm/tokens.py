"""Encoding of texts by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each distinct piece is merged once per worker and kept in a
bounded cache. Merging uses a rank queue: for every merge rank a bucket of positions in a linked list of
parts, and above the buckets three levels of bitmaps, so that the lowest open rank is found by three
find-first-set steps whatever the length of the piece. Entries that an earlier merge made stale are skipped
when their bucket is opened. The work for a piece of n bytes is O(n log n) at most, so one unbroken string of
megabytes costs no more per byte than ordinary text.

NULL and empty texts give an empty list; blank text is encoded as it stands. Special tokens are not
recognised: their strings are ordinary text. Ids are those of the vocabulary file.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept by one worker; when full, the cache starts anew.
CACHE_PIECES = 400_000
#: Longer pieces are merged but not kept.
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary in the tiktoken form: a base64 string and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap of 64-bit words (2**18 ranks)."""

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self) -> None:
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | (1 << (rank & 63))
        self.mid[b] = self.mid.get(b, 0) | (1 << (a & 63))
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """Lowest rank with its positions from left to right; (-1, []) when empty."""
        top = self.top
        if not top:
            return -1, []
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        rank = (a << 6) | ((word & -word).bit_length() - 1)
        word &= word - 1
        self.low[a] = word
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the pair of lowest rank, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 when it was swallowed
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the part that starts here with the next one
    queue, get = RankQueue(), ranks.get
    push = queue.push
    for i in range(n - 1):
        r = get(piece[i : i + 2], -1)
        if r >= 0:
            pair[i] = r
            push(r, i)
    while True:
        rank, places = queue.pop()
        if rank < 0:
            break
        for i in places:
            if not end[i] or pair[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[j]
            end[i], end[j], pair[j] = stop, 0, -1
            if stop < n:
                before[stop] = i
                r = get(piece[i : end[stop]], -1)
                pair[i] = r
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = get(piece[h:stop], -1)
                pair[h] = r
                if r >= 0:
                    push(r, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    import regex

    split = regex.compile(pattern).findall
    cache: dict[str, tuple[int, ...]] = {}

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        extend, get = ids.extend, cache.get
        for piece in split(text):
            known = get(piece)
            if known is None:
                raw = piece.encode("utf-8", "surrogatepass")
                known = tuple(merge_piece(raw, ranks))
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = known
            extend(known)
        return ids

    return encode


#: The encoder of this worker; pieces merged in one task serve the next.
_ENCODER: list = [None, None]


def _encoder(name: str, ranks, pattern: str) -> Callable[[str | None], list[int]]:
    """Built once a worker and vocabulary."""
    if _ENCODER[0] != name:
        _ENCODER[:] = name, encoder(ranks.value, pattern)
    return _ENCODER[1]


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id, ids array<int>) of every row.

    The vocabulary is read once on the driver and sent to each executor once, so its path need not exist there.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    ranks, name = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary)), uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = _encoder(name, ranks, pattern)
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "ids": pd.Series([np.array(encode(t), "int32") for t in pdf["t"]], index=pdf.index, dtype="object")})

    # Keys pass through Python as text: a NULL among integers would turn the others into floats.
    out = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "i string, ids array<int>")
    return out.select(F.col("i").cast(id_type).alias(id_col), "ids")
