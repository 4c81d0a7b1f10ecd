"""Find and restore records that were decoded with the wrong encoding, at the scale of a crawl.

``suspects`` keeps the titles and contents that hold a suspicious sequence, a small part of all. Their garbled
lines are joined with clean near-twins, drawn from all titles and content lines, on what is left of a line
without non-ASCII characters. The runs between are aligned character by character. Where a known transformation
explains the pair it is counted (``learn_transforms``); of the other pairs, the garbled sequences that stand for one
character nearly always, and hold a character that no clean twin has, become a mapping of their own (``learn_maps``).
Each garbled line meets one representative of its clean twins, so the join is linear in the number of lines whatever
the size of a group. ``find_garbled`` applies the learned mapping and the supported transformations to every
suspicious value, then all known ones to what is still suspicious, so that a value without twins is found too; ``restore`` also fills in lost characters from fitting twins.

So that the clean side of the join stays small, lines whose remainder no garbled line has are dropped where they
are read, by a bitmap of hashed remainders. It has eight bits or more for each garbled line, up to 2**28 (32 MB);
beyond that more lines pass through to the join, which changes no result.

NULL and empty values are never garbled. A garbled sequence quoted as an example in a sound text is no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import materialize
from .encodings import REPLACED, TRANSFORMS, Repairer, align, explain, garbled_spans, suspicious, untangle

#: A transformation goes before the others when this many distinct twin pairs support it.
MIN_SUPPORT = 2
#: A sequence of no known transformation is learned when so many lines show it, in such a share for one character.
MAP_SUPPORT, MAP_SHARE = 5, 0.9
#: Lines with fewer ASCII letters and digits left have no twins: too many different texts share the rest.
MIN_REST = 8
#: Least and largest power of two for the bits of the bitmap.
LEAST_BITS, MOST_BITS = 20, 28

_RUN = re.compile(r"[^\x00-\x7f]+")
_PLAIN = re.compile(r"[A-Za-z0-9]")


def _rest_hash(line: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(_RUN.sub("·", line)) >> 1


def suspects(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, value) of the titles and contents with a suspicious sequence."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, field, v) for field in ("content", "title") for i, v in zip(pdf["k"], pdf[field]) if v and suspicious(v)]
            yield pd.DataFrame(out, columns=["k", "field", "value"])

    # Keys pass through Python as text: a NULL among integers would turn the others into floats.
    rows = pages.select(F.col(key).cast("string").alias("k"), "content", "title").where("content <> '' or title <> ''")
    return rows.mapInPandas(run, "k string, field string, value string").select(F.col("k").cast(kind).alias(key), "field", "value")


def _odd_lines(values: DataFrame) -> DataFrame:
    """(h, r): distinct suspicious lines with the hash of their remainder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [x for v in pdf["value"] for x in v.split("\n") if suspicious(x) and len(_PLAIN.findall(x)) >= MIN_REST]
            yield pd.DataFrame({"h": [_rest_hash(x) for x in lines], "r": pd.Series(lines, dtype="object")})

    return values.mapInPandas(run, "h bigint, r string").distinct()


def _bitmap(odd: DataFrame) -> np.ndarray:
    """Bits set for the remainders of all garbled lines; at most 2**(MOST_BITS - 6) words reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * odd.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = odd.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), "int64")
    bitmap[words["w"].to_numpy("int64")] = words["m"].to_numpy("int64")
    return bitmap


def _clean_lines(pages: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(h, r) of the sound lines whose remainder the bitmap holds."""
    sent = pages.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = sent.value
        mask = 64 * len(bitmap) - 1
        for pdf in batches:
            hashes, lines = [], []
            for content, title in zip(pdf["content"], pdf["title"]):
                whole = f"{title or ''}\n{content or ''}"
                if not whole.isascii():
                    found = [x for x in whole.split("\n") if not x.isascii()]
                    lines += found
                    hashes += map(_rest_hash, found)
            h = np.array(hashes, "int64")
            hit = np.flatnonzero((bitmap[(h & mask) >> 6] >> (h & 63)) & 1)
            keep = [i for i in hit if not suspicious(lines[i]) and len(_PLAIN.findall(lines[i])) >= MIN_REST]
            yield pd.DataFrame({"h": h[keep], "r": pd.Series([lines[i] for i in keep], dtype="object")})

    return pages.select("content", "title").mapInPandas(run, "h bigint, r string")


def twins(pages: DataFrame, values: DataFrame) -> DataFrame:
    """(r, c): each garbled line with one clean line of the same remainder, the most frequent one."""
    odd = materialize(_odd_lines(values))
    clean = _clean_lines(pages, _bitmap(odd))
    # Counted by text first, then one per group, so that a huge group never meets in one place.
    best = clean.groupBy("h", "r").count().groupBy("h").agg(F.max_by("r", F.struct("count", "r")).alias("c"))
    return odd.join(best, "h").select("r", "c")


def learn_transforms(pairs: DataFrame) -> list[tuple[str, str]]:
    """Transformations supported by near-twins, the best first."""

    def support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": [k for g, c in zip(pdf["r"], pdf["c"]) for k in explain(g, c)]}, dtype="int32")

    votes = pairs.mapInPandas(support, "k int").groupBy("k").count().collect()
    ranked = sorted(((r["count"], -r["k"]) for r in votes if r["count"] >= MIN_SUPPORT), reverse=True)
    return [TRANSFORMS[-k] for _, k in ranked]


def learn_maps(pairs: DataFrame) -> dict[str, str]:
    """Garbled sequences, with the character that each stands for, from the pairs that no known transformation explains.

    Both collected tables are bounded by the characters and sequences in use, not by the number of records.
    """

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(x, y) for g, c in zip(pdf["r"], pdf["c"]) if not explain(g, c) for x, y in set(align(g, c))]
            yield pd.DataFrame(out, columns=["x", "y"])

    def characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": sorted({ch for c in pdf["c"] for ch in c if not ch.isascii()})}, dtype="object")

    votes = pairs.mapInPandas(aligned, "x string, y string").groupBy("x", "y").count()
    best = votes.groupBy("x").agg(F.max_by("y", F.struct("count", "y")).alias("y"), F.max("count").alias("n"), F.sum("count").alias("all"))
    best = best.where((F.col("n") >= MAP_SUPPORT) & (F.col("n") >= MAP_SHARE * F.col("all"))).collect()
    if not best:
        return {}
    clean = {r["y"] for r in pairs.mapInPandas(characters, "y string").distinct().collect()}
    return {r["x"]: r["y"] for r in best if not clean.issuperset(r["x"])}


def _repaired(values: DataFrame, transforms: list[tuple[str, str]], key: str, learned: dict[str, str] | None = None) -> DataFrame:
    """(key, field, fixed) of the garbled values; what was lost stays as replacement characters.

    ``learned`` and ``transforms`` go first; all known ones follow on what they leave.
    """
    kind = values.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, every = Repairer(transforms, learned), Repairer()
        for pdf in batches:
            out = [(i, field, untangle(first.fix(v)[0])) for i, field, v in zip(pdf["k"], pdf["field"], pdf["value"]) if garbled_spans(v, first) or garbled_spans(v, every)]
            yield pd.DataFrame(out, columns=["k", "field", "fixed"])

    out = values.select(F.col(key).cast("string").alias("k"), "field", "value").mapInPandas(run, "k string, field string, fixed string")
    return out.select(F.col("k").cast(kind).alias(key), "field", "fixed")


def find_garbled(pages: DataFrame, key: str = "page_id", transforms: list[tuple[str, str]] | None = None) -> DataFrame:
    """(page_id, field, restored): field is content or title; restored is NULL where characters were lost.

    The transformations that go first are learned from ``pages`` unless given.
    """
    values = materialize(suspects(pages, key))
    learned: dict[str, str] = {}
    if transforms is None:
        pairs = materialize(twins(pages, values))
        transforms, learned = learn_transforms(pairs), learn_maps(pairs)
    got = _repaired(values, transforms, key, learned)
    return got.select(key, "field", F.when(~F.col("fixed").contains(REPLACED), F.col("fixed")).alias("restored"))


def restore(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """As ``find_garbled``, but lines that lost characters are taken from their clean twins where one fits.

    A twin fits when it has a letter for each replacement character, place by place. ``restored`` stays NULL for
    values with a line that has no such twin.
    """
    values = materialize(suspects(pages, key))
    pairs = materialize(twins(pages, values))

    def fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, c in zip(pdf["r"], pdf["c"]):
                if REPLACED in r and len(r) == len(c) and all(x == y or (x == REPLACED and not y.isascii()) for x, y in zip(r, c)):
                    out.append((r, c))
            yield pd.DataFrame(out, columns=["line", "twin"])

    fits = pairs.mapInPandas(fitting, "line string, twin string").groupBy(F.xxhash64("line").alias("h")).agg(F.min("twin").alias("twin"))
    got = materialize(_repaired(values, learn_transforms(pairs), key, learn_maps(pairs)).withColumn("row", F.monotonically_increasing_id()))
    lossy = got.where(F.col("fixed").contains(REPLACED))
    lines = lossy.select("row", F.posexplode(F.split("fixed", "\n")).alias("at", "line")).withColumn("h", F.when(F.col("line").contains(REPLACED), F.xxhash64("line")))
    whole = lines.join(fits, "h", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("twin", "line").alias("x")))).alias("l"))
    mended = whole.select("row", F.array_join(F.transform("l", lambda z: z["x"]), "\n").alias("mended"))
    text = F.coalesce("mended", "fixed")
    return got.join(mended, "row", "left").select(key, "field", F.when(~text.contains(REPLACED), text).alias("restored"))
