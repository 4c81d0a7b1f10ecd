"""Per-key results that stay balanced when a few keys hold most rows.

Operators:

* ``keyed_quantiles`` - exact per-key order statistics by distributed selection. Every round counts rows in
  value buckets (a mergeable histogram, combined on the map side), finds the bucket that holds each wanted
  rank, and refines only that bucket. Values of a key are never gathered or sorted, so a key with a third of
  all rows costs no more per task than any other.
* ``split_join`` - a join on a key of which a few values hold most rows.
* ``top_per_key`` - the first n rows of each key.
* ``places_per_key`` - the place of every row within its key.
* ``site_totals`` - counts, distinct urls and latest time per key, aggregated first by (key, url).

Nulls: rows with a NULL key are ignored; NULL values are not ranked but are counted in ``n_rows``.
Ties and repeated rows count as often as they stand. An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import materialize

#: Bits resolved per round; a round's histogram has at most 2**BITS buckets for each open (key, rank).
BITS = 12
#: Tables of short rows (keys and numbers) are broadcast up to this many rows, about 10 MB.
BROADCAST_ROWS = 200_000


#: Keys that hold at least one in so many rows are hot; there can be no more of them than this.
HOT_KEYS = 1000


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``table``, which has one short row for each key.

    ``weight`` is a column of ``table``, left out of the result: how many of ``rows`` have the key, or a number in
    proportion to it. A small table is broadcast. Else the keys that hold at least one ``HOT_KEYS``-th of all
    weight, by arithmetic at most that many, are broadcast, so their rows stay where they are; only the others
    are shuffled, and none of those is hot.
    """
    n, total = table.agg(F.count("*"), F.sum(weight)).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), keys, how)
    is_hot = F.col(weight) * HOT_KEYS >= total
    hot = F.broadcast(table.where(is_hot).drop(weight))
    far = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~is_hot).drop(weight), keys, how)
    return rows.join(hot, keys, how).unionByName(far)


def _restrict(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows (k, v, p, c) that lie in an open bucket (k, p)."""
    buckets = open_.select("k", "p").distinct()
    if open_.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(buckets), ["k", "p"], "left_semi")
    weights = rows.groupBy("k", "p").agg(F.sum("c").alias("w"))
    return split_join(rows, materialize(buckets.join(weights, ["k", "p"])), ["k", "p"], "w", "left_semi")


def keyed_ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value at each wanted rank. ``rows(k, v long, c)``, ``wanted(k, q, rank)`` with ranks from 0; gives (k, q, v).

    c is how often v stands for k; a value may be spread over several rows.

    v must not be NULL and must lie in 0 .. 2**62.
    """
    top = rows.agg(F.max("v").alias("m")).first()["m"]
    if top is None:
        return wanted.select("k", "q", F.lit(0).cast("long").alias("v")).limit(0)
    bits = max(1, int(top).bit_length())
    shift = max(0, bits - BITS)
    open_ = wanted.select("k", "q", F.lit(0).cast("long").alias("p"), F.col("rank").cast("long").alias("rank"))
    first = True
    while True:
        width = (bits if first else shift_before) - shift
        part = rows
        if not first:
            part = _restrict(rows.withColumn("p", F.expr(f"shiftright(v, {shift_before})")), open_)
        hist = part.groupBy("k", F.expr(f"shiftright(v, {shift})").alias("b")).agg(F.sum("c").alias("c"))
        hist = hist.withColumn("p", F.expr(f"shiftright(b, {width})"))
        # Buckets of one (k, p) are at most 2**BITS, so the running sum below is over a bounded list.
        lists = hist.groupBy("k", "p").agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("h"))
        found = open_.join(lists, ["k", "p"]).withColumn(
            "at",
            F.aggregate(
                "h",
                F.struct(F.lit(-1).cast("long").alias("b"), F.col("rank").alias("left"), F.lit(False).alias("done")),
                lambda a, x: F.when(a["done"], a)
                .when(a["left"] < x["c"], F.struct(x["b"].alias("b"), a["left"].alias("left"), F.lit(True).alias("done")))
                .otherwise(F.struct(a["b"].alias("b"), (a["left"] - x["c"]).alias("left"), F.lit(False).alias("done"))),
            ),
        )
        open_ = materialize(found.select("k", "q", F.col("at.b").alias("p"), F.col("at.left").alias("rank")))
        if shift == 0:
            return open_.select("k", "q", F.col("p").alias("v"))
        shift_before, shift, first = shift, max(0, shift - BITS), False


#: Parts into which the rows of each key are dealt before the first n of the key are chosen.
SALTS = 64


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in ``order`` (total), with their place ``nth``.

    Each key is dealt into ``SALTS`` parts, of which n rows each are kept; so no task sees more than a part of a hot
    key, nor then more than SALTS * n rows.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    part = rows.withColumn("_salt", salt)
    first = part.withColumn("nth", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("nth") <= n).drop("_salt", "nth")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def places_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` within their key in ``order``, counted from 1.

    The rows are range-partitioned by key and order, so a hot key covers many tasks. Each task numbers its rows of a
    key as they pass; the numbers of the tasks before are added from one small row for each task and key in it.
    """
    by = [F.col(key), *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    columns = [c for c in rows.columns]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, first = None, 0, True
        for b in batches:
            places = []
            for k in b.column(key).to_pylist():
                at, n, first = k, 1 if first or k != at else n + 1, False
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, "int64")], names=[*columns, "_n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = materialize(ordered.mapInArrow(number, f"{kinds}, _n bigint").withColumn("_task", F.spark_partition_id()))
    counts = numbered.groupBy(F.col(key).alias("_k"), "_task").agg(F.max("_n").alias("_c"))
    # A key that lies in one task needs nothing added; only those that cross a border are joined.
    ahead = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_k").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_before") > 0)
    # At most one such row for each border between tasks.
    out = numbered.join(F.broadcast(ahead.select("_k", F.col("_task").alias("_t"), "_before")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_task") == F.col("_t")), "left")
    return out.select(*columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("int").alias("place"))


def keyed_quantiles(df: DataFrame, key: str, value: Column, probs: Sequence[float]) -> DataFrame:
    """Exact lower quantiles per key: (key, n_rows, prob, value) with the value at rank ceil(p * n) - 1.

    ``value`` is a long column between -2**61 and 2**61.
    """
    base = 1 << 61
    rows = df.select(F.col(key).alias("k"), value.cast("long").alias("v0")).where(F.col("k").isNotNull())
    counts = materialize(rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.count("v0").alias("n"), F.min("v0").alias("lo")))
    low = counts.agg(F.min("lo").alias("lo")).first()["lo"]
    low = -base if low is None else low
    shifted = rows.where(F.col("v0").isNotNull()).select("k", (F.col("v0") - F.lit(low)).alias("v"))
    wanted = counts.where("n > 0").select("k", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    wanted = wanted.select("k", "q", F.greatest(F.lit(0), F.ceil(F.col("q") * F.col("n")) - 1).alias("rank"))
    # Equal values are counted first, so that a popular value of a hot key is one row in all rounds.
    got = keyed_ranks(materialize(shifted.groupBy("k", "v").agg(F.count("*").alias("c"))), wanted)
    return counts.join(got, "k").select(F.col("k").alias(key), "n_rows", F.col("q").alias("prob"), (F.col("v") + F.lit(low)).alias("value"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: (key, n_rows). NULL and '' are no keys but count as rows.

    By exact selection: ordered by the hash of the key, a key with a share of s covers every rank stretch of
    s * n rows, so the hashes at ranks spaced half that far contain each such key. The selected hashes, at most
    2 / share of them, are then counted exactly.
    """
    rows = df.select(F.col(key).alias("key0"), F.expr(f"shiftright(xxhash64(`{key}`), 2) & {(1 << 61) - 1}").alias("v"), F.lit(0).alias("k"))
    n = rows.count()
    step = max(1, int(n * share / 2))
    ranks = list(range(0, n, step))
    spark = df.sparkSession
    wanted = spark.range(len(ranks)).select(F.lit(0).alias("k"), F.col("id").alias("q"), (F.col("id") * step).alias("rank"))
    hot = keyed_ranks(rows.select("k", "v", F.lit(1).alias("c")), wanted).select("v").distinct() if n else rows.select("v").limit(0)
    counted = rows.join(F.broadcast(hot), "v", "left_semi").groupBy("key0").agg(F.count("*").alias("n_rows"))
    return counted.where((F.col("n_rows") >= share * n) & (F.col("key0") != "")).select(F.col("key0").alias(key), "n_rows")


def site_totals(df: DataFrame, key: str = "domain", url: str = "url", at: str = "crawled_at") -> DataFrame:
    """Rows, distinct urls and latest time per key, in two steps: by (key, url), then by key.

    The first step spreads a hot key over all tasks; the second sees one partial row per task and key.
    NULL and '' keys are left out; NULL urls count as rows but not as urls.
    """
    part = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key, url).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return part.groupBy(key).agg(F.sum("n").cast("long").alias("n_pages"), F.count(url).alias("n_urls"), F.max("last").alias("latest_crawl"))
