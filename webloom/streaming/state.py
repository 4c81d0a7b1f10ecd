"""Stateful rules over keyed events, as small pure classes and as Structured Streaming operators.

A rule keeps a few numbers per key and looks at one event at a time: ``step(state, event) -> (state, output)``.
``run_rule`` runs a rule over a stream. Each micro-batch is joined by the states of its keys, sorted by (key, time, id)
within its partitions, which spills, and folded as it streams by; no key's events are gathered. So the outputs
depend on the order of the events alone, not on files or batch sizes. Events that arrive in a later micro-batch than
their successors are taken after these, as in any live system.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_folder


@dataclass(frozen=True)
class RequestWindow:
    """At most ``limit`` requests in a window that starts with the first request of a key."""

    limit: int = 120
    seconds: float = 60.0

    def step(self, state: list | None, t: float, value: float) -> tuple[list, float]:
        start, n = state or (t, 0)
        if t - start >= self.seconds:
            start, n = t, 0
        return [start, n + 1], float(n < self.limit)


@dataclass(frozen=True)
class Cooldown:
    """After a 429 a key rests; gives 1 for an event that may pass."""

    seconds: float = 30.0

    def step(self, state: list | None, t: float, value: float) -> tuple[list, float]:
        until = state[0] if state else float("-inf")
        ok = float(t >= until)
        return [t + self.seconds if value == 429 else until], ok


@dataclass(frozen=True)
class Backoff:
    """Seconds to wait after the n-th failure in a row: 2 * 2**n, 60 at most; a success starts anew."""

    most: float = 60.0

    def step(self, state: list | None, t: float, value: float) -> tuple[list, float]:
        n = state[0] if state else 0
        n = n + 1 if value in (429, 503) else 0
        return [n], min(self.most, 2.0 * 2 ** min(n, 5)) if n else 0.0


@dataclass(frozen=True)
class Polite:
    """Start times that keep a delay between requests and at most ``parallel`` of them within ``hold`` seconds."""

    delay: float = 1.0
    parallel: int = 4
    hold: float = 5.0

    def step(self, state: list | None, t: float, value: float) -> tuple[list, float]:
        last = list(state or [])
        start = max(t, last[-1] + self.delay) if last else t
        if len(last) >= self.parallel:
            start = max(start, last[-self.parallel] + self.hold)
        return (last + [start])[-self.parallel :], start


@dataclass(frozen=True)
class MovingAverage:
    """Mean duration of each interval, folded into a moving average that is cut to whole ms."""

    alpha: float = 0.3
    seconds: float = 30.0

    def step(self, state: list | None, t: float, value: float) -> tuple[list, float]:
        slot = t // self.seconds
        avg, at, total, n = state or (-1.0, slot, 0.0, 0)
        if slot > at and n:
            mean = total // n
            avg, at, total, n = mean if avg < 0 else float(int(self.alpha * mean + (1 - self.alpha) * avg)), slot, 0.0, 0
        total, n = total + value, n + 1
        now = total // n
        return [avg, at, total, n], now if avg < 0 else float(int(self.alpha * now + (1 - self.alpha) * avg))


RULES = {"window": RequestWindow, "cooldown": Cooldown, "backoff": Backoff, "polite": Polite, "average": MovingAverage}


def replay(rule, events: list[tuple[float, float]]) -> list[float]:
    """Outputs of a rule for the events of one key in order."""
    state, out = None, []
    for t, v in events:
        state, o = rule.step(state, t, v)
        out.append(o)
    return out


EVENTS = "k string, id string, t double, v double"
FOLDED = "k string, id string, t double, output double, kept string"


def fold(rule):
    """For ``mapInPandas`` over rows (k, id, t, v, kept) sorted by key, a key's state first: its outputs, then its new state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, last = None, None, 0.0
        for pdf in batches:
            out: list[tuple] = []
            for k, i, t, v, kept in zip(pdf["k"], pdf["id"], pdf["t"], pdf["v"], pdf["kept"]):
                if k != at:
                    if at is not None:
                        out.append((at, None, last, None, json.dumps(state)))
                    at, state = k, None
                if isinstance(kept, str):
                    state, last = json.loads(kept), t
                    continue
                state, o = rule.step(state, float(t), float(v))
                last = t
                out.append((k, i, t, o, None))
            yield pd.DataFrame(out, columns=["k", "id", "t", "output", "kept"])
        if at is not None:
            yield pd.DataFrame([(at, None, last, None, json.dumps(state))], columns=["k", "id", "t", "output", "kept"])

    return run


def run_rule(events: DataFrame, rule, key: str, time: str, value: str, ident: str, what: str, ttl_s: float = 30 * 86_400.0) -> DataFrame:
    """(k, id, t, output) of each event that a stream holds now. NULL keys are left out, NULL values count as 0.

    The states of all keys are one small table, written anew with each micro-batch; those of keys not heard of for
    ``ttl_s`` of event time are dropped. A batch that was written before is not written again.
    """
    spark = events.sparkSession
    folder = shared_folder(spark, what)
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(ident).cast("string").alias("id"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))

    def batch(df: DataFrame, number: int) -> None:
        if exists(spark, f"{folder}/all/batch={number}/_SUCCESS"):
            return
        events_ = df.withColumn("kept", F.lit(None).cast("string"))
        if number:
            old = spark.read.schema(FOLDED).parquet(f"{folder}/all/batch={number - 1}").where("kept is not null")
            old = old.where(F.col("t") >= old.agg((F.max("t") - ttl_s).alias("m")).first()["m"])
            events_ = events_.unionByName(old.select("k", "id", "t", F.lit(0.0).alias("v"), "kept"))
        ordered = events_.repartition("k").sortWithinPartitions("k", F.col("kept").isNull(), "t", "id")
        ordered.mapInPandas(fold(rule), FOLDED).write.mode("overwrite").parquet(f"{folder}/all/batch={number}")

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(FOLDED).parquet(f"{folder}/all") if exists(spark, f"{folder}/all") else spark.createDataFrame([], FOLDED)
    return done.where("kept is null").select("k", "id", "t", "output")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


# --- sources and sinks --------------------------------------------------------------------------------------


def stream(spark: SparkSession, root: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table of Parquet files as a stream of files."""
    path = f"{root}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    # A single file is reached through its folder.
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def drain(df: DataFrame, what: str) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote (append mode)."""
    spark = df.sparkSession
    out = shared_folder(spark, what)
    query = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


class VersionedTable:
    """A Parquet table that micro-batches upsert by key.

    Rows lie in buckets by the hash of their key. A batch rewrites the buckets that it touches under its number and
    then writes a manifest with the version of each bucket, at which moment it counts. Versions that no manifest
    but the last uses are deleted with the batch after. A batch that was written before is skipped, so that a restart
    replays nothing twice.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return max((int(n[1:]) for n in done if n.startswith("m") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))), default=-1)

    def _manifest(self) -> dict[int, tuple[int, int]]:
        """(version, former version) of each bucket that has rows."""
        v = self.version()
        rows = self.spark.read.parquet(f"{self.folder}/m{v}").collect() if v >= 0 else []
        return {r["bucket"]: (r["version"], r["former"]) for r in rows}

    def _read(self, versions: dict[int, tuple[int, int]]) -> DataFrame:
        paths = [f"{self.folder}/v{v}/bucket={b}" for b, (v, _) in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._manifest())

    def upsert(self, batch: DataFrame, number: int, merge) -> None:
        """``merge(old, batch) -> new``; to be called from ``foreachBatch``."""
        if number <= self.version():
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}
        now = self._manifest()
        fs, path = self._fs()
        for b, (_, former) in now.items():
            if former >= 0:
                fs.delete(path(f"{self.folder}/v{former}/bucket={b}"), True)
        new = merge(self._read({b: v for b, v in now.items() if b in touched}), batch).withColumn("bucket", bucket)
        new.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/v{number}")
        rows = [(b, number, now[b][0] if b in now else -1) for b in touched] + [(b, v, -1) for b, (v, _) in now.items() if b not in touched]
        self.spark.createDataFrame(rows, "bucket int, version int, former int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/m{number}")
