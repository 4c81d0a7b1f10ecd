import json
import os
from datetime import datetime

import pytest

import __spark_entry__
from webloom.api import Engine
from webloom.config import Settings, load, seed_table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"workers": 7, "seeds": [{"url": "https://a.example/"}]}))
    seeds = tmp_path / "seeds"
    seeds.mkdir()
    (seeds / "b.json").write_text(json.dumps([{"url": "https://www.b.example/x", "recrawl_interval_seconds": 60}]))
    s = load(str(p), str(seeds))
    assert s.workers == 7 and [x["url"] for x in s.seeds] == ["https://a.example/", "https://www.b.example/x"]
    with pytest.raises(ValueError):
        Settings(workers=0)
    p.write_text("{\"nonsense\": 1}")
    with pytest.raises(ValueError):
        load(str(p))
    assert Settings(language="", language_boost=-1).language_boost == 3000.0


def test_seed_table(spark):
    s = Settings(seeds=[{"url": "https://www.b.example/x", "recrawl_interval_seconds": 60}, {"url": "https://a.example/"}])
    assert [tuple(r) for r in seed_table(spark, s).orderBy("url").collect()] == [("https://a.example/", "a.example", 86_400), ("https://www.b.example/x", "b.example", 60)]


@needs_data
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score"] and df.count() > 0


@needs_data
def test_engine(spark):
    e = Engine(spark, DATA)
    first = e.page_by_id(1).first()
    assert e.page_by_url(first["url"]).count() >= 1 and e.page_by_fingerprint(first["url_fingerprint"]).count() == 1
    assert 0 < e.search("river museum", datetime(2025, 1, 1), limit=5).count() <= 5
    assert e.outlinks(1).count() >= 1 and e.health().first()["status"] == "ok"
    assert e.crawl(["HTTPS://n.example/a#x", first["url"], "mailto:x"], datetime(1990, 1, 1), force=True).count() == 2
    assert e.page_size(None) == 10 and e.page_size(1000) == 100 and e.page_size(-1) == 10
    with pytest.raises(ValueError):
        e.crawl(["u"] * 1001, datetime(2024, 1, 1))
    assert e.add_seed("https://new.example/").count() == e.seeds().count() + 1


@needs_data
def test_streams_repeat_what_batches_say(spark):
    from webloom.plans import stream_queries as q
    from webloom.streaming import state

    got = q.st4_cooldown(spark, DATA).collect()
    log = spark.read.parquet(f"{DATA}/fetch_log.parquet").where("domain <> ''").select("domain", "fetch_id", "status", "ts").collect()
    assert len(got) == len(log)
    by = {}
    for r in sorted(log, key=lambda r: (r["ts"], str(r["fetch_id"]))):
        by.setdefault(r["domain"], []).append(r)
    want = {}
    for d, rows in by.items():
        for r, o in zip(rows, state.replay(state.Cooldown(), [(r["ts"].timestamp(), float(r["status"] or 0)) for r in rows])):
            want.setdefault((d, str(r["fetch_id"])), []).append(o)
    have = {}
    for r in got:
        have.setdefault((r["domain"], str(r["fetch_id"])), []).append(r["output"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_rules_depend_on_the_order_of_events_only(spark, tmp_path):
    """A key with half of all events, several micro-batches, tiny Arrow batches: the same as one ordered replay."""
    import random

    from pyspark.sql import functions as F

    from webloom.streaming import state

    rng = random.Random(3)
    events = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, 1_700_000_000 + i * 3, float(rng.choice([200, 429, 503]))) for i in range(400)]
    for n in range(2):
        part = events[n * 200 : n * 200 + 200]
        rng.shuffle(part)
        spark.createDataFrame(part, "k string, id long, s long, v double").select("k", "id", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for rule in (state.Backoff(), state.RequestWindow(3, 60.0), state.Polite(5.0, 2, 20.0), state.MovingAverage()):
            got = state.run_rule(state.stream(spark, str(tmp_path), "e", 1), rule, "k", "ts", "v", "id", "rule")
            have = {(r["k"], int(r["id"])): r["output"] for r in got.collect()}
            want = {}
            for k in {e[0] for e in events}:
                mine = [e for e in events if e[0] == k]
                want |= {(k, e[1]): o for e, o in zip(mine, state.replay(rule, [(float(e[2]), e[3]) for e in mine]))}
            assert have == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    import os

    from webloom.streaming import state

    t = state.VersionedTable(spark, f"{tmp_path}/t", "k string, v int", ["k"], 8)
    merge = lambda old, new: new.unionByName(old.join(new, "k", "left_anti"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    t.upsert(frame([(f"k{i}", 0) for i in range(40)]), 0, merge)
    t.upsert(frame([("k1", 5)]), 1, merge)
    t.upsert(frame([("k1", 9)]), 1, merge)  # a replayed batch changes nothing
    assert {r["k"]: r["v"] for r in t.read().collect()} == {f"k{i}": 5 if i == 1 else 0 for i in range(40)}
    assert len([d for d in os.listdir(f"{tmp_path}/t/v1") if d.startswith("bucket")]) == 1
    t.upsert(frame([("new", 1), (None, 2)]), 2, merge)
    assert t.read().count() == 42 and len([d for d in os.listdir(f"{tmp_path}/t/v0") if d.startswith("bucket")]) == 7
    assert state.VersionedTable(spark, f"{tmp_path}/none", "k string, v int", ["k"]).read().count() == 0


def test_life_cycle(spark, tmp_path):
    from webloom.streaming import state

    spark.range(10).write.parquet(f"{tmp_path}/n.parquet")
    engine = Engine(spark, str(tmp_path))
    assert engine.status()["status"] == "idle"
    with pytest.raises(RuntimeError):
        engine.stop()
    sink = lambda: state.stream(spark, str(tmp_path), "n").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").start()
    assert engine.start(sink)["status"] == "running"
    with pytest.raises(RuntimeError):
        engine.start(sink)
    engine.streams[0].processAllAvailable()
    assert engine.stop()["status"] in ("stopping", "idle")
    engine.streams[0].awaitTermination(30)
    assert engine.status() == {"status": "idle", "rows": 10, "failed": 0}


def test_schema_versions_and_resources(spark):
    from webloom.operators import storage

    df = spark.createDataFrame([(1, "x")], "id long, region string")
    steps = [(2, "region", "string"), (1, "title", "string"), (3, "rank", "double")]
    new, version = storage.migrated(df, 0, steps)
    assert (new.columns, version) == (["id", "region", "title", "rank"], 3) and new.first()["region"] == "x"
    assert storage.migrated(new, version, steps)[0].columns == new.columns and storage.migrated(df, 2, steps)[0].columns == ["id", "region", "rank"]
    log = spark.createDataFrame([("https://a.example/s.css", "TEXT/CSS; x", 200, 1, 1), ("https://a.example/s.css", "text/css", 404, 2, 2), ("https://a.example/", "text/html", 200, 1, 3), (None, "text/css", 200, 1, 4), ("https://a.example/x", None, 200, 1, 5)], "url string, content_type string, status int, ts int, fetch_id int")
    got = storage.discovered_resources(log).collect()
    assert [(r["url"], r["kind"], r["status"]) for r in got] == [("https://a.example/s.css", "css", 404)]
    assert storage.discovered_resources(log.limit(0)).count() == 0
