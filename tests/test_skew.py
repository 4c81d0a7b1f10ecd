import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import skew


@pytest.fixture
def rows(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.choice([None, 5, rng.randrange(-50, 10**9)]), "x") for _ in range(3000)]
    data += [(None, 1, "x"), ("", 2, "x"), ("only_null", None, "x")]
    return spark.createDataFrame(data, "domain string, v long, k string")


def test_quantiles_match_sorting(rows):
    got = {(r["domain"], r["prob"]): (r["n_rows"], r["value"]) for r in skew.keyed_quantiles(rows, "domain", F.col("v"), [0.0, 0.5, 0.9, 1.0]).collect()}
    local = {}
    for r in rows.collect():
        if r["domain"] is not None:
            local.setdefault(r["domain"], []).append(r["v"])
    want = {}
    for k, vs in local.items():
        known = sorted(v for v in vs if v is not None)
        for p in (0.0, 0.5, 0.9, 1.0):
            if known:
                want[k, p] = (len(vs), known[max(0, -(-int(p * 10 * len(known)) // 10) - 1)])
    assert got == want


def test_shuffled_restriction_gives_the_same(rows, monkeypatch):
    a = sorted(skew.keyed_quantiles(rows, "domain", F.col("v"), [0.5]).collect())
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert sorted(skew.keyed_quantiles(rows, "domain", F.col("v"), [0.5]).collect()) == a


def test_heavy_keys(rows, spark):
    n = rows.count()
    want = {(r["domain"], r["count"]) for r in rows.groupBy("domain").count().collect() if r["domain"] and r["count"] >= 0.02 * n}
    assert {tuple(r) for r in skew.heavy_keys(rows, "domain", 0.02).collect()} == want
    assert skew.heavy_keys(rows.limit(0), "domain", 0.02).count() == 0
    assert skew.keyed_quantiles(rows.limit(0), "domain", F.col("v"), [0.5]).count() == 0


def test_site_totals(spark):
    df = spark.createDataFrame([("a", "u", 1), ("a", "u", 3), ("a", None, 2), (None, "u", 9), ("", "u", 9)], "domain string, url string, crawled_at int")
    assert [tuple(r) for r in skew.site_totals(df).collect()] == [("a", 3, 1, 3)]


def test_split_join_keeps_hot_rows_in_place(spark, monkeypatch):
    rows = spark.createDataFrame([("hot", i) for i in range(600)] + [(f"k{i % 300}", i) for i in range(600)] + [(None, 1)], "k string, x long")
    table = rows.where("x % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m")).where("k is not null")
    want = sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    for small, hot in ((10**6, 1000), (0, 5), (0, 10**6)):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", small)
        monkeypatch.setattr(skew, "HOT_KEYS", hot)
        assert sorted(map(tuple, skew.split_join(rows, table, ["k"], "n").select("k", "x", "m").collect())) == want
        assert sorted(map(tuple, skew.split_join(rows, table, ["k"], "n", "left_semi").collect())) == sorted((k, x) for k, x, _ in want)
    assert skew.split_join(rows.limit(0), table, ["k"], "n").count() == skew.split_join(rows, table.limit(0), ["k"], "n").count() == 0


def test_places_and_tops_of_a_hot_key(spark, monkeypatch):
    """One key holds half of all rows: places and tops are those of plain sorting, whatever the number of tasks."""
    rng = random.Random(5)
    data = [("hot" if i % 2 else f"k{rng.randrange(9)}", rng.randrange(40), i) for i in range(700)] + [(None, 1, 700), (None, 0, 701)]
    rows = spark.createDataFrame(data, "k string, v int, i long")
    order = [F.col("v").desc(), F.col("i")]
    want = {}
    for k, v, i in sorted(data, key=lambda r: (r[0] or "", -r[1], r[2])):
        want.setdefault(k, []).append(i)
    places = {i: n for ids in want.values() for n, i in enumerate(ids, 1)}
    for parts in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r["i"]: r["place"] for r in skew.places_per_key(rows, "k", order).collect()} == places
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["i"]: r["nth"] for r in skew.top_per_key(rows, "k", order, 5).collect()} == {i: n for i, n in places.items() if n <= 5}
    assert skew.places_per_key(rows.limit(0), "k", order).count() == skew.top_per_key(rows.limit(0), "k", order, 5).count() == 0
