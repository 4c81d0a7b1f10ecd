"""Queries on streams; each drains what is there and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import last_write_wins
from ..sources import shared_folder, table
from ..streaming import state as S


def _log(spark, root):
    return S.stream(spark, root, "fetch_log").withColumn("ts", F.col("ts").cast("timestamp"))


def _rule(spark, root, rule, value, what):
    out = S.run_rule(S.stream(spark, root, "fetch_log").where("domain <> ''"), rule, "domain", "ts", value, "fetch_id", what)
    return out.select(F.col("k").alias("domain"), F.col("id").cast("long").alias("fetch_id"), F.round("output", 3).alias("output"))


def st1_moving_average(spark, root):
    return _rule(spark, root, S.MovingAverage(), "duration_ms", "st1")


def st3_polite(spark, root):
    return _rule(spark, root, S.Polite(), "status", "st3")


def st4_cooldown(spark, root):
    return _rule(spark, root, S.Cooldown(), "status", "st4")


def st5_requests(spark, root):
    return _rule(spark, root, S.RequestWindow(10, 3600.0), "status", "st5")


def st6_backoff(spark, root):
    return _rule(spark, root, S.Backoff(), "status", "st6")


def st7_distinct(spark, root):
    """Deliveries of one fetch come once; those more than a month late would be dropped by the watermark."""
    rows = _log(spark, root).withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["fetch_id"])
    return S.drain(rows.select("fetch_id", "domain", "status"), "st7")


def st8_suppressed(spark, root):
    """Fetches of addresses that were not crawled since a date: a stream-static anti-join."""
    rows = S.stream(spark, root, "fetch_log").select("fetch_id", "url")
    fresh = table(spark, root, "pages").where("crawled_at >= timestamp_ntz'2024-12-01'").select("url").distinct()
    return S.drain(rows.join(fresh, "url", "left_anti"), "st8")


def st13_clicks(spark, root):
    return S.drain(S.stream(spark, root, "click_log"), "st13").groupBy("url").agg(F.count("*").alias("clicks"))


def st_hourly(spark, root):
    """Event-time windows with a watermark: fetches and errors of each hour."""
    rows = _log(spark, root).withWatermark("ts", "7 days").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))
    return S.drain(rows.select("w.start", "n", "errors"), "hourly")


def snk2_micro_batches(spark, root):
    """Latest fetch of each url, kept by a table that every micro-batch upserts."""
    rows = S.stream(spark, root, "fetch_log").select("url", "fetch_id", "status", "ts")
    folder = shared_folder(spark, "snk2")
    target = S.VersionedTable(spark, f"{folder}/table", rows.schema, ["url"])
    order = [F.col("ts"), F.col("fetch_id")]

    def write(batch, number):
        target.upsert(batch, number, lambda old, new: last_write_wins(old.unionByName(new), ["url"], order))

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return target.read()


QUERIES = {f.__name__: f for f in (st1_moving_average, st3_polite, st4_cooldown, st5_requests, st6_backoff, st7_distinct, st8_suppressed, st13_clicks, st_hourly, snk2_micro_batches)}

_E = """e AS MATERIALIZED (SELECT domain, fetch_id, epoch_us(ts) / 1e6 AS t, coalesce(CAST({v} AS DOUBLE), 0) AS v, row_number() OVER (PARTITION BY domain ORDER BY ts, CAST(fetch_id AS VARCHAR)) AS rn FROM fetch_log WHERE domain <> '')"""
_NEXT = "FROM r JOIN e ON e.domain = r.domain AND e.rn = r.rn + 1"

ORACLES = {
    "st1_moving_average": f"""WITH RECURSIVE {_E.format(v="duration_ms")}, r AS (SELECT domain, rn, fetch_id, -1.0::DOUBLE AS avg, floor(t / 30) AS slot, v AS total, 1::BIGINT AS n, floor(v)::DOUBLE AS output FROM e WHERE rn = 1
        UNION ALL SELECT domain, rn, fetch_id, a, CASE WHEN turn THEN here ELSE slot END, tot, k, CASE WHEN a < 0 THEN floor(tot / k) ELSE floor(0.3 * floor(tot / k) + 0.7 * a) END FROM
        (SELECT e.domain, e.rn, e.fetch_id, floor(e.t / 30) AS here, r.slot, floor(e.t / 30) > r.slot AS turn, CASE WHEN floor(e.t / 30) > r.slot THEN CASE WHEN r.avg < 0 THEN floor(r.total / r.n) ELSE floor(0.3 * floor(r.total / r.n) + (1 - 0.3) * r.avg) END ELSE r.avg END AS a,
        CASE WHEN floor(e.t / 30) > r.slot THEN e.v ELSE r.total + e.v END AS tot, CASE WHEN floor(e.t / 30) > r.slot THEN 1 ELSE r.n + 1 END AS k {_NEXT})) SELECT domain, fetch_id, round(output, 3) AS output FROM r""",
    "st3_polite": f"""WITH RECURSIVE {_E.format(v="status")}, r AS (SELECT domain, rn, fetch_id, [t] AS last, t AS output FROM e WHERE rn = 1
        UNION ALL SELECT domain, rn, fetch_id, list_append(last, s)[-4:], s FROM (SELECT e.domain, e.rn, e.fetch_id, r.last, greatest(e.t, r.last[-1] + 1.0, CASE WHEN len(r.last) >= 4 THEN r.last[-4] + 5.0 ELSE e.t END) AS s {_NEXT})) SELECT domain, fetch_id, round(output, 3) AS output FROM r""",
    "st4_cooldown": f"""WITH {_E.format(v="status")}, w AS (SELECT *, last_value(CASE WHEN v = 429 THEN t END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM e)
        SELECT domain, fetch_id, CASE WHEN hit IS NULL OR t >= hit + 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS output FROM w""",
    "st5_requests": f"""WITH RECURSIVE {_E.format(v="status")}, r AS (SELECT domain, rn, fetch_id, t AS start, 1 AS n, 1.0::DOUBLE AS output FROM e WHERE rn = 1
        UNION ALL SELECT e.domain, e.rn, e.fetch_id, CASE WHEN e.t - r.start >= 3600 THEN e.t ELSE r.start END, CASE WHEN e.t - r.start >= 3600 THEN 1 ELSE r.n + 1 END, CASE WHEN e.t - r.start >= 3600 OR r.n < 10 THEN 1.0 ELSE 0.0 END {_NEXT}) SELECT domain, fetch_id, output FROM r""",
    "st6_backoff": f"""WITH {_E.format(v="status")}, g AS (SELECT *, v IN (429, 503) AS bad, sum(CASE WHEN v IN (429, 503) THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY rn) AS grp FROM e), k AS (SELECT *, sum(CAST(bad AS INTEGER)) OVER (PARTITION BY domain, grp ORDER BY rn) AS n FROM g)
        SELECT domain, fetch_id, CASE WHEN bad THEN least(60.0, 2.0 * 2 ** least(n, 5)) ELSE 0.0 END::DOUBLE AS output FROM k""",
    "st_hourly": "SELECT date_trunc('hour', ts) AS start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status >= 500) AS BIGINT) AS errors FROM fetch_log GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM fetch_log) - INTERVAL 7 DAY",
    "st7_distinct": "SELECT DISTINCT fetch_id, domain, status FROM fetch_log",
    "st8_suppressed": "SELECT fetch_id, url FROM fetch_log WHERE url NOT IN (SELECT url FROM pages WHERE crawled_at >= TIMESTAMP '2024-12-01')",
    "st13_clicks": "SELECT url, CAST(count(*) AS BIGINT) AS clicks FROM click_log GROUP BY url",
    "snk2_micro_batches": "SELECT url, fetch_id, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, fetch_id DESC) AS k FROM fetch_log) WHERE k = 1",
}
