"""Queries on sites that hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skew
from ..sources import table


def p7_found(spark, root):
    return skew.heavy_keys(table(spark, root, "pages"), "domain", 0.02).select("domain")


def p7_totals(spark, root):
    return skew.site_totals(table(spark, root, "pages"))


def p7_quantiles(spark, root):
    """Median and 90th percentile of the fetch duration of each site, exact."""
    log = table(spark, root, "fetch_log").where(F.col("domain") != "")
    got = skew.keyed_quantiles(log, "domain", F.col("duration_ms"), [0.5, 0.9])
    return got.select("domain", "n_rows", (F.col("prob") * 100).cast("int").alias("pct"), F.col("value").alias("duration_ms"))


QUERIES = {"p7_found": p7_found, "p7_totals": p7_totals, "p7_quantiles": p7_quantiles}

ORACLES = {
    "p7_found": "SELECT domain FROM pages WHERE domain <> '' GROUP BY domain HAVING count(*) >= 0.02 * (SELECT count(*) FROM pages)",
    "p7_totals": """SELECT domain, CAST(count(*) AS BIGINT) AS n_pages, CAST(count(DISTINCT url) AS BIGINT) AS n_urls, max(crawled_at) AS latest_crawl
        FROM pages WHERE domain IS NOT NULL AND domain <> '' GROUP BY domain""",
    "p7_quantiles": """WITH c AS (SELECT domain, CAST(count(*) AS BIGINT) AS n_rows FROM fetch_log WHERE domain <> '' GROUP BY domain),
        r AS (SELECT domain, duration_ms, row_number() OVER (PARTITION BY domain ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY domain) AS n
              FROM fetch_log WHERE domain <> '' AND duration_ms IS NOT NULL),
        w AS (SELECT * FROM (VALUES (50, 0.5::DOUBLE), (90, 0.9::DOUBLE)) t(pct, p))
        SELECT r.domain, c.n_rows, w.pct, r.duration_ms FROM r JOIN c USING (domain) CROSS JOIN w WHERE r.rn = greatest(1, ceil(w.p * r.n))""",
}
