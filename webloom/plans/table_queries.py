"""Queries of the link graph and of the writing operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import storage as S
from ..sources import table

AS_OF = datetime(2024, 12, 1)
BLOCKED = [("gallebury-wiki.example",), ("norley-shop.example",)]


def _t(spark, root, name):
    return table(spark, root, name)


def a3_referring_domains(spark, root):
    return G.referring_domains(_t(spark, root, "links"), _t(spark, root, "pages"))


def a17_pagerank(spark, root):
    pages = _t(spark, root, "pages")
    return G.pagerank(G.edges(_t(spark, root, "links"), pages), G.nodes(pages)).select("node", F.round("rank", 6).alias("rank"))


def j3_edges(spark, root):
    return G.edges(_t(spark, root, "links"), _t(spark, root, "pages"))


def j5_backlinks(spark, root):
    """Newest backlinks of the most linked page."""
    pages, links = _t(spark, root, "pages"), _t(spark, root, "links")
    top = links.join(pages.select(F.col("url_hash").alias("target_hash"), "url").distinct(), "target_hash").groupBy("url").count().orderBy(F.col("count").desc(), "url").limit(1).first()
    return G.backlinks(links, pages, top["url"] if top else "").select("source_id", "url", "title", "created_at")


def j6_outlinks(spark, root):
    return G.outlinks(_t(spark, root, "links"), _t(spark, root, "pages"))


def a4_link_counts(spark, root):
    links = _t(spark, root, "links")
    out = links.groupBy("source_id").agg(F.count("*").alias("n"))
    return out.groupBy("n").agg(F.count("*").alias("sources"))


def snk1_upsert_pages(spark, root):
    cols = ["page_id", "url", "title", "status_code", "published_at", "crawled_at", "fetch_mode", "ingest_hits", "last_seen_at"]
    return S.upsert_pages(_t(spark, root, "pages").select(cols)).withColumn("status_code", F.coalesce("status_code", F.lit(0)))


def snk5_replace_links(spark, root):
    """All links written again: repeated pairs are stored once."""
    links = _t(spark, root, "links")
    return S.replace_links(links, links).select("source_id", "target_hash", "anchor_text", "created_at")


def snk8_upsert_domains(spark, root):
    log = _t(spark, root, "fetch_log").where("domain <> ''").groupBy("domain").agg(F.max("ts").alias("last_crawled"), F.countDistinct("fetch_id").alias("pages_count"), F.floor(F.avg("duration_ms")).cast("int").alias("avg_response_ms"))
    new = log.withColumn("robots_txt", F.lit("")).withColumn("pages_count", F.col("pages_count").cast("int"))
    return S.upsert_domains(_t(spark, root, "domains"), new)


def snk9_upsert_seeds(spark, root):
    new = _t(spark, root, "domains").select(F.concat(F.lit("https://"), "domain", F.lit("/archive/start0")).alias("url"), "domain", F.lit(7200).cast("long").alias("recrawl_interval_seconds"))
    return S.upsert_seeds(_t(spark, root, "seed_urls"), new)


def snk10_purge_old(spark, root):
    return _t(spark, root, "pages").where((F.col("crawled_at") >= F.lit(AS_OF).cast("timestamp_ntz")) | F.col("crawled_at").isNull()).select("page_id")


def snk11_purge_domains(spark, root):
    """What is left of pages, links and queue after a purge."""
    gone = spark.createDataFrame(BLOCKED, "blocked string")
    p, li, q = S.purge_domains(_t(spark, root, "pages"), _t(spark, root, "links"), _t(spark, root, "crawl_queue"), gone)
    rows = p.select(F.lit("pages").alias("what")).unionAll(li.select(F.lit("links"))).unionAll(q.select(F.lit("queue")))
    return rows.groupBy("what").agg(F.count("*").alias("n"))


def src1_known(spark, root):
    return _t(spark, root, "pages").select("url", "url_fingerprint")


def src3_lookup(spark, root):
    """A page by its url: the filter reaches the scan."""
    return _t(spark, root, "pages").where(F.col("url") == "https://lunmabrook-blog.test/p/15/das-laute-getriebe-ilmness-o").select("page_id", "url", "title")


def src8_ingest(spark, root):
    return S.ingest(_t(spark, root, "pages")).select("url", "domain", "region", "content_hash", "title")


def pr2_same_content(spark, root):
    """Contents found under several urls, by hash."""
    h = F.sha2(F.coalesce("content", F.lit("")), 256)
    return _t(spark, root, "pages").groupBy(h.alias("hash")).agg(F.countDistinct("url").alias("urls"), F.count("*").alias("pages")).where("urls > 1")


def so3_insert_or_ignore(spark, root):
    queue = _t(spark, root, "crawl_queue").select("url", "domain", "score")
    pages = _t(spark, root, "pages").select("url", "domain", F.lit(10.0).alias("score"))
    return S.insert_or_ignore(queue, pages, ["url"], [F.coalesce("domain", F.lit(""))])


def so2_difference(spark, root):
    return _t(spark, root, "crawl_queue").join(_t(spark, root, "pages").select("domain").distinct(), "domain", "left_anti").select("queue_id")


def a1_queue_states(spark, root):
    s = F.col("status")
    return _t(spark, root, "crawl_queue").agg(*[F.count_if(s == x).alias(x) for x in ("pending", "in_progress", "done", "failed")], F.count("*").alias("total"))


def a2_counts(spark, root):
    rows = None
    for name in ("pages", "domains", "seed_urls", "links", "crawl_queue"):
        one = _t(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def a16_ingest_summary(spark, root):
    from ..functions import urls as U

    ok = U.canonical(F.col("url")).isNotNull() & (F.coalesce("content", F.lit("")) != "")
    return _t(spark, root, "pages").agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"))


def j4_unseeded(spark, root):
    return _t(spark, root, "domains").join(_t(spark, root, "seed_urls").select("domain").distinct(), "domain", "left_anti").select("domain")


QUERIES = {f.__name__: f for f in (a3_referring_domains, a17_pagerank, j3_edges, j5_backlinks, j6_outlinks, a4_link_counts, snk1_upsert_pages, snk5_replace_links, snk8_upsert_domains, snk9_upsert_seeds, snk10_purge_old, snk11_purge_domains, src1_known, src3_lookup, src8_ingest, pr2_same_content, so3_insert_or_ignore, so2_difference, a1_queue_states, a2_counts, a16_ingest_summary, j4_unseeded)}

_GRAPH = """nodes AS (SELECT url_hash AS node, arg_max(struct_pack(d := domain, u := url), struct_pack(c := coalesce(crawled_at, TIMESTAMP '1970-01-01'), p := page_id)) AS r FROM pages GROUP BY url_hash),
    edges AS (SELECT DISTINCT p.url_hash AS src, target_hash AS dst FROM links JOIN pages p ON p.page_id = source_id WHERE p.url_hash <> target_hash AND target_hash IN (SELECT url_hash FROM pages))"""


def _rank_sql(rounds: int = 15) -> str:
    ctes = ["deg AS (SELECT src, count(*) AS k FROM edges GROUP BY src)", "n AS MATERIALIZED (SELECT node, k FROM nodes LEFT JOIN deg ON src = node)", "r0 AS (SELECT node, k, 1.0::DOUBLE AS r FROM n)"]
    for i in range(1, rounds + 1):
        ctes.append(f"r{i} AS MATERIALIZED (SELECT n.node, n.k, 0.15 + 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE k IS NULL) / (SELECT count(*) FROM n)) AS r FROM n LEFT JOIN (SELECT dst, sum(r / k) AS s FROM edges JOIN r{i - 1} ON node = src GROUP BY dst) g ON dst = n.node)")
    return f"WITH {_GRAPH}, {', '.join(ctes)} SELECT node, round(r, 6) AS rank FROM r{rounds}"


_BAD = "lower(domain) = 'gallebury-wiki.example' OR lower(domain) LIKE '%.gallebury-wiki.example' OR lower(domain) = 'norley-shop.example' OR lower(domain) LIKE '%.norley-shop.example'"
from .url_queries import _CANON, HOST  # noqa: E402

ORACLES = {
    "a3_referring_domains": f"""WITH {_GRAPH} SELECT n.node, CAST(coalesce(c, 0) AS BIGINT) AS referring FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT a.r.d) AS c FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.r.d <> b.r.d GROUP BY dst) x ON x.dst = n.node""",
    "a17_pagerank": _rank_sql(),
    "j3_edges": f"WITH {_GRAPH} SELECT src, dst FROM edges",
    "j5_backlinks": """WITH top AS (SELECT url, any_value(target_hash) AS h FROM links JOIN (SELECT DISTINCT url_hash, url FROM pages) p ON url_hash = target_hash GROUP BY url ORDER BY count(*) DESC, url LIMIT 1)
        SELECT source_id, p.url, p.title, l.created_at FROM links l JOIN top ON l.target_hash = top.h LEFT JOIN pages p ON p.page_id = source_id ORDER BY l.created_at DESC, source_id LIMIT 20""",
    "j6_outlinks": f"WITH {_GRAPH} SELECT source_id, coalesce(n.r.u, 'hash:' || target_hash) AS target, anchor_text, created_at FROM links LEFT JOIN nodes n ON n.node = target_hash",
    "a4_link_counts": "SELECT n, CAST(count(*) AS BIGINT) AS sources FROM (SELECT source_id, CAST(count(*) AS BIGINT) AS n FROM links GROUP BY source_id) GROUP BY n",
    "snk1_upsert_pages": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(crawled_at, TIMESTAMP '1970-01-01'), page_id) AS k, count(*) OVER (PARTITION BY url) AS n FROM pages)
        SELECT max(page_id) FILTER (k = n) AS page_id, url, max(title) FILTER (k = n) AS title, coalesce(max(status_code) FILTER (k = n), 0) AS status_code, arg_max(published_at, k) FILTER (published_at IS NOT NULL) AS published_at, max(crawled_at) FILTER (k = n) AS crawled_at,
        max(fetch_mode) FILTER (k = n) AS fetch_mode, CAST(max(ingest_hits) FILTER (k = 1) + coalesce(sum(ingest_hits) FILTER (k > 1 AND fetch_mode = 'extension'), 0) AS INTEGER) AS ingest_hits,
        coalesce(arg_max(last_seen_at, k) FILTER (fetch_mode = 'extension' AND last_seen_at IS NOT NULL), max(last_seen_at) FILTER (k = 1)) AS last_seen_at FROM o GROUP BY url""",
    "snk5_replace_links": "SELECT source_id, target_hash, anchor_text, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_hash ORDER BY created_at, anchor_text NULLS FIRST) AS k FROM links) WHERE k = 1",
    "snk8_upsert_domains": """WITH n AS (SELECT domain, max(ts) AS last_crawled, CAST(count(DISTINCT fetch_id) AS INTEGER) AS pages_count, CAST(floor(avg(duration_ms)) AS INTEGER) AS avg_response_ms FROM fetch_log WHERE domain <> '' GROUP BY domain)
        SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.robots_txt, '') AS robots_txt, coalesce(n.last_crawled, o.last_crawled) AS last_crawled, coalesce(n.pages_count, o.pages_count) AS pages_count, coalesce(n.avg_response_ms, o.avg_response_ms) AS avg_response_ms FROM domains o FULL JOIN n ON o.domain = n.domain""",
    "snk9_upsert_seeds": """WITH n AS (SELECT 'https://' || domain || '/archive/start0' AS url, domain, CAST(7200 AS BIGINT) AS i FROM domains)
        SELECT coalesce(o.url, n.url) AS url, coalesce(o.domain, n.domain) AS domain, coalesce(n.i, o.recrawl_interval_seconds) AS recrawl_interval_seconds, o.last_enqueued FROM seed_urls o FULL JOIN n ON o.url = n.url""",
    "snk10_purge_old": "SELECT page_id FROM pages WHERE crawled_at >= TIMESTAMP '2024-12-01' OR crawled_at IS NULL",
    "snk11_purge_domains": f"""WITH b AS (SELECT page_id, url_hash FROM pages WHERE {_BAD}) SELECT 'pages' AS what, CAST(count(*) AS BIGINT) AS n FROM pages WHERE page_id NOT IN (SELECT page_id FROM b)
        UNION ALL SELECT 'links', count(*) FROM links WHERE source_id NOT IN (SELECT page_id FROM b) AND target_hash NOT IN (SELECT url_hash FROM b) UNION ALL SELECT 'queue', count(*) FROM crawl_queue WHERE NOT coalesce({_BAD}, false)""",
    "src1_known": "SELECT url, url_fingerprint FROM pages",
    "src3_lookup": "SELECT page_id, url, title FROM pages WHERE url = 'https://lunmabrook-blog.test/p/15/das-laute-getriebe-ilmness-o'",
    "src8_ingest": f"""SELECT * FROM (SELECT {_CANON} AS url, regexp_replace({HOST}, '^www[.]', '') AS domain, '' AS region, sha256(coalesce(content, '')) AS content_hash, title FROM pages) WHERE url IS NOT NULL""",
    "pr2_same_content": "SELECT sha256(coalesce(content, '')) AS hash, CAST(count(DISTINCT url) AS BIGINT) AS urls, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "so3_insert_or_ignore": """SELECT url, domain, score FROM crawl_queue UNION ALL SELECT url, domain, 10.0 FROM (SELECT url, domain, row_number() OVER (PARTITION BY url ORDER BY coalesce(domain, '')) AS k FROM pages) WHERE k = 1 AND url NOT IN (SELECT url FROM crawl_queue)""",
    "so2_difference": "SELECT queue_id FROM crawl_queue q WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.domain = q.domain)",
    "a1_queue_states": "SELECT " + ", ".join(f"CAST(count(*) FILTER (status = '{x}') AS BIGINT) AS {x}" for x in ("pending", "in_progress", "done", "failed")) + ", CAST(count(*) AS BIGINT) AS total FROM crawl_queue",
    "a2_counts": " UNION ALL ".join(f"SELECT '{x}' AS what, CAST(count(*) AS BIGINT) AS n FROM {x}" for x in ("pages", "domains", "seed_urls", "links", "crawl_queue")),
    "a16_ingest_summary": "SELECT CAST(count(*) FILTER (regexp_matches(url, '^[hH][tT][tT][pP][sS]?://') AND coalesce(content, '') <> '') AS BIGINT) AS processed, CAST(count(*) FILTER (NOT (regexp_matches(url, '^[hH][tT][tT][pP][sS]?://') AND coalesce(content, '') <> '')) AS BIGINT) AS failed FROM pages",
    "j4_unseeded": "SELECT domain FROM domains WHERE domain NOT IN (SELECT domain FROM seed_urls)",
}
