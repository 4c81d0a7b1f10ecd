"""Queries of the frontier, the queue, the domain statistics, the interest profile and spelling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier as R
from ..operators import profile as P
from ..operators import search as S
from ..operators import spell
from ..sources import table
from .search_queries import INDEX, index_of, plain_sql
from .url_queries import _CANON, HOST

AS_OF = datetime(2024, 12, 1)


def _t(spark, root, name):
    return table(spark, root, name)


def a8_click_counts(spark, root):
    return P.click_counts(_t(spark, root, "click_log"))


def a9_interest(spark, root):
    clicks = _t(spark, root, "click_log")
    return P.interest_terms(clicks.select("query"), clicks, click_weight=2.0)


def a10_reputation(spark, root):
    return P.reputations(_t(spark, root, "click_log"))


def a11_domain_stats(spark, root):
    return R.domain_stats(_t(spark, root, "fetch_log"))


def a11_flushes(spark, root):
    return R.flushes(_t(spark, root, "fetch_log")).select("domain", "flush", "pages", "avg_ms")


def a12_pending(spark, root):
    return _t(spark, root, "crawl_queue").where("status = 'pending'").groupBy("domain").agg(F.count("*").alias("n"))


def a13_snapshot(spark, root):
    q = _t(spark, root, "crawl_queue")
    return q.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.countDistinct(F.when(F.col("status") == "pending", F.col("domain"))).alias("domains"), F.count("*").alias("enqueued"))


def a14_shapes(spark, root):
    return _t(spark, root, "pages").groupBy("url_fingerprint").agg(F.count("*").alias("n"))


def w4_domain_order(spark, root):
    return R.fair_order(_t(spark, root, "crawl_queue"))


def w5_round_robin(spark, root):
    return R.take_round_robin(_t(spark, root, "crawl_queue"), 50).select("queue_id", "place")


def t4_dequeue(spark, root):
    return R.dequeue(_t(spark, root, "crawl_queue"), 25, AS_OF).select("queue_id", "status", "locked_at")


def t5_dequeue_without(spark, root):
    return R.dequeue(_t(spark, root, "crawl_queue"), 25, AS_OF, ["norwick.example"]).select("queue_id", "status")


def t6_stale_pages(spark, root):
    return _t(spark, root, "pages").where(F.col("crawled_at") < F.lit(AS_OF).cast("timestamp_ntz")).orderBy("crawled_at", "page_id").limit(50).select("page_id")


def t7_stale_seeds(spark, root):
    return R.stale_seeds(_t(spark, root, "seed_urls"), AS_OF, 30).select("seed_id")


def t8_stale_domains(spark, root):
    return R.stale_domains(_t(spark, root, "domains"), _t(spark, root, "seed_urls"), datetime(2026, 1, 1), least_pages=5).select("domain_id")


def st10_tick(spark, root):
    return R.scheduler_tick(_t(spark, root, "crawl_queue"), _t(spark, root, "seed_urls"), _t(spark, root, "domains"), datetime(2026, 1, 1))


def st11_reset(spark, root):
    return R.reset_stalled(_t(spark, root, "crawl_queue"), AS_OF).select("queue_id", "status")


def st12_complete(spark, root):
    q = _t(spark, root, "crawl_queue")
    done = q.where("status = 'in_progress'").select("queue_id", F.when(F.col("retries") > 0, "timeout").otherwise("").alias("error"))
    return R.complete(q, done)


def fd1_outcomes(spark, root):
    log = _t(spark, root, "fetch_log")
    return log.groupBy(R.outcome(F.col("status"), F.col("content_type"), F.coalesce("final_url", "url"), F.lit(0)).alias("outcome")).agg(F.count("*").alias("n"))


def fd3_demoted(spark, root):
    return _t(spark, root, "crawl_queue").select("queue_id", F.round(R.demoted(F.col("score")), 6).alias("score"), F.round(R.static_score(F.col("score"), F.col("depth")), 6).alias("static"), R.backoff_seconds(F.col("retries")).alias("wait"))


def fd4_render(spark, root):
    return _t(spark, root, "pages").groupBy(R.render_reason(F.col("content"), F.col("content"), F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))


def fr2_admitted(spark, root):
    links = _t(spark, root, "crawl_queue").select("url", "depth", F.col("score").alias("base"))
    return R.admit(links, _t(spark, root, "pages")).select("url", "domain", "depth", F.round("score", 6).alias("score"))


def fr4_per_page(spark, root):
    return R.per_page_links(_t(spark, root, "links"), 2).select("source_id", "target_hash", "created_at")


def fr7_adaptive(spark, root):
    clicks = _t(spark, root, "click_log")
    terms = P.profile(P.interest_terms(clicks.select("query"), clicks))
    links = _t(spark, root, "crawl_queue").select(F.col("queue_id").alias("id"), F.lit("").alias("anchor"), "url", F.lit("").alias("title"), "domain", "depth", F.col("score").alias("base"))
    return P.adaptive_score(links, terms, P.reputations(clicks), 10).select("id", F.round("score", 4).alias("score"))


def sp1_dictionary(spark, root):
    return spell.dictionary(S.vocabulary(index_of(spark, root)))


def sp2_suggestions(spark, root):
    """Suggestions for the words of clicked queries that no page holds."""
    words = _t(spark, root, "click_log").select(F.explode(P.X.tokens(F.col("query"))).alias("word")).distinct().withColumn("word", F.concat(F.left("word", F.length("word") - 1), F.lit("q"))).distinct()
    return spell.suggest(words, spell.dictionary(S.vocabulary(index_of(spark, root))))


def qp9_known(spark, root):
    words = _t(spark, root, "click_log").select(F.explode(P.X.tokens(F.col("query"))).alias("word")).distinct()
    return words.join(S.vocabulary(index_of(spark, root)).select(F.col("term").alias("word")), "word", "left_semi")


def qp10_compounds(spark, root):
    """Neighbouring words of titles run together, split again."""
    toks = P.X.tokens(F.col("title"))
    pairs = _t(spark, root, "pages").select(F.explode(F.transform(F.filter(F.arrays_zip(toks.alias("a"), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))).alias("b")), lambda z: z["b"].isNotNull()), lambda z: F.concat(z["a"], z["b"]))).alias("word")).distinct()
    return spell.split_compounds(pairs, S.vocabulary(index_of(spark, root)))


def ex24_kinds(spark, root):
    return _t(spark, root, "fetch_log").groupBy(U.asset_kind(F.col("content_type")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (a8_click_counts, a9_interest, a10_reputation, a11_domain_stats, a11_flushes, a12_pending, a13_snapshot, a14_shapes, w4_domain_order, w5_round_robin, t4_dequeue, t5_dequeue_without, t6_stale_pages, t7_stale_seeds, t8_stale_domains, st10_tick, st11_reset, st12_complete, fd1_outcomes, fd3_demoted, fd4_render, fr2_admitted, fr4_per_page, fr7_adaptive, sp1_dictionary, sp2_suggestions, qp9_known, qp10_compounds, ex24_kinds)}

_NOW, _LATE = "TIMESTAMP '2024-12-01 00:00:00'", "TIMESTAMP '2026-01-01 00:00:00'"
_FLUSH = """once AS (SELECT DISTINCT ON (fetch_id) fetch_id, domain, duration_ms, ts FROM fetch_log WHERE domain <> ''),
    fl AS (SELECT domain, CAST(floor(epoch(ts) / 30) AS BIGINT) AS flush, CAST(count(*) AS BIGINT) AS pages, CAST(floor(sum(duration_ms) / count(*)) AS BIGINT) AS avg_ms, max(ts) AS last FROM once WHERE duration_ms IS NOT NULL GROUP BY 1, 2)"""
_DUE = "epoch({now}) - epoch(coalesce(last_enqueued, TIMESTAMP '1970-01-01')) > recrawl_interval_seconds"
_STALE = "SELECT * FROM domains WHERE domain NOT IN (SELECT domain FROM seed_urls) AND pages_count >= 50 AND (last_crawled IS NULL OR last_crawled < TIMESTAMP '2025-12-31') ORDER BY pages_count DESC, last_crawled NULLS FIRST, domain_id LIMIT 100"
_ITOK = r"regexp_split_to_array(lower({x}), '[^\p{L}\p{Nd}]+')"
_CLICK_WORDS = "SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(" + plain_sql("query") + ", ' ')) AS w FROM click_log) WHERE w <> ''"
_TAKE = "SELECT queue_id FROM crawl_queue WHERE status = 'pending'{x} ORDER BY score DESC, added_at, queue_id LIMIT 25"

ORACLES = {
    "a8_click_counts": f"SELECT query, url, CAST(count(*) AS BIGINT) AS clicks FROM (SELECT {plain_sql('query')} AS query, url FROM click_log) WHERE query <> '' GROUP BY query, url",
    "a9_interest": f"""WITH t AS (SELECT unnest({_ITOK.replace('{x}', 'query')}) AS term FROM click_log), g AS (SELECT term, count(*) AS n FROM t WHERE strlen(term) > 2 GROUP BY term) SELECT term, 'query' AS source, CAST(n AS DOUBLE) AS weight FROM g UNION ALL SELECT term, 'click', 2.0 * n FROM g""",
    "a10_reputation": f"SELECT d AS domain, CAST(0.5 * count(*) AS DOUBLE) AS score, CAST(count(*) AS BIGINT) AS pages_count FROM (SELECT regexp_replace({HOST}, '^www[.]', '') AS d FROM click_log) WHERE d <> '' GROUP BY d",
    "a11_domain_stats": f"""WITH RECURSIVE {_FLUSH}, k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY flush) AS i FROM fl), r AS (SELECT domain, i, avg_ms AS v FROM k WHERE i = 1 UNION ALL SELECT k.domain, k.i, CAST(trunc(0.3::DOUBLE * k.avg_ms + (1 - 0.3::DOUBLE) * r.v) AS BIGINT) FROM r JOIN k ON k.domain = r.domain AND k.i = r.i + 1),
        e AS (SELECT domain, arg_max(v, i) AS avg_ms FROM r GROUP BY domain) SELECT domain, CAST(sum(pages) AS BIGINT) AS pages, any_value(e.avg_ms) AS avg_ms, max(last) AS last FROM fl JOIN e USING (domain) GROUP BY domain""",
    "a11_flushes": f"WITH {_FLUSH} SELECT domain, flush, pages, avg_ms FROM fl",
    "a12_pending": "SELECT domain, CAST(count(*) AS BIGINT) AS n FROM crawl_queue WHERE status = 'pending' GROUP BY domain",
    "a13_snapshot": "SELECT CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending, CAST(count(DISTINCT domain) FILTER (status = 'pending') AS BIGINT) AS domains, CAST(count(*) AS BIGINT) AS enqueued FROM crawl_queue",
    "a14_shapes": "SELECT url_fingerprint, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1",
    "w4_domain_order": "SELECT queue_id, domain, score, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, added_at, queue_id) AS INTEGER) AS place FROM crawl_queue WHERE status = 'pending'",
    "w5_round_robin": "SELECT queue_id, place FROM (SELECT queue_id, domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, added_at, queue_id) AS INTEGER) AS place FROM crawl_queue WHERE status = 'pending') ORDER BY place, domain NULLS FIRST, queue_id LIMIT 50",
    "t4_dequeue": f"WITH t AS ({_TAKE.format(x='')}) SELECT queue_id, CASE WHEN queue_id IN (SELECT queue_id FROM t) THEN 'in_progress' ELSE status END AS status, CASE WHEN queue_id IN (SELECT queue_id FROM t) THEN {_NOW} ELSE locked_at END AS locked_at FROM crawl_queue",
    "t5_dequeue_without": f"""WITH t AS ({_TAKE.format(x=" AND domain NOT IN ('norwick.example')")}) SELECT queue_id, CASE WHEN queue_id IN (SELECT queue_id FROM t) THEN 'in_progress' ELSE status END AS status FROM crawl_queue""",
    "t6_stale_pages": f"SELECT page_id FROM pages WHERE crawled_at < {_NOW} ORDER BY crawled_at, page_id LIMIT 50",
    "t7_stale_seeds": f"SELECT seed_id FROM seed_urls WHERE {_DUE.format(now=_NOW)} ORDER BY coalesce(last_enqueued, TIMESTAMP '1970-01-01'), seed_id LIMIT 30",
    "t8_stale_domains": f"SELECT domain_id FROM ({_STALE.replace('pages_count >= 50', 'pages_count >= 5')})",
    "st10_tick": f"""SELECT 'seed' AS source, url, 100.0::DOUBLE AS score FROM (SELECT url FROM seed_urls WHERE {_DUE.format(now=_LATE)} ORDER BY coalesce(last_enqueued, TIMESTAMP '1970-01-01'), seed_id LIMIT 100)
        UNION ALL SELECT 'domain', 'https://' || domain || '/', 5.0 FROM ({_STALE}) UNION ALL SELECT * FROM (SELECT 'queue', url, score FROM crawl_queue WHERE status = 'pending' OR (status = 'in_progress' AND locked_at < {_LATE} - INTERVAL 30 MINUTE) ORDER BY score DESC, added_at, queue_id LIMIT 100)""",
    "st11_reset": f"SELECT queue_id, CASE WHEN status = 'in_progress' AND locked_at < {_NOW} - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS status FROM crawl_queue",
    "st12_complete": "SELECT queue_id, CASE WHEN status = 'in_progress' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'in_progress' THEN retries + 1 ELSE retries END AS retries, CASE WHEN status = 'in_progress' THEN 'timeout' ELSE error_msg END AS error_msg FROM crawl_queue WHERE status <> 'in_progress' OR retries > 0",
    "fd1_outcomes": """WITH l AS (SELECT status, lower(coalesce(content_type, '')) AS c FROM fetch_log) SELECT CASE WHEN status IS NULL OR status = 0 THEN 'retry' WHEN status IN (403, 503) THEN 'render' WHEN status = 429 THEN 'throttled' WHEN status BETWEEN 400 AND 499 THEN 'error' WHEN status NOT BETWEEN 200 AND 299 THEN 'retry'
        WHEN c LIKE '%text/html%' OR c LIKE '%application/xhtml+xml%' THEN 'indexed' WHEN regexp_matches(c, 'text/css|(application|text)/javascript|application/(x-javascript|ecmascript|json|ld[+]json|xml|rss[+]xml|atom[+]xml)|text/xml') THEN 'discovery' ELSE 'skipped' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1""",
    "fd3_demoted": "SELECT queue_id, round(greatest(1.0, score * 0.25), 6)::DOUBLE AS score, round(greatest(0.0, CASE WHEN score = 0 THEN 10 ELSE score END - 12 * ln(1 + depth)), 6)::DOUBLE AS static, least(60, 2 * pow(2, least(retries, 5)))::DOUBLE AS wait FROM crawl_queue",
    "fd4_render": f"""WITH x AS (SELECT lower(coalesce(content, '')) AS b, strlen(trim(coalesce(content, ''))) AS n FROM pages) SELECT CASE WHEN regexp_matches(b, '{"|".join(R.NEEDS_SCRIPT)}') THEN 'javascript_required_message' WHEN regexp_matches(b, '{"|".join(R.INTERSTITIAL)}') THEN 'browser_interstitial'
        WHEN n < 200 AND regexp_matches(b, '{"|".join(R.EMPTY_SHELL)}') THEN 'empty_spa_shell' WHEN n < 200 THEN 'weak_http_parse' ELSE '' END AS reason, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""",
    "fr2_admitted": f"""WITH q AS (SELECT {_CANON} AS c, {HOST} AS h, depth, score FROM crawl_queue), p AS (SELECT {_CANON} AS c FROM pages), g AS (SELECT c AS url, any_value(regexp_replace(h, '^www[.]', '')) AS domain, min(depth) AS depth, max(score) AS b FROM q WHERE c IS NOT NULL GROUP BY c)
        SELECT url, domain, depth, round(greatest(0.0, CASE WHEN b = 0 THEN 10 ELSE b END - 12 * ln(1 + depth)), 6)::DOUBLE AS score FROM g WHERE url NOT IN (SELECT c FROM p WHERE c IS NOT NULL)""",
    "fr4_per_page": "SELECT source_id, target_hash, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at, target_hash) AS k FROM links) WHERE k <= 2",
    "fr7_adaptive": f"""WITH t AS (SELECT unnest({_ITOK.replace('{x}', 'query')}) AS term FROM click_log), g AS (SELECT term, CAST(2 * count(*) AS DOUBLE) AS weight FROM t WHERE strlen(term) > 2 GROUP BY term), w AS (SELECT id, word, 30.0 * count(*) AS w FROM (SELECT queue_id AS id, unnest({_ITOK.replace('{x}', 'url')}) AS word FROM crawl_queue) WHERE strlen(word) > 2 GROUP BY 1, 2),
        v AS (SELECT DISTINCT word FROM w), m AS (SELECT word, coalesce((SELECT weight FROM g WHERE term = word), (SELECT 0.5 * max(weight) FROM g WHERE length(term) >= 3 AND length(word) >= 3 AND (contains(word, term) OR contains(term, word)))) AS x FROM v), rel AS (SELECT id, sum(w * x) AS r FROM w JOIN m USING (word) GROUP BY id),
        rep AS (SELECT d, 0.5 * count(*) AS s FROM (SELECT regexp_replace({HOST}, '^www[.]', '') AS d FROM click_log) GROUP BY d) SELECT queue_id AS id, round(greatest(0.0, CASE WHEN score = 0 THEN 10 ELSE score END + coalesce(r, 0) + coalesce(s, 0) * 15 - 12 * ln(1 + depth)), 4)::DOUBLE AS score FROM crawl_queue LEFT JOIN rel ON id = queue_id LEFT JOIN rep ON d = domain""",
    "sp1_dictionary": f"WITH {INDEX} SELECT term, CAST(count(*) AS BIGINT) AS doc FROM post WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 3",
    "sp2_suggestions": f"""WITH {INDEX}, k AS (SELECT term, count(*) AS doc FROM post WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 3), w AS (SELECT DISTINCT left(word, length(word) - 1) || 'q' AS word FROM ({_CLICK_WORDS})), u AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT term FROM k)),
        a AS (SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 3) AS g FROM u, LATERAL (SELECT unnest(range(1, length(word) - 1)) AS i) r), b AS (SELECT DISTINCT term, doc, substr(term, CAST(i AS BIGINT), 3) AS g FROM k, LATERAL (SELECT unnest(range(1, length(term) - 1)) AS i) r),
        s AS (SELECT word, term, doc, count(*) AS n FROM a JOIN b USING (g) GROUP BY ALL), tt AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, doc DESC, term) AS r FROM s), d AS (SELECT *, levenshtein(word, term) AS dist FROM tt WHERE r <= 100)
        SELECT word, term AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, doc DESC, term) AS z FROM d WHERE dist <= CASE WHEN length(word) >= 7 THEN 3 ELSE 2 END) WHERE z = 1""",
    "qp9_known": f"WITH {INDEX} SELECT word FROM ({_CLICK_WORDS}) WHERE word IN (SELECT term FROM post)",
    "qp10_compounds": f"""WITH {INDEX}, v AS (SELECT DISTINCT term FROM post), w AS (SELECT list_filter(string_split({plain_sql('title')}, ' '), lambda x: x <> '') AS ws FROM pages WHERE title IS NOT NULL), p AS (SELECT DISTINCT ws[i] || ws[i + 1] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws))) AS i) r),
        c AS (SELECT word, left(word, CAST(i AS BIGINT)) AS head, substr(word, CAST(i + 1 AS BIGINT)) AS tail, i FROM p, LATERAL (SELECT unnest(range(3, length(word) - 2)) AS i) r WHERE length(word) >= 7 AND word NOT IN (SELECT term FROM v))
        SELECT word, arg_max(head, i) AS head, arg_max(tail, i) AS tail FROM c WHERE head IN (SELECT term FROM v) AND tail IN (SELECT term FROM v) GROUP BY word""",
    "ex24_kinds": "SELECT CASE WHEN c LIKE '%text/css%' THEN 'css' WHEN c LIKE '%javascript%' OR c LIKE '%ecmascript%' THEN 'js' WHEN c LIKE '%json%' THEN 'json' WHEN c LIKE '%rss%' THEN 'rss' WHEN c LIKE '%atom%' THEN 'atom' WHEN c LIKE '%xml%' THEN 'xml' ELSE 'other' END AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT lower(coalesce(content_type, '')) AS c FROM fetch_log) GROUP BY 1",
}
# DuckDB counts edits by bytes, Spark by characters; suggestions are compared with brute force in the tests.
del ORACLES["sp2_suggestions"]
