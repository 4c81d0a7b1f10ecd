"""Queries of the full-text index, the retrieval plans and the ranking parts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import search as S
from ..sources import shared_folder
from ..sources.tables import spread, stamp, table

AS_OF = datetime(2024, 6, 1)
ANY, BOTH, NAV = ["harbour", "museum", "garden"], ["river", "museum"], "norwick"


def _pages(spark, root):
    return table(spark, root, "pages")


_INDEXES: dict[tuple, S.Index] = {}


def index_of(spark, root, stem: bool = False) -> S.Index:
    """Index over the pages of a folder, written once to the shared folder for each state of their files and read from there.

    Without stems by default, as SQL has none to compare with.
    """
    at = (spark.sparkContext.applicationId, root, stem, stamp(spark, root, "pages"))
    if at not in _INDEXES:
        folder = shared_folder(spark, "index")
        S.build(spread(_pages(spark, root)), stem=stem).write(folder, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        _INDEXES[at] = S.Index.read(spark, folder)
    return _INDEXES[at]


def ft0_build(spark, root):
    """The index itself, built anew: its postings, counted by the number of words they share a page with."""
    return S.build(spread(_pages(spark, root)), stem=False).postings.groupBy("d").agg(F.count("*").alias("postings"))


def _top(df, n=50):
    return df.select("id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(n)


def ft7_bm25(spark, root):
    return _top(S.bm25(index_of(spark, root), ANY, need=1))


def ft4_exact(spark, root):
    return S.bm25(index_of(spark, root), BOTH).select("id", F.round("score", 6).alias("score"))


def ft5_core(spark, root):
    """The two rarest of three words, both of them."""
    index = index_of(spark, root)
    q = S.parse("the museum river baker")
    q.idf = S.idf_map(index, q.tokens)
    return S.bm25(index, q.by_weight()[:2]).select("id", F.round("score", 6).alias("score"))


def ft6_relaxed(spark, root):
    return _top(S.bm25(index_of(spark, root), ["muse", "harbour"], need=1, prefix=True))


def ft3_phrase(spark, root):
    return S.bm25_phrase(index_of(spark, root), ["the", "river", "museum"]).select("id", F.round("score", 6).alias("score"))


def ft8_recent(spark, root):
    pages = _pages(spark, root)
    found = S.bm25(index_of(spark, root), ANY, need=1).withColumn("score", F.round("score", 6))
    return S.plan_recent(found, pages, AS_OF, 30)


def ft9_elsewhere(spark, root):
    pages = _pages(spark, root)
    found = S.bm25(index_of(spark, root), ANY, need=1).withColumn("score", F.round("score", 6))
    return S.plan_elsewhere(found, pages, "gallebury-wiki.example", 40)


def ft10_navigational(spark, root):
    return S.plan_navigational(_pages(spark, root), S.Query(NAV, NAV, [NAV], [NAV], nav_term=NAV), 60, AS_OF, "de").select("id", F.round("score", 6).alias("score"))


def ft14_counts(spark, root):
    index = index_of(spark, root)
    one = S.bm25(index, BOTH).agg(F.count("*").alias("both"))
    return one.crossJoin(S.bm25(index, BOTH, need=1).agg(F.count("*").alias("either")))


def a5_vocabulary(spark, root):
    return S.vocabulary(index_of(spark, root))


def a6_idf(spark, root):
    index = index_of(spark, root)
    n = index.docs.agg(F.count("*").alias("nn"))
    return S.vocabulary(index).crossJoin(F.broadcast(n)).select("term", F.round(F.log(F.col("nn") / F.col("doc")), 6).alias("idf"))


def qp2_plain(spark, root):
    return _pages(spark, root).select("page_id", X.plain(F.col("title")).alias("plain"))


def qp3_stopwords(spark, root):
    return _pages(spark, root).select("page_id", F.array_join(X.without_stopwords(X.tokens(F.col("title"))), " ").alias("kept"))


def ex10_squeeze(spark, root):
    return _pages(spark, root).select("page_id", X.squeeze(F.col("content")).alias("text"))


def fr8_interest_tokens(spark, root):
    return table(spark, root, "click_log").select(F.explode(X.interest_tokens(F.col("query"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rk4_authority(spark, root):
    return _pages(spark, root).select("page_id", F.round(S.authority(F.col("pagerank"), F.col("referring_domains")), 6).alias("authority"))


def rk6_freshness(spark, root):
    return _pages(spark, root).select("page_id", F.round(S.freshness(F.col("crawled_at"), F.col("published_at"), F.lit(AS_OF)), 6).alias("freshness"))


def rk7_news(spark, root):
    return _pages(spark, root).select("page_id", S.news_recency(F.col("published_at"), F.lit(AS_OF)).alias("points"))


def w1_merge(spark, root):
    index = index_of(spark, root)
    plans = [("exact", S.bm25(index, BOTH)), ("core", S.bm25(index, ["museum"])), ("relaxed", S.bm25(index, BOTH, need=1))]
    return S.merge([(m, d.withColumn("score", F.round("score", 6))) for m, d in plans])


def j1_clicked(spark, root):
    pages = _pages(spark, root)
    clicks = table(spark, root, "click_log").groupBy(X.plain(F.col("query")).alias("query"), "url").agg(F.count("*").alias("n"))
    top = clicks.groupBy("query").agg(F.sum("n").alias("s")).where("query <> ''").orderBy(F.col("s").desc(), "query").limit(1).first()
    word = top["query"] if top else "none"
    flat = pages.select(F.col("page_id").alias("id"), F.lit(1.0).alias("score"))
    return S.clicks_added(flat, pages, clicks, S.Query(word, word, [word], [word]))


def rk1_rank(spark, root):
    pages = _pages(spark, root)
    index = index_of(spark, root, stem=True)
    q = S.parse("river museum maps")
    q.idf = S.idf_map(index, q.tokens)
    found = _top(S.bm25(index, q.tokens, need=1), 100).withColumn("mode", F.lit("exact"))
    return S.rank(found, pages, q, AS_OF, "en").select("id", F.round("rank", 4).alias("rank"), "pos")


def ft1_search(spark, root):
    pages = _pages(spark, root)
    return S.search(index_of(spark, root, stem=True), pages, "river museum maps", AS_OF, limit=20, lang="en", domains=table(spark, root, "domains"))


def ft13_images(spark, root):
    """Image search; the pages stand in for images: title, description and the content as context."""
    images = _pages(spark, root).select(F.col("page_id").alias("image_id"), F.col("title").alias("alt_text"), F.col("description").alias("title"), F.col("content").alias("context"))
    return S.search_images(images, "river museum", 20, stem=False).select("id", F.round("score", 6).alias("score"))


def w2_promoted(spark, root):
    return S.promote_language(_ranked(spark, root), "de")


def w3_diversified(spark, root):
    return S.diversified(_ranked(spark, root))


def _ranked(spark, root):
    rows = _pages(spark, root).orderBy(F.col("pagerank").desc(), "page_id").limit(300)
    from pyspark.sql import Window

    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.col("pagerank").desc(), "page_id"))).select(F.col("page_id").alias("id"), "domain", "language", "pos")


def t3_paging(spark, root):
    return _pages(spark, root).orderBy(F.col("crawled_at").desc(), "page_id").offset(20).limit(10).select("page_id")


def url13_registered(spark, root):
    d = F.col("domain")
    return _pages(spark, root).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n")).select("domain", U.registered_domain(d).alias("registered"), U.root_label(d).alias("label"))


QUERIES = {f.__name__: f for f in (ft0_build, ft7_bm25, ft4_exact, ft5_core, ft6_relaxed, ft3_phrase, ft8_recent, ft9_elsewhere, ft10_navigational, ft14_counts, a5_vocabulary, a6_idf, qp2_plain, qp3_stopwords, ex10_squeeze, fr8_interest_tokens, rk4_authority, rk6_freshness, rk7_news, w1_merge, j1_clicked, rk1_rank, ft1_search, ft13_images, w2_promoted, w3_diversified, t3_paging, url13_registered)}

PLAIN = f"trim(regexp_replace(regexp_replace(translate(lower(trim({{x}})), '{X.MARKED}', '{X.PLAIN}'), '\\p{{{{M}}}}+', '', 'g'), '[^\\p{{{{L}}}}\\p{{{{Nd}}}}]+', ' ', 'g'))".replace("{{M}}", "{M}").replace("{{L}}", "{L}").replace("{{Nd}}", "{Nd}")


def plain_sql(x: str) -> str:
    return PLAIN.replace("{x}", x)




def index_sql(weights: dict[str, float]) -> str:
    """CTEs post(term, id, w, n), docs(id, d), st(nn, a) over columns of the pages."""
    fields = " UNION ALL ".join(f"SELECT page_id AS id, {w} AS w, {plain_sql(c)} AS x FROM pages" for c, w in weights.items())
    return f"""f AS ({fields}), t AS (SELECT id, w, unnest(string_split(x, ' ')) AS term FROM f), post AS (SELECT term, id, CAST(sum(w) AS DOUBLE) AS w, count(*) AS n FROM t WHERE term <> '' GROUP BY term, id),
    docs AS (SELECT page_id AS id, coalesce(c, 0) AS d FROM pages LEFT JOIN (SELECT id, sum(n) AS c FROM post GROUP BY id) z ON z.id = page_id), st AS (SELECT count(*) AS nn, avg(d) AS a FROM docs)"""


INDEX = index_sql({c: w for c, w in S.WEIGHTS.items() if c in ("title", "h1", "description", "content")})


def bm25_sql(hits: str, name: str = "s") -> str:
    """CTEs that end in ``name``(id, score, k) for a relation of hits (q, id, w)."""
    return f"""{name}_h AS ({hits}), {name}_df AS (SELECT q, CASE WHEN ln((nn - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM {name}_h, st GROUP BY q, nn),
    {name} AS (SELECT h.id, sum(idf * h.w * 2.2 / (h.w + 1.2 * (0.25 + 0.75 * d / a))) AS score, count(DISTINCT h.q) AS k FROM {name}_h h JOIN {name}_df USING (q) JOIN docs USING (id), st GROUP BY h.id)"""


_terms = lambda ts: "SELECT term AS q, id, w FROM post WHERE term IN (" + ", ".join(f"'{t}'" for t in ts) + ")"
_TOP = "SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT {n}"
_PREFIX = _terms(["muse", "harbour"]) + " UNION ALL SELECT t || '*', id, sum(w) FROM post, (VALUES ('muse'), ('harbour')) v(t) WHERE starts_with(term, t) GROUP BY t, id"
_count_phrase = " + ".join(
    f"{w} * CAST((length(h_{c}) - length(replace(h_{c}, ' the  river  museum ', ''))) / length(' the  river  museum ') AS DOUBLE)" for c, w in S.WEIGHTS.items() if c in ("title", "h1", "description", "content")
)
_hays = ", ".join(f"'  ' || replace(coalesce({plain_sql(c)}, ''), ' ', '  ') || '  ' AS h_{c}" for c in ("title", "h1", "description", "content"))
_stop = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]"
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
_TOK_TITLE = f"list_filter(string_split(coalesce({plain_sql('title')}, ''), ' '), lambda x: x <> '')"

ORACLES = {
    "ft0_build": f"WITH {INDEX} SELECT CAST(d AS INTEGER) AS d, CAST(count(*) AS BIGINT) AS postings FROM post JOIN docs USING (id) GROUP BY d",
    "ft7_bm25": f"WITH {INDEX}, {bm25_sql(_terms(ANY))} {_TOP.format(n=50)}",
    "ft4_exact": f"WITH {INDEX}, {bm25_sql(_terms(BOTH))} SELECT id, round(score, 6) AS score FROM s WHERE k = 2",
    "ft5_core": f"""WITH {INDEX}, pick AS (SELECT t FROM (VALUES ('museum'), ('river'), ('baker')) v(t) LEFT JOIN (SELECT term, count(*) AS c FROM post GROUP BY term) x ON x.term = t, st ORDER BY round(ln(nn / c), 3) DESC, length(t) DESC LIMIT 2),
        {bm25_sql("SELECT term AS q, id, w FROM post WHERE term IN (SELECT t FROM pick)")} SELECT id, round(score, 6) AS score FROM s WHERE k = 2""",
    "ft6_relaxed": f"WITH {INDEX}, {bm25_sql(_PREFIX)} {_TOP.format(n=50)}",
    "ft3_phrase": f"WITH {INDEX}, hay AS (SELECT page_id AS id, {_hays} FROM pages), ph AS (SELECT 'p' AS q, id, {_count_phrase} AS w FROM hay), {bm25_sql('SELECT q, id, w FROM ph WHERE w > 0')} SELECT id, round(score, 6) AS score FROM s",
    "ft8_recent": f"""WITH {INDEX}, {bm25_sql(_terms(ANY))}, r AS (SELECT s.id, round(score, 6) AS score, date_diff('day', CAST(published_at AS DATE), DATE '2024-06-01') AS age FROM s JOIN pages ON page_id = s.id WHERE published_at IS NOT NULL)
        SELECT id, score FROM r WHERE age <= 180 ORDER BY score + CASE WHEN age <= 1 THEN 60 WHEN age <= 7 THEN 45 WHEN age <= 30 THEN 25 WHEN age <= 90 THEN 10 ELSE 0 END DESC, id LIMIT 30""",
    "ft9_elsewhere": f"WITH {INDEX}, {bm25_sql(_terms(ANY))} SELECT s.id, round(score, 6) AS score FROM s JOIN pages ON page_id = s.id WHERE lower(domain) NOT LIKE '%gallebury-wiki.example' ORDER BY round(score, 6) DESC, s.id LIMIT 40",
    "ft10_navigational": f"""WITH x AS (SELECT page_id AS id, crawled_at, round(CASE WHEN lower(domain) = '{NAV}' THEN 1500 ELSE 0 END + CASE WHEN lower(domain) LIKE '%{NAV}%' THEN 800 ELSE 0 END
        + CASE WHEN lower(url) = 'https://' || lower(domain) || '/' THEN 2000 ELSE 0 END + CASE WHEN regexp_full_match(lower(url), 'https://[^/]+/[a-z][a-z]') THEN 1200 ELSE 0 END + CASE WHEN lower(url) LIKE '%{NAV}%' THEN 220 ELSE 0 END
        + CASE WHEN lower(title) LIKE '%{NAV}%' THEN 160 ELSE 0 END + CASE WHEN lower(h1) LIKE '%{NAV}%' THEN 120 ELSE 0 END + CASE WHEN length(url) - length(replace(url, '/', '')) <= 3 THEN 500 ELSE 0 END
        + coalesce(greatest(0.0, 20 - 0.2 * date_diff('day', CAST(crawled_at AS DATE), DATE '2024-06-01')), 0) + CASE WHEN language = 'de' THEN 300 ELSE 0 END, 6)::DOUBLE AS score
        FROM pages WHERE lower(domain) LIKE '%{NAV}%' OR lower(url) LIKE '%{NAV}%' OR lower(title) LIKE '%{NAV}%' OR lower(h1) LIKE '%{NAV}%') SELECT id, score FROM x ORDER BY score DESC, crawled_at DESC, id LIMIT 60""",
    "ft14_counts": f"""WITH {INDEX}, m AS (SELECT id, count(*) AS k FROM post WHERE term IN ('river', 'museum') GROUP BY id) SELECT CAST(count(*) FILTER (k = 2) AS BIGINT) AS both, CAST(count(*) AS BIGINT) AS either FROM m""",
    "a5_vocabulary": f"WITH {INDEX} SELECT term, CAST(count(*) AS BIGINT) AS doc, CAST(sum(n) AS BIGINT) AS cnt FROM post GROUP BY term",
    "a6_idf": f"WITH {INDEX} SELECT term, round(ln(nn / count(*)), 6) AS idf FROM post, st GROUP BY term, nn",
    "qp2_plain": f"SELECT page_id, {plain_sql('title')} AS plain FROM pages",
    "qp3_stopwords": f"""WITH w AS (SELECT page_id, {_TOK_TITLE} AS ws FROM pages), k AS (SELECT page_id, ws, CASE WHEN list_has_any(ws, {_stop(X.MEDIA_WORDS)}) THEN list_filter(ws, lambda x: NOT list_contains({_stop(X.STOPWORDS - X.TITLE_WORDS)}, x))
        ELSE list_filter(ws, lambda x: NOT list_contains({_stop(X.STOPWORDS)}, x)) END AS left_ FROM w) SELECT page_id, array_to_string(CASE WHEN len(ws) <= 1 OR len(left_) = 0 THEN ws ELSE left_ END, ' ') AS kept FROM k""",
    "ex10_squeeze": r"SELECT page_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS text FROM pages",
    "fr8_interest_tokens": r"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_split_to_array(lower(query), '[^\p{L}\p{Nd}]+')) AS token FROM click_log) WHERE strlen(token) > 2 GROUP BY token",
    "rk4_authority": "SELECT page_id, round(CASE WHEN coalesce(pagerank, 0) > 0 THEN least(ln(1 + pagerank), 4.0) * 100 WHEN coalesce(referring_domains, 0) > 0 THEN least(ln(1 + referring_domains), 3.0) * 70 ELSE 0 END, 6) AS authority FROM pages",
    "rk6_freshness": f"SELECT page_id, round(CASE WHEN coalesce(published_at, crawled_at) IS NULL THEN 0 ELSE greatest(0.0, 50 - (epoch_us({_NOW}) - epoch_us(coalesce(published_at, crawled_at))) / 86400000000 * 0.15) END, 6)::DOUBLE AS freshness FROM pages",
    "rk7_news": f"""WITH d AS (SELECT page_id, (epoch_us({_NOW}) - epoch_us(published_at)) / 86400000000 AS days FROM pages)
        SELECT page_id, CAST(CASE WHEN days IS NULL THEN -4000 WHEN days < 0 THEN 12000 {" ".join(f"WHEN days <= {a} THEN {p}" for a, p in S.NEWS[:-1])} ELSE -22000 END AS DOUBLE) AS points FROM d""",
    "w1_merge": f"""WITH {INDEX}, {bm25_sql(_terms(BOTH), "a")}, {bm25_sql(_terms(["museum"]), "b")}, u AS (SELECT id, round(score, 6) AS score, 'exact' AS mode, 0 AS p FROM a WHERE k = 2 UNION ALL SELECT id, round(score, 6), 'core', 1 FROM b UNION ALL SELECT id, round(score, 6), 'relaxed', 2 FROM a)
        SELECT id, score, mode FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, p) AS rn FROM u) WHERE rn = 1""",
    "j1_clicked": f"""WITH c AS (SELECT {plain_sql('query')} AS query, url, count(*) AS n FROM click_log GROUP BY 1, 2), top AS (SELECT query FROM c WHERE query <> '' GROUP BY query ORDER BY sum(n) DESC, query LIMIT 1)
        SELECT page_id AS id, CAST(1 + 50 * coalesce(n, 0) AS DOUBLE) AS score FROM pages p LEFT JOIN (SELECT url, n FROM c JOIN top USING (query)) m USING (url)""",
    "w2_promoted": """WITH r AS (SELECT page_id AS id, domain, language, row_number() OVER (ORDER BY pagerank DESC NULLS LAST, page_id) AS pos FROM pages), t AS (SELECT *, coalesce(nullif(regexp_extract(domain, '([^.]*[.][^.]*)$', 1), ''), domain) AS site,
        CASE language WHEN 'de' THEN 2 WHEN 'en' THEN 1 ELSE 0 END AS ls FROM r WHERE pos <= 300), a AS (SELECT *, min(pos) OVER (PARTITION BY site) AS first_, max(ls) OVER (PARTITION BY site) AS top FROM t),
        b AS (SELECT *, min(CASE WHEN ls = top AND top > 0 THEN pos END) OVER (PARTITION BY site) AS best FROM a) SELECT id, domain, language, CAST(row_number() OVER (ORDER BY CASE WHEN pos = best THEN first_ - 0.5 ELSE pos END, pos) AS INTEGER) AS pos FROM b""",
    "ft13_images": f"WITH {index_sql(dict.fromkeys(('title', 'description', 'content'), 1.0))}, {bm25_sql(_terms(BOTH) + " UNION ALL SELECT t || '*', id, sum(w) FROM post, (VALUES ('river'), ('museum')) v(t) WHERE starts_with(term, t) GROUP BY t, id")} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20",
    "w3_diversified": """WITH RECURSIVE r AS (SELECT page_id AS id, domain, language, row_number() OVER (ORDER BY pagerank DESC NULLS LAST, page_id) AS pos FROM pages), t AS (SELECT * FROM r WHERE pos <= 300), d AS (SELECT list(coalesce(domain, '') ORDER BY pos) AS doms FROM t),
        s AS (SELECT range(1, len(doms) + 1) AS waiting, []::BIGINT[] AS later, []::BIGINT[] AS done, []::VARCHAR[] AS seen, len(doms) AS pass FROM d
        UNION ALL SELECT CASE WHEN len(waiting) > 0 THEN waiting[2:] ELSE later END, CASE WHEN len(waiting) = 0 THEN [] WHEN ok THEN later ELSE list_append(later, waiting[1]) END, CASE WHEN len(waiting) > 0 AND ok THEN list_append(done, waiting[1]) ELSE done END,
        CASE WHEN len(waiting) > 0 AND ok THEN list_append(seen, dom) ELSE seen END, CASE WHEN len(waiting) > 0 THEN pass ELSE len(later) END
        FROM (SELECT waiting, later, done, seen, pass, dom, len(list_filter(seen, lambda x: x = dom)) < CASE WHEN len(done) < 3 THEN 1 WHEN len(done) < 10 THEN 2 ELSE 3 END AS ok FROM (SELECT s.*, doms[waiting[1]] AS dom FROM s, d))
        WHERE len(waiting) > 0 OR (len(later) > 0 AND len(later) < pass)),
        o AS (SELECT list_concat(done, later) AS places FROM s WHERE len(waiting) = 0 AND (len(later) = 0 OR len(later) = pass) LIMIT 1)
        SELECT id, domain, language, CAST(list_position(places, pos) AS INTEGER) AS pos FROM t, o""",
    "t3_paging": "SELECT page_id FROM pages ORDER BY crawled_at DESC NULLS LAST, page_id LIMIT 10 OFFSET 20",
    "url13_registered": "SELECT DISTINCT domain, regexp_extract(domain, '([^.]*[.][^.]*)$', 1) AS registered, regexp_extract(domain, '([^.]*)[.][^.]*$', 1) AS label FROM pages WHERE domain <> ''",
}
