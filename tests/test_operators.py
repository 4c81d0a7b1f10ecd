import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.operators import frontier, graph, html, profile, spell, storage
from webloom.operators import search as S
from webloom.streaming import state


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "https://a.example/", "a.example", "Running the river museum", "River museum", "", "the river museum opens and the garden runs", "en", 1.5, 3, datetime(2024, 5, 1), datetime(2024, 5, 20)),
        (2, "https://b.example/x", "b.example", "Garden", "Garden tools", "", "garden garden garden river", "en", 0.5, 0, datetime(2024, 4, 1), None),
        (3, "https://a.example/y", "a.example", "Nothing", None, None, None, "de", None, None, None, None),
        (4, "https://c.example/river-museum", "c.example", "Museum", "", "river", "museum by the river", "de", 2.0, 9, datetime(2024, 1, 1), datetime(2023, 1, 1)),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, domain string, title string, h1 string, description string, content string, language string, pagerank double, referring_domains int, crawled_at timestamp_ntz, published_at timestamp_ntz")


def fts(rows, match, tokenizer="unicode61"):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, h1, description, content, tokenize='%s')" % tokenizer)
    for r in rows:
        con.execute("insert into t(rowid, title, h1, description, content) values (?,?,?,?,?)", (r["page_id"], *(r[c] or "" for c in ("title", "h1", "description", "content"))))
    return {i: -s for i, s in con.execute("select rowid, bm25(t, 10.0, 8.0, 5.0, 1.0) from t where t match ?", (match,))}


@pytest.mark.parametrize("terms,match,need", [(["river"], "river", None), (["river", "museum"], "river museum", None), (["garden", "museum"], "garden OR museum", 1)])
def test_bm25_equals_the_sqlite_engine(pages, terms, match, need):
    want = fts(pages.collect(), match)
    got = {r["id"]: r["score"] for r in S.bm25(S.build(pages, stem=False), terms, need).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_phrase_equals_the_sqlite_engine(pages):
    got = {r["id"]: r["score"] for r in S.bm25_phrase(S.build(pages, stem=False), ["river", "museum"]).collect()}
    assert got == pytest.approx(fts(pages.collect(), '"river museum"'), rel=1e-6)


def test_index_round_trip(pages, spark, tmp_path):
    index = S.build(pages)
    index.write(str(tmp_path), 2)
    again = S.Index.read(spark, str(tmp_path))
    assert sorted(again.postings.collect()) == sorted(index.postings.collect())
    assert again.stem and S.bm25(again, ["running"], None).count() == S.bm25(again, ["runs"], None).count() == 1


@pytest.mark.parametrize("terms,match", [(["gardens"], "gardens"), (["museums", "rivers"], "museums rivers"), (["running", "dog"], "running dog")])
def test_stemmed_bm25_equals_the_sqlite_engine(pages, terms, match):
    """Both sides are stemmed by the same published rules."""
    want = fts(pages.collect(), match, "porter unicode61")
    index = S.build(pages)
    assert {r["id"]: r["score"] for r in S.bm25(index, terms).collect()} == pytest.approx(want, rel=1e-6)
    phrase = fts(pages.collect(), f'"{match}"', "porter unicode61")
    assert {r["id"]: r["score"] for r in S.bm25_phrase(index, terms).collect()} == pytest.approx(phrase, rel=1e-6)


def test_enriched_queries(pages, spark):
    index = S.build(pages)
    domains = spark.createDataFrame([("rivermuseum.example",), ("x.example",)], "domain string")
    q = S.enrich(S.parse("river museum"), index, domains)
    assert (q.domain, q.navigational) == ("rivermuseum.example", True)
    assert S.enrich(S.parse("rivermuseum garden"), index).tokens == ["river", "museum", "garden"]
    assert S.enrich(S.parse(""), index, domains).tokens == []


def test_search(pages):
    index = S.build(pages)
    got = S.search(index, pages, "river museum", datetime(2024, 6, 1), lang="en").collect()
    assert [r["id"] for r in got][0] == 1 and len({r["id"] for r in got}) == len(got)
    assert S.search(index, pages, "river museum", datetime(2024, 6, 1), domain="c.example").select("id").collect() == [(4,)]
    assert S.search(index, pages.limit(0), "river", datetime(2024, 6, 1)).count() == 0
    assert S.search(index, pages, "", datetime(2024, 6, 1)).count() == 0


def test_query_parsing():
    q = S.parse("warframe reddit", frozenset({"reddit"}))
    assert (q.platform, q.tokens, q.navigational) == ("reddit", ["warframe"], True)
    q = S.parse("noticias uruguay", site_types=frozenset({"noticias"}))
    assert (q.site_type, q.tokens, q.fresh, q.navigational) == ("noticias", ["uruguay"], True, False)
    assert S.parse("el pais uruguay").phrase == ["el", "pais", "uruguay"] and S.parse("el pais uruguay").tokens == ["pais", "uruguay"]
    assert S.parse("https://www.example.com/x").domain == "example.com"
    assert S.parse("from serie tv").tokens[0] == "from"
    assert S.parse("elections 2024").dated and not S.parse("elections").dated
    assert S.candidate_limit(10) == 300 and S.candidate_limit(100, 0) == 500


def test_diversify():
    assert S.diversify(list("aab")) == [0, 1, 2]
    order = S.diversify(list("aaaabbbbcd"))
    assert sorted(order) == list(range(10))
    assert [list("aaaabbbbcd")[i] for i in order[:3]] == ["a", "b", "c"]


def test_pagerank_sums_and_matches_power_iteration(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (4, 2)]
    nodes = [1, 2, 3, 4, 5]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(15):
        lost = sum(rank[n] for n in nodes if not any(a == n for a, _ in edges)) / 5
        rank = {n: 0.15 + 0.85 * (lost + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n)) for n in nodes}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(5)
    assert graph.pagerank(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "node long")).count() == 0


def test_upsert_rules(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [(1, "u", "a", t(1), t(1), "http", 2, None), (2, "u", "b", None, t(2), "extension", 3, t(5)), (3, "u", "c", None, t(3), "http", 7, None), (4, "v", "d", None, None, "http", 0, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, published_at timestamp_ntz, crawled_at timestamp_ntz, fetch_mode string, ingest_hits int, last_seen_at timestamp_ntz")
    got = {r["url"]: r for r in storage.upsert_pages(df).collect()}
    assert (got["u"]["title"], got["u"]["published_at"], got["u"]["ingest_hits"], got["u"]["last_seen_at"]) == ("c", t(1), 5, t(5))
    assert sorted(storage.upsert_pages(storage.upsert_pages(df)).select("url", "title").collect()) == [("u", "c"), ("v", "d")]


def test_purge_keeps_lookalikes(spark):
    df = spark.createDataFrame([(1, "example.com"), (2, "sub.example.com"), (3, "notexample.com"), (4, None)], "queue_id long, domain string")
    gone = spark.createDataFrame([("example.com",)], "blocked string")
    assert sorted(r[0] for r in storage.of_domains(df, gone).collect()) == [1, 2]


def test_frontier_admission(spark):
    links = spark.createDataFrame([("https://n.example/a?utm_x=1", 0, 10.0), ("https://n.example/a", 2, 50.0), ("https://n.example/x.pdf", 0, 1.0), ("https://k.example/old", 0, 1.0), ("https://n.example/1", 0, 0.0), ("https://n.example/2", 0, 0.0), (None, 0, 0.0)], "url string, depth int, base double")
    pages = spark.createDataFrame([("https://k.example/old",)], "url string")
    got = {r["url"]: r["score"] for r in frontier.admit(links, pages).collect()}
    assert got == {"https://n.example/a": 50.0, "https://n.example/1": 10.0, "https://n.example/2": 10.0}
    assert frontier.admit(links, pages, strict=True).count() == 2


def test_domain_statistics_fold(spark):
    rows = [(i, "d", float(i), datetime(2024, 1, 1, 0, 0, 10 * i % 60, 0)) for i in range(1, 6)] + [(1, "d", 1.0, datetime(2024, 1, 1, 0, 0, 10)), (9, "", 5.0, datetime(2024, 1, 1)), (8, "d", None, datetime(2024, 1, 1))]
    log = spark.createDataFrame(rows, "fetch_id long, domain string, duration_ms double, ts timestamp_ntz").withColumn("duration_ms", F.col("duration_ms").cast("long"))
    got = frontier.domain_stats(log).collect()
    assert [(r["domain"], r["pages"], r["avg_ms"]) for r in got] == [("d", 5, int(0.3 * 4 + 0.7 * 1))]
    assert frontier.domain_stats(log.limit(0)).count() == 0


def test_spelling_against_brute_force(spark):
    known = [("garden", 9), ("gardens", 5), ("museum", 7), ("museo", 3), ("обзор", 9), ("обзоры", 4)]
    words = ["gardem", "musem", "обзорq", "zzzz", "garden"]
    got = {r["word"]: r["suggestion"] for r in spell.suggest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(known, "term string, doc long")).collect()}
    assert got == {"gardem": "garden", "musem": "museum", "обзорq": "обзор"}


def test_relevance_exact_and_partial(spark):
    links = spark.createDataFrame([(1, "garden tools", "https://x.example/gardening", None, "x.example", 0, 10.0)], "id long, anchor string, url string, title string, domain string, depth int, base double")
    terms = spark.createDataFrame([("garden", 2.0), ("gardener", 5.0)], "term string, weight double")
    # anchor: garden exact 2*40; url: gardening holds garden, half of 2*30.
    assert profile.relevance(links, terms).collect()[0]["relevance"] == pytest.approx(80 + 30)


HTML = """<!doctype html><html lang="es-UY"><head><title> A &amp; B </title><meta property="og:description" content="desc">
<link rel="canonical" href="/canon"><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["NewsArticle"],"headline":"H","author":{"name":"Ann"},"image":[{"url":"/i.jpg"}],"aggregateRating":{"ratingValue":"4.5"},"datePublished":"2024-02-03T00:00:00Z"}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><a href="/nav">n</a></nav><main><h1>Head</h1><h1>Head</h1><p>Short text <b>bold</b><p>Second <a href="/a#x">one</a> <a rel="nofollow" href="/no">no</a>
<a href="f.pdf">pdf</a><img src="/p.png" width="10"><img src="q.png" alt="Q" width="80"></main><footer>foot</footer></body>"""


def test_html_fields():
    p = html.parse(HTML, "https://e.example/dir/page")
    assert (p["title"], p["h1"], p["description"], p["language"], p["canonical"]) == ("A & B", "Head", "desc", "es", "https://e.example/canon")
    assert (p["schema_type"], p["schema_title"], p["schema_author"], p["schema_image"], p["schema_rating"]) == ("NewsArticle", "H", "Ann", "https://e.example/i.jpg", 4.5)
    assert p["content"] == "Head Head Short text bold Second one no pdf" and p["published_at"] == datetime(2024, 2, 3)
    assert [x["url"] for x in p["links"]] == ["https://e.example/nav", "https://e.example/a"]
    assert [x["url"] for x in p["images"]] == ["https://e.example/dir/q.png"]
    assert html.parse("", "")["content"] == "" and html.parse("<p" * 3000, "x")["title"] == ""


def test_main_text_drops_furniture():
    text = "This paragraph is long enough, with commas, to be the main text of the page. " * 4
    p = html.parse(f"<body><div class='sidebar'><p>{'side ' * 40}</p></div><div id=c><h1>T</h1><p>{text}</p><p>{text}</p></div></body>", "https://e.example/")
    assert "side" not in p["content"] and p["content"].count("long enough") == 8


def test_charsets():
    assert html.to_utf8("año".encode()) == html.to_utf8("año".encode("latin-1"), "text/html; charset=ISO-8859-1") == html.to_utf8("año".encode("cp1252")) == "año"


def test_rules():
    w = state.RequestWindow(2, 10)
    assert state.replay(w, [(0, 0), (5, 0), (9, 0), (10, 0), (11, 0), (12, 0)]) == [1, 1, 0, 1, 1, 0]
    assert state.replay(state.Cooldown(30), [(0, 429), (10, 200), (30, 200)]) == [1, 0, 1]
    assert state.replay(state.Backoff(), [(0, 429), (1, 503), (2, 200), (3, 429)] + [(4, 429)] * 6) == [4, 8, 0, 4, 8, 16, 32, 60, 60, 60]
    starts = state.replay(state.Polite(1, 2, 5), [(0, 0)] * 4)
    assert starts == [0, 1, 5, 6]
