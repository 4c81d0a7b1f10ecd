"""Full-text index, retrieval plans and ranking.

The index is two tables, built in one pass without a shuffle and meant to be written once (``write``), with the
postings sorted by term, so that the filters of a query reach the row groups of its terms:

* postings(term, id, w, n, d, at): weighted count of a term over the fields of a page, its plain count, the number
  of words of the page, repeated here so that scoring needs no join with all pages, and the term's places, numbered
  through within each field; only phrases read the places
* docs(id, d): number of words of a page over all fields

Words are stemmed by default, in the index and in the queries (``Index.stem``).

A query reads the postings of its terms only; document frequencies, lengths and the sums per page come from
partial aggregates; the best pages from a top-k, never from a full sort. Only the at most 500 candidates of the
best plan are ranked by the Python scorer, in Arrow batches.

Ids are taken to be unique. Pages with NULL or empty fields have fewer words; a page without words is in no posting.
Ties are broken by id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..sources import materialize

# Weights of the fields, and the constants of BM25.
WEIGHTS = {"title": 10.0, "h1": 8.0, "description": 5.0, "schema_title": 6.0, "schema_description": 4.0, "content": 1.0}
K1, B, FLOOR = 1.2, 0.75, 1e-6
CLICK = 50.0


#: Places are numbered through from here for each field.
FIELD_BITS = 27


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    stem: bool = True
    factors: tuple[float, ...] = tuple(WEIGHTS.values())
    _size: tuple[int, float] | None = None

    def write(self, path: str, parts: int = 64) -> None:
        """Postings by ranges of terms, sorted within, so that a term's filter reaches its row groups; lengths as they come."""
        self.postings.repartitionByRange(parts, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.docs.sparkSession.createDataFrame([(self.stem, list(self.factors))], "stem boolean, factors array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    def size(self) -> tuple[int, float]:
        """(pages, mean length), counted once."""
        if self._size is None:
            r = self.docs.agg(F.count("*").alias("n"), F.avg("d").alias("a")).first()
            self._size = (r["n"], r["a"] or 1.0)
        return self._size

    def term(self, word: str) -> str:
        """The term of the index for a plain word."""
        return X.STEM[word] if self.stem else word

    @staticmethod
    def read(spark, path: str) -> Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), meta["stem"], tuple(meta["factors"]))


def build(pages: DataFrame, key: str = "page_id", weights: dict[str, float] = WEIGHTS, stem: bool = True) -> Index:
    """Index over those of the weighted fields that the table has.

    A page's postings need its own words only: they are made where it is read, from tokens of native expressions.
    """
    have = [c for c in weights if c in pages.columns]
    factors = tuple(float(weights[c]) for c in have)
    tok = pages.select(F.col(key).alias("id"), *[X.tokens(F.col(c)).alias(f"f{i}") for i, c in enumerate(have)])
    docs = tok.select("id", sum((F.size(f"f{i}") for i in range(len(have))), F.lit(0)).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            owner, terms, ws, ns, ds, places = [], [], [], [], [], []
            for r, fields in enumerate(zip(*(part.column(f"f{i}").to_pylist() for i in range(len(factors))))):
                at: dict[str, list[int]] = {}
                w: dict[str, float] = {}
                for i, (words, factor) in enumerate(zip(fields, factors)):
                    for j, t in enumerate(words, i << FIELD_BITS):
                        if stem:
                            t = X.STEM[t]
                        got = at.get(t)
                        if got is None:
                            at[t], w[t] = [j], factor
                        else:
                            got.append(j)
                            w[t] += factor
                owner += [r] * len(at)
                terms += at
                ws += w.values()
                ns += map(len, at.values())
                ds += [sum(map(len, fields))] * len(at)
                places += at.values()
            offsets = pa.array(np.concatenate(([0], np.cumsum(ns, dtype="int64"))).astype("int32"))
            at_ = pa.ListArray.from_arrays(offsets, pa.array([x for p in places for x in p], "int32"))
            columns = [pa.array(terms, "string"), part.column("id").take(pa.array(owner, "int32")), pa.array(ws, "double"), pa.array(ns, "int64"), pa.array(ds, "int32"), at_]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "w", "n", "d", "at"])

    kind = tok.schema["id"].dataType.simpleString()
    return Index(tok.mapInArrow(run, f"term string, id {kind}, w double, n bigint, d int, at array<int>"), docs, stem, factors)


def vocabulary(index: Index) -> DataFrame:
    """(term, doc, cnt): pages and places of each term."""
    return index.postings.groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


def idf_map(index: Index, terms: list[str]) -> dict[str, float]:
    """ln(N / df) of the terms; ln N for unknown ones."""
    n = max(1, index.size()[0])
    asked = [index.term(t) for t in terms]
    df = {r["term"]: r["c"] for r in index.postings.where(F.col("term").isin(asked)).groupBy("term").agg(F.count("*").alias("c")).collect()}
    return {t: math.log(n / df[a]) if df.get(a) else math.log(n) for t, a in zip(terms, asked)}


def bm25(index: Index, terms: list[str], need: int | None = None, prefix: bool = False) -> DataFrame:
    """(id, score): pages with at least ``need`` of the terms (all by default, 1 for any).

    With ``prefix``, a term of four letters or more also counts words that begin with it, as one more query term.
    """
    exact = list(dict.fromkeys(map(index.term, terms)))
    starts = list(dict.fromkeys(index.term(t) for t in terms if len(t) >= 4)) if prefix else []
    hits = index.postings.where(F.col("term").isin(exact)).select(F.col("term").alias("q"), "id", "w", "d")
    if starts:
        cond = F.lit(False)
        for t in starts:
            cond = cond | F.col("term").startswith(t)
        begun = index.postings.where(cond).select("id", "w", "d", F.explode(F.filter(F.array(*[F.lit(t) for t in starts]), lambda t: F.col("term").startswith(t))).alias("t"))
        hits = hits.unionByName(begun.groupBy(F.concat("t", F.lit("*")).alias("q"), "id").agg(F.sum("w").alias("w"), F.max("d").alias("d")))
    nn, avg_d = index.size()
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    # One row for each term of the query.
    rows = hits.join(F.broadcast(df.select("q", _idf(nn, F.col("df")).alias("idf"))), "q")
    part = F.col("idf") * _saturated(avg_d)
    least = (need if need is not None else len(exact)) if not prefix else 1
    return rows.groupBy("id").agg(F.sum(part).alias("score"), F.countDistinct("q").alias("k")).where(F.col("k") >= least).select("id", "score")


def phrase_ids(index: Index, words: list[str]) -> DataFrame:
    """(id, w, d): pages that hold the words side by side in one field, with the weighted count, from the places in the postings."""
    terms = [index.term(t) for t in words]
    # One row for each word of the query and page; no page is gathered beyond that.
    rows = index.postings.where(F.col("term").isin(list(dict.fromkeys(terms)))).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("m"), F.max("d").alias("d"))
    starts = None
    for i, t in enumerate(terms):
        at = F.transform(F.col("m")[t], lambda x: x - i)  # noqa: B023
        starts = at if starts is None else F.array_intersect(starts, at)
    factor = F.array(*[F.lit(x) for x in index.factors])
    weight = F.aggregate("starts", F.lit(0.0), lambda a, x: a + F.get(factor, F.shiftright(x, FIELD_BITS)))
    found = rows.where(F.size("m") == len(set(terms))).select("id", "d", starts.alias("starts")).where(F.size("starts") > 0)
    return found.select("id", weight.alias("w"), "d")


def bm25_phrase(index: Index, words: list[str]) -> DataFrame:
    """(id, score): the phrase taken as one query term."""
    if not words:
        return index.docs.select("id", F.lit(0.0).alias("score")).limit(0)
    nn, avg_d = index.size()
    hits = phrase_ids(index, words)
    # The document frequency is one number, from the same few postings.
    df = hits.agg(F.count("*").alias("df"))
    return hits.crossJoin(F.broadcast(df)).select("id", (_idf(nn, F.col("df")) * _saturated(avg_d)).alias("score"))


def _idf(nn: int, df: Column) -> Column:
    raw = F.log((F.lit(float(nn)) - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, FLOOR).otherwise(raw)


def _saturated(avg_d: float) -> Column:
    """w grown with saturation, set off against the length d."""
    return F.col("w") * (K1 + 1) / (F.col("w") + K1 * (1 - B + B * F.col("d") / F.lit(avg_d)))


# --- queries ------------------------------------------------------------------------------------------------

# Words that ask for news, and month names.
FRESH = frozenset("noticia noticias news actualidad reciente recientes ultimo ultimos ultima ultimas hoy today latest".split())
MONTHS = frozenset("enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre january february march april may june july august september october november december".split())
_YEAR = re.compile(r"\b(?:199\d|20\d\d|2100)\b")
_DATE = re.compile(r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b")


@dataclass
class Query:
    raw: str
    normal: str
    tokens: list[str]
    phrase: list[str]
    domain: str = ""
    nav_term: str = ""
    platform: str = ""
    site_type: str = ""
    fresh: bool = False
    dated: bool = False
    navigational: bool = False
    idf: dict[str, float] = field(default_factory=dict)

    def by_weight(self) -> list[str]:
        """Tokens by idf, rounded to three places, then by length, then as they stand."""
        return sorted(self.tokens, key=lambda t: (-round(self.idf.get(t, 0.0), 3), -len(t)))


def domain_like(query: str) -> str:
    """The domain that a query spells out, or ''."""
    q = query.strip().lower()
    if "://" in q:
        q = re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*).*$", r"\1", q)
    elif "." in q and " " not in q:
        q = re.split(r"[/?#:]", q)[0]
    q = q.removeprefix("www.")
    return q.strip(". /") if "." in q else ""


def parse(query: str, platforms: frozenset[str] = frozenset(), site_types: frozenset[str] = frozenset()) -> Query:
    """Words and intents of a query. Platform and site-type words count at either end only, and only one of a kind."""
    normal = X.plain_str(query)
    words = normal.split()
    edge = {0, len(words) - 1}
    found = [w for i, w in enumerate(words) if i in edge and w in platforms]
    kinds = [w for i, w in enumerate(words) if i in edge and w in site_types and w not in platforms]
    platform = found[0] if len(found) == 1 else ""
    site_type = kinds[0] if len(kinds) == 1 and not platform else ""
    media = any(w in X.MEDIA_WORDS for w in words)
    stop = X.STOPWORDS - X.TITLE_WORDS if media else X.STOPWORDS
    sharp = words if len(words) <= 1 else [w for w in words if w not in stop] or words
    aside = {platform, site_type} - {""}
    domain = domain_like(query)
    nav = platform or (re.sub(r"\W", "", domain.split(".")[-2]) if domain.count(".") else "")
    if platform and domain.endswith("." + platform):
        domain = ""
    tokens = [w for w in sharp if w not in aside] or sharp
    phrase = [w for w in words if w not in aside] or words
    fresh = any(w in FRESH for w in words) or site_type in ("noticias", "news")
    dated = bool(_YEAR.search(query) or _DATE.search(query)) or any(w in MONTHS for w in words)
    navigational = bool(domain or platform or len(tokens) == 1 or (len(tokens) == 2 and nav))
    if (site_type and not platform and not domain) or (fresh and not platform):
        navigational = False
    return Query(query, normal, tokens, phrase, domain, nav, platform, site_type, fresh, dated, navigational)


def parsed(queries: DataFrame, platforms: frozenset[str] = frozenset(), site_types: frozenset[str] = frozenset()) -> DataFrame:
    """``queries(query)`` with what ``parse`` says of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [parse(x, platforms, site_types) for x in pdf["query"]]
            yield pd.DataFrame({"query": pdf["query"], "tokens": [x.tokens for x in q], "phrase": [x.phrase for x in q], "domain": [x.domain for x in q], "platform": [x.platform for x in q], "site_type": [x.site_type for x in q], "fresh": [x.fresh for x in q], "dated": [x.dated for x in q], "navigational": [x.navigational for x in q]})

    return queries.select("query").where("query is not null").mapInPandas(run, "query string, tokens array<string>, phrase array<string>, domain string, platform string, site_type string, fresh boolean, dated boolean, navigational boolean")


def candidate_limit(limit: int, offset: int = 0) -> int:
    return min(500, max(300, offset + 8 * limit + 30))


def _ordered(scored: DataFrame, pages: DataFrame, q: Query, limit: int, key: str) -> DataFrame:
    """Top pages of a plan; pages of the wanted domain are lifted so that they survive the cut."""
    want = q.domain or q.nav_term
    if not want:
        return scored.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "score")
    # Only the pages of the wanted domain are joined, not all that were scored.
    dom = F.lower("domain")
    lifted = pages.where((dom == want) | dom.startswith(want + ".")).select(F.col(key).alias("id"), F.when(dom == want, 30.0).otherwise(15.0).alias("lift"))
    rows = scored.join(lifted, "id", "left")
    return rows.orderBy((F.col("score") + F.coalesce("lift", F.lit(0.0))).desc(), "id").limit(limit).select("id", "score")


def plan_exact(index, pages, q: Query, limit: int, key: str = "page_id") -> DataFrame:
    return _ordered(bm25(index, q.tokens), pages, q, limit, key)


def plan_core(index, pages, q: Query, limit: int, key: str = "page_id") -> DataFrame:
    return _ordered(bm25(index, q.by_weight()[:2]), pages, q, limit, key)


def plan_relaxed(index, pages, q: Query, limit: int, key: str = "page_id") -> DataFrame:
    return _ordered(bm25(index, q.by_weight()[:4], need=1, prefix=True), pages, q, limit, key)


def plan_phrase(index, pages, q: Query, limit: int, key: str = "page_id") -> DataFrame:
    return _ordered(bm25_phrase(index, q.phrase), pages, q, limit, key)


def recency_lift(published: Column, as_of: Column) -> Column:
    """60, 45, 25, 10 for a page published within 1, 7, 30, 90 days."""
    age = F.datediff(as_of, published)
    return F.when(age <= 1, 60.0).when(age <= 7, 45.0).when(age <= 30, 25.0).when(age <= 90, 10.0).otherwise(0.0)


def plan_recent(scored: DataFrame, pages: DataFrame, as_of: datetime, limit: int, key: str = "page_id") -> DataFrame:
    """The best of the pages published in the last 180 days."""
    now = F.lit(as_of)
    rows = scored.join(pages.select(F.col(key).alias("id"), "published_at").where(F.col("published_at").isNotNull() & (F.datediff(now, "published_at") <= 180)), "id")
    return rows.orderBy((F.col("score") + recency_lift(F.col("published_at"), now)).desc(), "id").limit(limit).select("id", "score")


def plan_elsewhere(scored: DataFrame, pages: DataFrame, domain: str, limit: int, key: str = "page_id") -> DataFrame:
    """The best outside one domain and whatever ends with it."""
    rows = scored.join(pages.select(F.col(key).alias("id"), F.lower("domain").alias("dom")).where(~F.col("dom").endswith(domain)), "id")
    return rows.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "score")


def plan_navigational(pages: DataFrame, q: Query, limit: int, as_of: datetime, lang: str = "", key: str = "page_id") -> DataFrame:
    """Pages whose address or headings hold the term, by a weighted sum of simple tests."""
    term = q.nav_term or q.normal
    words = q.raw.strip().lower() or term
    exact = q.domain or term
    dom, url = F.lower("domain"), F.lower("url")
    has = lambda c, s: F.coalesce(F.lower(c).contains(s), F.lit(False))
    when = lambda cond, v: F.when(cond, v).otherwise(0.0)
    tests = [(dom == exact, 1500.0), (has("domain", term), 800.0), (url == F.concat(F.lit("https://"), dom, F.lit("/")), 2000.0), (url.rlike(r"^https://[^/]+/[a-z][a-z]$"), 1200.0), (has("url", term), 220.0),
             (has("title", words), 160.0), (has("h1", words), 120.0), (F.regexp_count("url", F.lit("/")) <= 3, 500.0)]
    age = F.datediff(F.lit(as_of), "crawled_at")
    score = sum((when(c, v) for c, v in tests), F.lit(0.0)) + F.coalesce(F.greatest(F.lit(0.0), 20.0 - 0.2 * age), F.lit(0.0))
    if lang:
        score = score + when(F.col("language") == lang, 300.0)
    rows = pages.where((dom == exact) | has("domain", term) | has("url", term) | has("title", words) | has("h1", words))
    return rows.select(F.col(key).alias("id"), score.alias("score"), "crawled_at").orderBy(F.col("score").desc(), F.col("crawled_at").desc(), "id").limit(limit).select("id", "score")


def clicks_added(scored: DataFrame, pages: DataFrame, clicks: DataFrame, q: Query, key: str = "page_id") -> DataFrame:
    """50 points for each click on the page for this query; clicks(query, url, n) are keyed by the plain query."""
    mine = clicks.where(F.col("query") == q.normal).select("url", F.col("n").alias("clicks"))
    rows = scored.join(pages.select(F.col(key).alias("id"), "url"), "id").join(mine, "url", "left")
    return rows.select("id", (F.col("score") + CLICK * F.coalesce("clicks", F.lit(0))).alias("score"))


def merge(plans: list[tuple[str, DataFrame]]) -> DataFrame:
    """Best score of each page; the earlier plan on equal scores. Gives (id, score, mode)."""
    rows = None
    for i, (mode, df) in enumerate(plans):
        part = df.select("id", "score", F.lit(mode).alias("mode"), F.lit(i).alias("plan"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("id").agg(F.max_by(F.struct("score", "mode"), F.struct("score", -F.col("plan"))).alias("b"))
    return best.select("id", "b.score", "b.mode")


def enrich(q: Query, index: Index, domains: DataFrame | None = None) -> Query:
    """The query with what the tables say: a known domain for neighbouring words, known halves for unknown compounds.

    ``domains`` has a column domain. One small job for each; words of the query bound what is read.
    """
    tokens = q.tokens
    if domains is not None and not q.domain and tokens:
        labels = list(dict.fromkeys([*(a + b for a, b in zip(tokens, tokens[1:])), "".join(tokens)]))
        label = U.root_label(F.lower("domain"))
        hit = domains.where(label.isin(labels)).agg(F.min("domain").alias("d")).first()["d"]
        if hit:
            q = replace(q, domain=hit.lower(), nav_term=q.nav_term or hit.lower().split(".")[-2], navigational=not q.fresh)
    long = [t for t in tokens if len(t) >= 7]
    if long:
        cuts = {t: [(t[:i], t[i:]) for i in range(len(t) - 3, 2, -1)] for t in long}
        asked = {index.term(w): None for t in long for w in (t, *(x for c in cuts[t] for x in c))}
        known = {r["term"] for r in index.postings.where(F.col("term").isin(list(asked))).select("term").distinct().collect()}
        halves = {t: next((list(c) for c in cuts[t] if all(index.term(x) in known for x in c)), [t]) for t in long if index.term(t) not in known}
        q = replace(q, tokens=[x for t in tokens for x in halves.get(t, [t])])
    return q


#: The plans from strict to loose, two at a time: each step is one job.
CASCADE = ((("phrase", plan_phrase), ("exact", plan_exact)), (("core", plan_core), ("relaxed", plan_relaxed)))


def retrieve(index: Index, pages: DataFrame, q: Query, limit: int, offset: int, as_of: datetime, lang: str = "", clicks: DataFrame | None = None, key: str = "page_id") -> tuple[DataFrame, int]:
    """Candidates of the plans from strict to loose, stopping early, and the number of matches of the last plan.

    A plan gives at most 500 rows; those of a step are collected together to count the pool.
    """
    spark = pages.sparkSession
    want = candidate_limit(limit, offset)
    q.idf = q.idf or idf_map(index, q.tokens)
    enough = min(want // 2, 100)
    order = ["phrase", "exact", "core", "relaxed", "recent", "elsewhere", "navigational"]
    rows: list = []
    seen: set = set()
    total = 0

    def run(plans: list[tuple[str, DataFrame]]) -> dict[str, list]:
        both = reduce(DataFrame.union, [df.select(F.lit(mode).alias("mode"), "id", F.col("score").cast("double").alias("score")) for mode, df in plans])
        out: dict[str, list] = {mode: [] for mode, _ in plans}
        for r in both.collect():
            out[r["mode"]].append((r["id"], r["score"]))
        return out

    def added(df: DataFrame) -> DataFrame:
        return df if clicks is None else clicks_added(df, pages, clicks, q, key)

    extra = []
    if q.fresh and not q.dated and q.tokens:
        extra.append(("recent", plan_recent(bm25_phrase(index, q.phrase), pages, as_of, min(want, 300), key)))
    if q.platform and q.tokens:
        extra.append(("elsewhere", plan_elsewhere(bm25_phrase(index, q.phrase), pages, q.domain or f"{q.platform}.com", max(30, min(want // 3, 100)), key)))
    for i, step in enumerate(CASCADE if q.tokens else ()):
        got = run([(mode, added(plan(index, pages, q, want, key))) for mode, plan in step] + (extra if i == 0 else []))
        for mode, _ in extra if i == 0 else ():
            rows += [(x, s, mode) for x, s in got[mode]]
        for mode, _ in step:
            if got[mode] and len(seen) < enough:
                matches = {"phrase": lambda: phrase_ids(index, q.phrase), "exact": lambda: bm25(index, q.tokens), "core": lambda: bm25(index, q.by_weight()[:2]), "relaxed": lambda: bm25(index, q.by_weight()[:4], 1, True)}[mode]
                total = matches().count() if len(got[mode]) == want else len(got[mode])
                rows += [(x, s, mode) for x, s in got[mode]]
                seen |= {x for x, _ in got[mode]}
        if len(seen) >= enough:
            break
    if q.navigational and len(seen) < 30:
        rows += [(x, s, "navigational") for x, s in run([("navigational", plan_navigational(pages, q, min(want, 60), as_of, lang, key))])["navigational"]]
    best: dict = {}
    for x, s, mode in rows:
        rank = (s, -order.index(mode))
        if x not in best or rank > best[x][0]:
            best[x] = (rank, s, "phrase" if mode == "elsewhere" else mode)
    kind = pages.schema[key].dataType.simpleString()
    return spark.createDataFrame([(x, s, mode) for x, (_, s, mode) in best.items()], f"id {kind}, score double, mode string"), total


# --- ranking ------------------------------------------------------------------------------------------------

# Bonus of each plan.
MODE_BONUS = {"navigational": 120.0, "phrase": 180.0, "exact": 140.0, "core": 100.0, "relaxed": 60.0, "recent": 220.0}
# Weights of the phrase scores, of the averaged fields, and of the parts of the total by intent.
PHRASE_WEIGHTS = {"title": 560.0, "h1": 360.0, "h2": 360.0, "description": 240.0, "domain": 260.0, "url": 90.0}
FIELD_WEIGHTS = {"title": 3.0, "h1": 2.0, "h2": 2.0, "description": 2.0}
PARTS = {True: (0.30, 0.20, 0.35, 0.05, 0.10), False: (0.50, 0.15, 0.10, 0.15, 0.10)}
# Points for news by age in days.
NEWS = ((1, 12000.0), (3, 10000.0), (7, 8000.0), (14, 5000.0), (30, 2000.0), (90, -1000.0), (180, -5000.0), (365, -10000.0), (730, -16000.0), (math.inf, -22000.0))


def authority(pagerank: Column, referring: Column) -> Column:
    """Saturating score of the rank, else of the referring domains."""
    pr, rd = F.coalesce(pagerank, F.lit(0.0)), F.coalesce(referring, F.lit(0))
    return F.when(pr > 0, F.least(F.log1p(pr), F.lit(4.0)) * 100).when(rd > 0, F.least(F.log1p(rd), F.lit(3.0)) * 70).otherwise(0.0)


def _days(t: Column, as_of: Column) -> Column:
    """Days from a time to another, with their fraction."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 86_400_000_000


def freshness(crawled: Column, published: Column, as_of: Column) -> Column:
    """50 points, less 0.15 a day since publication, or else the crawl."""
    t = F.coalesce(published, crawled)
    days = _days(t, as_of)
    return F.when(t.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 50 - days * 0.15))


def news_recency(published: Column, as_of: Column) -> Column:
    days = _days(published, as_of)
    out = F.when(published.isNull(), -4000.0).when(days < 0, 12000.0)
    for limit, points in NEWS[:-1]:
        out = out.when(days <= limit, points)
    return out.otherwise(NEWS[-1][1])


def coverage(words: list[str], idf: dict[str, float], field_words: list[str]) -> tuple[float, float, int, list[bool]]:
    """(mean similarity, share matched, exact matches, matched flags) of query words, weighted by idf."""
    flags = [False] * len(words)
    if not words or not field_words:
        return 0.0, 0.0, 0, flags
    weights = [idf.get(w) if (idf.get(w) or 0) > 0 else 1.0 for w in words]
    best = [max(X.token_similarity(w, t) for t in field_words) for w in words]
    flags = [b >= 0.72 for b in best]
    whole = sum(weights)
    return sum(b * w for b, w in zip(best, weights)) / whole, sum(w for f, w in zip(flags, weights) if f) / whole, sum(b == 1.0 for b in best), flags


def term_frequency(words: list[str], idf: dict[str, float], fields: dict[str, list[str]]) -> float:
    """Capped counts of the query words in the headings, weighted by field and idf."""
    total = 0.0
    for name, weight in FIELD_WEIGHTS.items():
        cap = 4 if name == "title" else 5
        for w in dict.fromkeys(words):
            v = idf.get(w) or 0
            total += min(fields.get(name, []).count(w), cap) * weight * (v if v > 0 else 1.0)
    return total


def field_scores(pages: DataFrame, words: list[str], idf: dict[str, float], key: str = "page_id") -> DataFrame:
    """(page_id, coverage of the title, tf over the headings) of each page for the words of a query."""
    names = [c for c in FIELD_WEIGHTS if c in pages.columns]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [dict(zip(names, r)) for r in zip(*(pdf[n].map(list) for n in names))]
            got = [coverage(words, idf, list(dict.fromkeys(r["title"]))) for r in rows]
            yield pd.DataFrame({"k": pdf["k"], "coverage": [{"mean": c[0], "share": c[1], "exact": c[2]} for c in got], "tf": [term_frequency(words, idf, r) for r in rows]})

    rows = pages.select(F.col(key).cast("string").alias("k"), *[X.tokens(F.col(n)).alias(n) for n in names])
    out = rows.mapInPandas(run, "k string, coverage struct<mean: double, share: double, exact: int>, tf double")
    return out.withColumn(key, F.col("k").cast(kind)).drop("k")


class Ranker:
    """Score of one candidate for one query; the parts and their order follow the documented composition."""

    def __init__(self, q: Query, lang: str = "", secondary: str = "en", language_boost: float = 3000.0, secondary_boost: float = 1500.0) -> None:
        self.q, self.lang, self.secondary, self.boosts = q, lang, secondary, (language_boost, secondary_boost)

    def content(self, norm: dict[str, str], site_forms: list[str]) -> float:
        q = self.q
        split = {k: v.split() for k, v in norm.items()}
        unique = {k: list(dict.fromkeys(v)) for k, v in split.items()}
        unique["domain"] = list(dict.fromkeys(w for s in site_forms for w in s.split()))
        phrase = {k: X.phrase_score(q.normal, q.tokens, norm.get(k, ""), unique.get(k, [])) for k in PHRASE_WEIGHTS if k != "domain"}
        phrase["domain"] = max((X.phrase_score(q.normal, q.tokens, s, unique["domain"] if i == 0 else s.split()) for i, s in enumerate(site_forms)), default=0.0)
        score = sum(PHRASE_WEIGHTS[k] * v for k, v in phrase.items())
        cov = {k: coverage(q.tokens, q.idf, unique.get(k, [])) for k in PHRASE_WEIGHTS}
        whole = sum(FIELD_WEIGHTS.values())
        score += 430 * sum(w * cov[k][0] for k, w in FIELD_WEIGHTS.items()) / whole + 180 * sum(w * cov[k][1] for k, w in FIELD_WEIGHTS.items()) / whole
        score += 200 * cov["domain"][0] + 60 * cov["domain"][1] + 130 * cov["url"][0] + 40 * cov["url"][1]
        score += 55 * term_frequency(q.tokens, q.idf, split)
        if q.tokens and cov["title"][2] == len(q.tokens):
            score += 180
        if len(q.tokens) >= 2:
            weights = [q.idf.get(t) if (q.idf.get(t) or 0) > 0 else 1.0 for t in q.tokens]
            hit = [any(cov[k][3][i] for k in ("title", "h1", "h2", "description", "url")) for i in range(len(q.tokens))]
            ratio = sum(w for w, h in zip(weights, hit) if h) / sum(weights)
            if ratio < 0.5:
                score *= 2 * ratio
        return score

    def brand_matches(self, label: str) -> int:
        words = self.q.tokens + ([self.q.site_type] if len(self.q.site_type) >= 3 else [])
        return sum(len(t) >= 3 and t in label and len(t) * 100 // len(label) >= 40 for t in words) if label else 0

    def address(self, url: str, host: str, label: str, homepage: bool, root: bool) -> float:
        q, score = self.q, 0.0
        if not q.navigational and q.tokens:
            parts = [p for p in re.split(r"[/\-_.?=&]", url.lower().strip("/"))]
            hit = sum(any(t in p or (p and p in t) for p in parts) for t in q.tokens if len(t.encode()) >= 3)
            score += 200 * hit + (300 if hit and hit == len(q.tokens) else 0)
            depth = url.count("/") - 2
            score += 60 if depth <= 1 else 30 if depth <= 2 else 0
        n = self.brand_matches(label)
        score += 400 * n + (800 if n >= 2 else 0)
        if q.navigational and homepage:
            score += 200 if root else 100
        return score

    def navigational(self, domain: str, label: str, root: bool, homepage: bool, profile: bool, phrase: float) -> float:
        want = self.q.domain or self.q.nav_term
        if profile:
            return 0.0
        out = 0.0
        if want and domain.removeprefix("www.") == want:
            out += 14000.0 if homepage else 8000.0
        elif want and root and label == want:
            out += 11000.0 if homepage else 6000.0
        if homepage and phrase >= 0.75:
            out += 15000.0 if root else 8000.0
        return out

    def brand(self, label: str) -> float:
        n = self.brand_matches(label)
        words = len(self.q.tokens) + (len(self.q.site_type) >= 3)
        return n * 2000.0 + (5000.0 if n == words else 0.0) if n >= 2 else 0.0

    def parts(self, r) -> dict[str, float]:
        """Parts of the total that rest on the address and the plan."""
        host, label = r.host or "", r.label or ""
        root, home = host == (r.registered or ""), bool(r.homepage)
        forms = [X.plain_str(x or "") for x in (r.domain, r.registered, r.label)]
        words = list(dict.fromkeys(w for s in forms for w in s.split()))
        profile = any(f"/{x}/" in (r.url or "").lower() for x in PROFILES)
        phrase = X.phrase_score(self.q.normal, self.q.tokens, forms[0], words)
        return {"address": self.address(r.url or "", host, label, home, root), "brand": self.brand(label), "navigational": self.navigational(r.domain or "", label, root, home, profile, phrase), "bonus": MODE_BONUS.get(r.mode, 0.0), "user": min(r.score, 500.0) * 0.1}

    def total(self, r) -> float:
        """``r``: a row with the candidate's fields and the native parts (authority, freshness, address forms)."""
        q = self.q
        norm = {k: X.plain_str(getattr(r, k, None) or "") for k in ("title", "h1", "h2", "description", "url", "domain")}
        forms = [norm["domain"], X.plain_str(r.registered or ""), X.plain_str(r.label or "")]
        a, b, c, d, e = PARTS[q.navigational]
        own = self.parts(r)
        score = a * self.content(norm, forms) + b * r.authority + c * own["address"] + d * r.freshness + e * own["user"]
        score += r.score * 40.0 + own["bonus"]
        if self.lang and r.language == self.lang:
            score += self.boosts[0]
        elif self.lang and self.lang != self.secondary and r.language == self.secondary:
            score += self.boosts[1]
        score += own["navigational" if q.navigational else "brand"]
        if q.site_type in ("noticias", "news"):
            score += r.freshness * 40 + (0.0 if q.dated else r.news)
        return score


# First parts of the addresses of profiles.
PROFILES = ("user", "profile", "u", "people", "member", "author", "accounts")


def _seen(candidates: DataFrame, pages: DataFrame, as_of: datetime, key: str) -> DataFrame:
    """Candidates with their fields and native parts."""
    u, now = F.col("url"), F.lit(as_of)
    keep = [c for c in ("url", "title", "h1", "h2", "description", "domain", "language", "crawled_at") if c in pages.columns]
    return candidates.join(pages.withColumnRenamed(key, "id"), "id").select(
        "id", "score", "mode", *keep, U.domain(u).alias("host"), U.registered_domain(U.domain(u)).alias("registered"), U.root_label(U.domain(u)).alias("label"), U.is_homepage(u).alias("homepage"),
        authority(F.col("pagerank"), F.col("referring_domains")).alias("authority"), freshness(F.col("crawled_at"), F.col("published_at"), now).alias("freshness"), news_recency(F.col("published_at"), now).alias("news"),
    )


def final_order() -> list[Column]:
    """Order of results: rank, homepages first, the newest crawl, then by address and id."""
    return [F.col("rank").desc(), F.col("homepage").desc(), F.col("crawled_at").desc_nulls_last(), F.col("url"), F.col("id")]


def rank_parts(candidates: DataFrame, pages: DataFrame, q: Query, as_of: datetime, key: str = "page_id") -> DataFrame:
    """(id, address, brand, navigational, bonus, user): those parts of the ranker's total for each candidate."""
    rows = _seen(candidates, pages, as_of, key)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(q)
        for pdf in batches:
            yield pd.DataFrame([{"id": r.id, **ranker.parts(r)} for r in pdf.itertuples()], columns=["id", "address", "brand", "navigational", "bonus", "user"])

    return rows.mapInPandas(run, f"id {kind}, address double, brand double, navigational double, bonus double, user double")


def rank(candidates: DataFrame, pages: DataFrame, q: Query, as_of: datetime, lang: str = "", key: str = "page_id") -> DataFrame:
    """(id, url, domain, language, rank, pos): candidates in their final order."""
    rows = _seen(candidates, pages, as_of, key)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(q, lang)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "domain": pdf["domain"], "language": pdf["language"], "homepage": pdf["homepage"], "crawled_at": pdf["crawled_at"], "rank": [ranker.total(r) for r in pdf.itertuples()]})

    scored = rows.mapInPandas(run, f"id {kind}, url string, domain string, language string, homepage boolean, crawled_at {dict(rows.dtypes)["crawled_at"]}, rank double")
    # At most a few hundred rows, so one window over all of them is fine.
    return scored.withColumn("pos", F.row_number().over(Window.orderBy(*final_order())))


def promote_language(ranked: DataFrame, lang: str, secondary: str = "en") -> DataFrame:
    """In each registered domain, the first result in the best language takes the domain's first place."""
    site = F.coalesce(F.nullif(U.registered_domain(F.col("domain")), F.lit("")), "domain")
    score = F.when(F.col("language") == lang, 2).when(F.col("language") == secondary, 1).otherwise(0)
    rows = ranked.withColumn("site", site).withColumn("ls", score)
    per = Window.partitionBy("site")
    rows = rows.withColumn("first", F.min("pos").over(per)).withColumn("top", F.max("ls").over(per))
    rows = rows.withColumn("best", F.min(F.when((F.col("ls") == F.col("top")) & (F.col("top") > 0), F.col("pos"))).over(per))
    slot = F.when(F.col("pos") == F.col("best"), F.col("first") - 0.5).otherwise(F.col("pos"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(slot, "pos"))).select(*ranked.columns)


def allowed(pos: int) -> int:
    """Results of one domain that may stand before a position."""
    return 1 if pos < 3 else 2 if pos < 10 else 3


def diversify(domains: list[str]) -> list[int]:
    """New order of results: no domain takes more places than allowed; the others are put off, then filled in."""
    waiting, out, count = list(range(len(domains))), [], {}
    if len(waiting) <= 3:
        return waiting
    while waiting:
        later = []
        for i in waiting:
            if count.get(domains[i], 0) < allowed(len(out)):
                out.append(i)
                count[domains[i]] = count.get(domains[i], 0) + 1
            else:
                later.append(i)
        if len(later) == len(waiting):
            return out + later
        waiting = later
    return out


def diversified(ranked: DataFrame) -> DataFrame:
    """``ranked`` with positions after ``diversify``; an ordered fold over a few hundred rows."""

    ranked_columns = list(ranked.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        pdf = pdf.iloc[diversify(pdf["domain"].fillna("").tolist())].reset_index(drop=True)
        pdf["pos"] = pd.Series(range(1, len(pdf) + 1), dtype="int32")
        return pdf

    return ranked.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: run(pdf[ranked_columns]), ranked.schema)


def filtered(ranked: DataFrame, pages: DataFrame, domain: str = "", schema_type: str = "", key: str = "page_id") -> DataFrame:
    """Results of one domain and of one type, whatever the case of their letters."""
    if domain:
        ranked = ranked.where(F.lower("domain") == domain.lower())
    if schema_type:
        ranked = ranked.join(pages.where(F.lower("schema_type") == schema_type.lower()).select(F.col(key).alias("id")), "id", "left_semi")
    return ranked


def bodies(pages: DataFrame, key: str = "page_id", body_chars: int = 4000, snippet_chars: int = 240) -> DataFrame:
    """(id, body, snippet) as results show them; joined to the page of results only."""
    text = F.coalesce(F.nullif("description", F.lit("")), "content")
    return pages.select(F.col(key).alias("id"), F.left("content", F.lit(body_chars)).alias("body"), F.left(text, F.lit(snippet_chars)).alias("snippet"))


def user_points(score: Column) -> Column:
    """The user's signal of a plan's score with its clicks."""
    return F.least(score, F.lit(500.0)) * 0.1


def search(index: Index, pages: DataFrame, query: str, as_of: datetime, limit: int = 10, offset: int = 0, lang: str = "", domain: str = "", schema_type: str = "", clicks: DataFrame | None = None, platforms: frozenset[str] = frozenset(), site_types: frozenset[str] = frozenset(), key: str = "page_id", domains: DataFrame | None = None) -> DataFrame:
    """One page of results: (id, url, domain, language, rank, pos, snippet)."""
    q = enrich(parse(query, platforms, site_types), index, domains)
    found, _ = retrieve(index, pages, q, limit, offset, as_of, lang, clicks, key)
    ranked = rank(found, pages, q, as_of, lang, key)
    if lang:
        ranked = promote_language(ranked, lang)
    ranked = filtered(ranked, pages, domain, schema_type, key)
    if not domain:
        ranked = diversified(ranked)
    page = ranked.orderBy("pos").offset(offset).limit(limit)
    return page.join(bodies(pages, key).select("id", "snippet"), "id", "left").select("id", "url", "domain", "language", "rank", "pos", "snippet")


def search_images(images: DataFrame, query: str, limit: int = 20, offset: int = 0, key: str = "image_id", stem: bool = True) -> DataFrame:
    """Images by BM25 over alt text, title and context, all fields alike; any word or beginning counts."""
    index = build(images, key, {"alt_text": 1.0, "title": 1.0, "context": 1.0}, stem)
    # Read several times below, so it is made once.
    index.postings = materialize(index.postings)
    q = parse(query)
    q = replace(q, idf=idf_map(index, q.tokens))
    return bm25(index, q.by_weight()[:4], 1, True).orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)
