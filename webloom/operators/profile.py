"""Interest profile: terms from queries and clicks, reputations of domains, and the score they give a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .frontier import DEPTH_K, static_score

ANCHOR, ADDRESS, SOURCE_TITLE, REPUTATION = 40.0, 30.0, 20.0, 15.0


def click_counts(clicks: DataFrame) -> DataFrame:
    """(query, url, clicks): clicks by plain query; queries without words are left out."""
    return clicks.select(X.plain(F.col("query")).alias("query"), "url").where("query <> ''").groupBy("query", "url").agg(F.count("*").alias("clicks"))


def interest_terms(queries: DataFrame, clicks: DataFrame, manual: DataFrame | None = None, click_weight: float = 1.0) -> DataFrame:
    """(term, source, weight): 1 for each word of a query, ``click_weight`` for each word of a clicked query; manual weights replace."""
    q = queries.select(F.explode(X.interest_tokens(F.col("query"))).alias("term"), F.lit("query").alias("source"), F.lit(1.0).alias("w"))
    c = clicks.select(F.explode(X.interest_tokens(F.col("query"))).alias("term"), F.lit("click").alias("source"), F.lit(click_weight).alias("w"))
    rows = q.unionByName(c).groupBy("term", "source").agg(F.sum("w").alias("weight"))
    return rows if manual is None else rows.unionByName(manual.groupBy("term").agg(F.max_by("weight", "ts").alias("weight")).select("term", F.lit("manual").alias("source"), "weight"))


def reputations(clicks: DataFrame, click_weight: float = 1.0) -> DataFrame:
    """(domain, score, pages_count): half a click weight for each click on the domain."""
    return clicks.select(U.domain(F.col("url")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.sum(F.lit(0.5 * click_weight)).alias("score"), F.count("*").alias("pages_count"))


def profile(terms: DataFrame) -> DataFrame:
    """(term, weight): weights over all sources."""
    return terms.groupBy("term").agg(F.sum("weight").alias("weight"))


def relevance(links: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """(id, relevance): weights of the profile terms in anchor, address and source title.

    A word that is a term counts in full. Any other word counts half of the heaviest term that it holds or that
    holds it. Both are equi-joins: a held pair shares a run of three letters, so candidates meet on those, by
    distinct words only, and are then compared.
    """
    parts = [("anchor", ANCHOR), ("url", ADDRESS), ("title", SOURCE_TITLE)]
    words = None
    for c, w in parts:
        rows = links.select(F.col(key).alias("id"), F.explode(X.interest_tokens(F.coalesce(F.col(c), F.lit("")))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n")).withColumn("w", F.lit(w) * F.col("n"))
        words = rows if words is None else words.unionByName(rows)
    words = words.groupBy("id", "word").agg(F.sum("w").alias("w"))
    vocabulary = words.select("word").distinct()
    exact = vocabulary.join(terms, vocabulary["word"] == terms["term"]).select("word", "weight")
    loose = vocabulary.join(exact.select("word"), "word", "left_anti")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3)))))
    # A term meets a word on the term's first three letters, and a word a term on the word's first three.
    t = terms.where(F.length("term") >= 3)
    inside = loose.select("word", grams(F.col("word")).alias("g")).join(t.select("term", "weight", F.left("term", F.lit(3)).alias("g")), "g").where(F.col("word").contains(F.col("term")))
    around = loose.where(F.length("word") >= 3).select("word", F.left("word", F.lit(3)).alias("g")).join(t.select("term", "weight", grams(F.col("term")).alias("g")), "g").where(F.col("term").contains(F.col("word")))
    partial = inside.select("word", "weight").unionByName(around.select("word", "weight")).groupBy("word").agg((F.max("weight") * 0.5).alias("weight"))
    scored = words.join(exact.unionByName(partial), "word")
    return scored.groupBy("id").agg(F.sum(F.col("w") * F.col("weight")).alias("relevance"))


def adaptive_score(links: DataFrame, terms: DataFrame, reputation: DataFrame, query_count: int, least_queries: int = 3, key: str = "id") -> DataFrame:
    """(id, score) of links(id, anchor, url, title, domain, depth, base); the static score under three queries."""
    if query_count < least_queries:
        return links.select(F.col(key).alias("id"), static_score(F.col("base"), F.col("depth")).alias("score"))
    rel = relevance(links, terms, key)
    rep = reputation.select("domain", F.col("score").alias("rep"))
    j = links.withColumnRenamed(key, "id").join(rel, "id", "left").join(rep, "domain", "left")
    base = F.when(F.coalesce("base", F.lit(0.0)) == 0, 10.0).otherwise(F.col("base"))
    score = base + F.coalesce("relevance", F.lit(0.0)) + F.coalesce("rep", F.lit(0.0)) * REPUTATION - DEPTH_K * F.log1p(F.col("depth").cast("double"))
    return j.select("id", F.greatest(F.lit(0.0), score).alias("score"))
