"""Spelling: vocabulary by trigrams, suggestions, compound words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))


def dictionary(vocabulary: DataFrame, least_docs: int = 3, least_chars: int = 4) -> DataFrame:
    """Words that are frequent and long enough to be suggested: (term, doc)."""
    return vocabulary.where((F.col("doc") >= least_docs) & (F.length("term") >= least_chars)).select("term", "doc")


def suggest(words: DataFrame, known: DataFrame, candidates: int = 100) -> DataFrame:
    """(word, suggestion) for words(word) that the dictionary lacks.

    Candidates share trigrams with the word: an equi-join on the trigram, counted, the best hundred kept. Among
    those within two edits (three from seven letters on), the nearest wins, then the more frequent.
    """
    unknown = words.join(known.select(F.col("term").alias("word")), "word", "left_anti").where(F.length("word") >= 3)
    a = unknown.select("word", F.explode(trigrams(F.col("word"))).alias("g"))
    b = known.select("term", "doc", F.explode(trigrams(F.col("term"))).alias("g"))
    shared = a.join(b, "g").groupBy("word", "term", "doc").agg(F.count("*").alias("n"))
    top = shared.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.col("n").desc(), F.col("doc").desc(), "term"))).where(F.col("r") <= candidates)
    far = F.when(F.length("word") >= 7, 3).otherwise(2)
    near = top.withColumn("dist", F.levenshtein("word", "term")).where(F.col("dist") <= far)
    return near.groupBy("word").agg(F.min_by("term", F.struct("dist", -F.col("doc"), "term")).alias("suggestion"))


def split_compounds(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, head, tail) for words of seven letters or more made of two known words; the longest head wins."""
    long = words.where(F.length("word") >= 7).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    cut = long.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("i"))
    cut = cut.select("word", F.left("word", F.col("i")).alias("head"), F.substr("word", F.col("i") + 1).alias("tail"))
    v = vocabulary.select("term")
    ok = cut.join(v, cut["head"] == v["term"], "left_semi").join(v, cut["tail"] == v["term"], "left_semi")
    return ok.groupBy("word").agg(F.max_by(F.struct("head", "tail"), F.length("head")).alias("s")).select("word", "s.head", "s.tail")
