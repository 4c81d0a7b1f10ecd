"""Pages that are no article: template residue and error pages, and pages made of keywords or links.

One pass over the pages gives a small row for each (``page_facts``); the two detectors work on those rows.

Template residue (``residue_pages``): all main lines of all pages are masked (numbers, addresses, dates) and
hashed; the hashes are grouped across sources. A message is known by its phrase rules, or, with no rule for it, by
its group: spread widely over sources, nearly always on pages made of such lines, and either sent with an error
status more often than not or without any run of sentences around it. So an article that many sites print, or a line
that many articles hold, is no message. A page is a case when it holds an unfilled placeholder, or when its main text,
furniture aside, is mostly filler, errors or script notices. The words of filler text are learned from all lines of
all pages (``filler_words``).

Keyword pages (``spam_pages``): bagged decision trees on content and link features, trained on the weak labels
of all rows, then smoothed by the rate of spam of the page's host.

Pages with NULL, empty or blank content, or with furniture only, are no case of either. Repeated page ids give
one row each. Every page is read as a whole.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from ..sources import materialize
from . import forest
from .furniture import ends_sentence, kinds, page_lines
from .notices import FILLER_WORDS, FUNCTION, LEARN_ROUNDS, count_inside, count_words, mask, message, unfilled, worded
from .sampling import lists

#: Share of the main characters that must be messages.
MESSAGE_SHARE = 0.6
#: A line without a rule is a message when so many sources and pages send it, in so large a share on pages made of such lines.
WIDE_SOURCES, WIDE_PAGES, WIDE_SHARE = 5, 8, 0.9
#: Share of its pages sent with an error status, or else most sentences that these pages hold on average.
ERROR_SHARE, FEW_SENTENCES = 0.3, 4
#: Pages that a worker holds split into words at a time.
CHUNK = 400
TREES = 25

FEATURES = 16

_WORD = re.compile(r"[^\W\d_]+")
_URLS = re.compile(r"https?://\S+")


def spam_features(main: list[str], title: str, split: list[list[str]] | None = None) -> list[float]:
    """Content and link features of a page's main lines; ``split`` are their words in lower case, where known.

    The first LABEL_ONLY serve the weak labels. The others look at what is left beside the sentences, so that a
    sentence or two around a list of keywords changes little.
    """
    chars = sum(map(len, main)) or 1
    in_sentences = sentences = listed = 0
    rest: list[str] = []
    for s, low in zip(main, split or [s.lower().split() for s in main]):
        if s[:1] in "•-*»>–·[" or s.startswith("http"):
            listed += 1
        if len(s) <= 24:
            rest.append(s)
            continue
        stops = s.count(". ") + s.count("! ") + s.count("? ") + s.count(".” ") + s.count(".» ") + ends_sentence(s, ".!?…")
        if not stops:
            rest.append(s)
            continue
        n = len(low)
        # Half of the words mostly has enough function words.
        known = sum(map(FUNCTION.__contains__, low[: n // 2]))
        if known * 10 < n:
            known += sum(map(FUNCTION.__contains__, low[n // 2 :]))
        if 5 * stops <= n <= 60 * stops and (known * 10 >= n or known and len(set(low)) * 2 >= n):
            in_sentences += len(s)
            sentences += stops
        else:
            rest.append(s)
    text = " ".join(rest)
    size = len(text) or 1
    words = _WORD.findall(text.lower())
    n = len(words) or 1
    function = sum(map(FUNCTION.__contains__, words))
    counts = Counter(w for w in words if w not in FUNCTION and len(w) > 2)
    content = sum(counts.values()) or 1
    pairs = Counter(zip(words, words[1:]))
    title_words = {w for w in _WORD.findall(title.lower()) if len(w) > 2 and w not in FUNCTION}
    return [
        in_sentences / chars,
        math.log1p(chars),
        function / n,
        sum(sorted(counts.values())[-5:]) / content,
        len(counts) / content,
        sum(map(text.count, "0123456789")) / size,
        sum(len(u) for u in _URLS.findall(text)) / size if "http" in text else 0.0,
        sum(map(text.count, ",;|/·[]")) / n,
        n / max(1, len(rest)),
        listed / max(1, len(main)),
        math.log1p(len(text)),
        text.count("[") / n,
        sum(c for c in pairs.values() if c > 1) / n,
        sum(counts[w] for w in title_words) / content,
        min(sentences, 8),
        text.count(": ") / n,
    ]


LABEL_ONLY = 2


def weak_label(f: list[float]) -> int:
    """1 spam, 0 article, -1 unsure: from the share of sentences and what is left beside them."""
    share, chars, function, sentences = f[0], f[1], f[2], f[14]
    if chars < math.log1p(60):
        return -1
    if share <= 0.35 and sentences <= 3 and f[10] > math.log1p(150) and (function < 0.18 or f[4] < 0.5) and f[15] < 0.05:
        return 1
    return 0 if share >= 0.55 and (sentences >= 3 or f[10] < math.log1p(150)) else -1


FACTS = "page_id string, domain string, failed boolean, main_chars int, unfilled boolean, ruled_chars int, messages array<struct<h: bigint, n: int>>, features array<float>"
SENTENCES = 14


def filler_words(pages: DataFrame) -> frozenset[str]:
    """``learn_filler`` over all lines of all pages; only the words that it learns come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lines in count_words(x for b in batches for x in b.column(0).to_pylist()):
            text = pa.array([*words, *lines], "string")
            yield pa.RecordBatch.from_arrays([text, pa.array([False] * len(words) + [True] * len(lines), "bool"), pa.array([*words.values(), *lines.values()], "int64")], names=["text", "line", "n"])

    counted = materialize(pages.where("content <> ''").select("content").mapInArrow(count, "text string, line boolean, n bigint"))
    lines = materialize(counted.where("line").groupBy("text").agg(F.sum("n").alias("n")))
    every = materialize(counted.where("not line").groupBy("text").agg(F.sum("n").alias("every")))
    known = FILLER_WORDS
    for _ in range(LEARN_ROUNDS):

        def inside(batches: Iterator[pa.RecordBatch], known: frozenset[str] = known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = count_inside(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), known)
                yield pa.RecordBatch.from_arrays([pa.array([*words], "string"), pa.array([*words.values()], "int64")], names=["text", "n"])

        found = lines.mapInArrow(inside, "text string, n bigint").groupBy("text").agg(F.sum("n").alias("n")).where("n >= 2")
        more = {r[0] for r in found.join(every, "text").where(F.col("n") >= 0.8 * F.col("every")).select("text").collect()}
        if more <= known:
            break
        known |= more
    return known


def page_facts(pages: DataFrame, key: str = "page_id", extra: Callable[[], Callable[..., pa.Array]] | None = None, extra_type: str = "") -> DataFrame:
    """One small row for each page with content: see FACTS; ``row`` numbers them.

    ``extra`` gives, on the worker, a function of a batch (lists of its columns, squeezed lines of each page, their words in lower case, and the
    lines in lower case) to the Arrow array of one more column ``extra``; so operators that exclude these pages read the content only once.
    """
    kind = pages.schema[key].dataType.simpleString()
    filler = filler_words(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        more = extra() if extra else None
        # Arrow batches hold thousands of pages; their words are kept for a few hundred at a time.
        for part in (b.slice(a, CHUNK) for b in batches for a in range(0, b.num_rows, CHUNK)):
            # Nothing below makes cycles; looking for them among the words of all lines would only take time.
            gc.disable()
            page = {c: part.column(c).to_pylist() for c in part.schema.names}
            out, hashes, sizes, pages_lines, pages_split, pages_lows = [], [], [], [], [], []
            for content, title in zip(page["content"], page["title"]):
                bad = unfilled(content)
                lines = page_lines(content)
                lows = [s.lower() for s in lines]
                split = [s.split() for s in lows]
                named = kinds(lines)
                if more:
                    pages_lines.append(lines)
                    pages_split.append(split)
                    pages_lows.append(lows)
                at = [j for j, k in enumerate(named) if k == ""]
                main = [lines[j] for j in at]
                chars = sum(map(len, main))
                ruled, messages = 0, {}
                for j in at:
                    s = lines[j]
                    if message(s, filler, lows[j], split[j]):
                        ruled += len(s)
                    elif worded(m := mask(s, lows[j])):
                        h = xxh64_intdigest(m) - (1 << 63)
                        messages[h] = messages.get(h, 0) + len(s)
                hashes += messages
                sizes += messages.values()
                out.append((chars, bad, ruled, len(messages), spam_features(main, title or "", [split[j] for j in at])))
            chars, bad, ruled, counts, features = zip(*out)
            columns = [part.column("k"), part.column("domain"), part.column("failed"), pa.array(chars, "int32"), pa.array(bad, "bool"), pa.array(ruled, "int32")]
            columns.append(lists(counts, pa.StructArray.from_arrays([pa.array(hashes, "int64"), pa.array(sizes, "int32")], names=["h", "n"])))
            columns.append(lists([FEATURES] * len(out), pa.array([x for f in features for x in f], "float32")))
            if more:
                columns.append(more(page, pages_lines, pages_split, pages_lows))
            gc.enable()
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "domain", "failed", "main_chars", "unfilled", "ruled_chars", "messages", "features", "extra"][: len(columns)])

    columns = [c for c in ("language", "url") if extra and c in pages.columns]
    failed = (F.col("status_code") >= 400) | (F.col("status_code") <= 0) if "status_code" in pages.columns else F.lit(False)
    rows = pages.where("content <> ''").select(F.col(key).cast("string").alias("k"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce(failed, F.lit(False)).alias("failed"), "content", "title", *columns)
    # Keys pass through Python as text, whatever their type.
    facts = rows.mapInArrow(run, FACTS + (f", extra {extra_type}" if extra else ""))
    return facts.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("row", F.monotonically_increasing_id())


def wide_messages(facts: DataFrame) -> DataFrame:
    """(row, n): characters of each page's lines that are messages by their group alone."""
    lines = facts.select("row", "domain", "failed", F.col("features")[SENTENCES].alias("sentences"), F.explode("messages").alias("m")).select("row", "domain", "failed", "sentences", "m.h", "m.n")
    # Grouped by (hash, source) first, so that one message of a huge source is combined before the second step.
    by_source = lines.groupBy("h", "domain").agg(F.count("*").alias("pages"), F.sum(F.col("failed").cast("int")).alias("failed"), F.sum("sentences").alias("sentences"))
    groups = by_source.groupBy("h").agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in ("pages", "failed", "sentences")])
    wide = groups.where((F.col("sources") >= WIDE_SOURCES) & (F.col("pages") >= WIDE_PAGES) & ((F.col("failed") >= ERROR_SHARE * F.col("pages")) | (F.col("sentences") < FEW_SENTENCES * F.col("pages"))))
    spots = split_join(lines, materialize(wide.select("h", "pages")), ["h"], "pages", "left_semi")
    # A page is made of such lines when they and the lines with a rule are most of it.
    per_page = spots.groupBy("row").agg(F.sum("n").alias("spare"), F.collect_list(F.struct("h", "n")).alias("l"))
    per_page = facts.select("row", "main_chars", "ruled_chars").join(per_page, "row")
    placed = per_page.select("row", (F.col("ruled_chars") + F.col("spare") >= MESSAGE_SHARE * F.col("main_chars")).alias("bare"), F.explode("l").alias("m")).select("row", "bare", "m.h", "m.n")
    placed = materialize(placed)
    known = placed.groupBy("h").agg(F.count("*").alias("pages"), F.avg(F.col("bare").cast("int")).alias("share")).where(F.col("share") >= WIDE_SHARE)
    return split_join(placed, materialize(known.select("h", "pages")), ["h"], "pages", "left_semi").groupBy("row").agg(F.sum("n").alias("n"))


def residue_pages(facts: DataFrame) -> DataFrame:
    """(page_id) of template residue, filler, errors and notices."""
    enough = lambda chars: (F.col("main_chars") > 0) & (chars >= MESSAGE_SHARE * F.col("main_chars"))
    ruled = facts.where(F.col("unfilled") | enough(F.col("ruled_chars"))).select("page_id")
    more = facts.where("not unfilled").join(wide_messages(facts), "row").where(enough(F.col("ruled_chars") + F.col("n")))
    return ruled.union(more.select("page_id")).distinct()


def spam_pages(facts: DataFrame) -> DataFrame:
    """(page_id, score) of keyword-stuffed pages and link lists."""
    rows = facts.where((F.col("main_chars") > 0) & ~F.col("unfilled") & (F.col("ruled_chars") < MESSAGE_SHARE * F.col("main_chars"))).select("page_id", "domain", "features")
    trees = forest.train_table(_labelled(rows), trees=TREES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"page_id": pdf["page_id"], "domain": pdf["domain"], "p": trees.probability(np.array(pdf["features"].tolist(), float)[:, LABEL_ONLY:])})

    kind = facts.schema["page_id"].dataType.simpleString()
    scored = rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, "page_id string, domain string, p double")
    scored = materialize(scored.withColumn("page_id", F.col("page_id").cast(kind)))
    # Rate of spam of each host, drawn towards the rate of all by PRIOR pages; it moves the odds a little. Pages without host keep theirs.
    base = F.lit(scored.agg(F.avg("p")).first()[0] or 0.0)
    hosts = scored.where("domain <> ''").groupBy("domain").agg(F.sum("p").alias("s"), F.count("*").alias("c"))
    hosts = materialize(hosts.select("domain", "c", ((F.col("s") + PRIOR * base) / (F.col("c") + PRIOR)).alias("rate")))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-4)) / F.greatest(1 - c, F.lit(1e-4)))
    joined = split_join(scored, hosts, ["domain"], "c").unionByName(scored.where("domain = ''").withColumn("rate", base))
    z = logit(F.col("p")) + HOST_WEIGHT * (logit(F.col("rate")) - logit(base))
    return joined.withColumn("score", 1 / (1 + F.exp(-z))).where("score >= 0.5").select("page_id", "score")


PRIOR = 20
HOST_WEIGHT = 0.25


def excluded(facts: DataFrame) -> DataFrame:
    """(page_id) of both kinds."""
    return residue_pages(facts).union(spam_pages(facts).select("page_id")).distinct()


def _labelled(rows: DataFrame) -> DataFrame:
    """(k, x, y): features and weak labels of all rows that have one, with a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(-1, FEATURES)
            y = np.array([weak_label(f) for f in x.tolist()], "int32")
            on = y >= 0
            values = pa.array(np.ascontiguousarray(x[on, LABEL_ONLY:]).ravel())
            yield pa.RecordBatch.from_arrays([b.column("k").filter(pa.array(on)), lists([FEATURES - LABEL_ONLY] * int(on.sum()), values), pa.array(y[on])], names=["k", "x", "y"])

    return materialize(rows.select(F.xxhash64("page_id", "domain", "features").alias("k"), "features").mapInArrow(run, "k bigint, x array<float>, y int"))
