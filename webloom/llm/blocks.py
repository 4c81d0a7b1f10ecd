"""Lines and blocks of lines that return on many pages of one site.

A page becomes the list of the ids of its lines, written once. The suffixes of all lists of a site, each as far as
its lines are repeated ones, form the site's suffix array: equal suffixes are merged with their counts before
anything is sorted, then the array is range-partitioned by (site, suffix) and sorted, so that a site with a third of
all pages is spread over many tasks. Neighbours with a common prefix form intervals; an interval whose urls number
``MIN_URLS`` or more is a candidate, however long. An interval that crosses the border of two tasks is completed
by adding up the parts, as counts of blocks merge. A url with several suffixes in an interval is counted several
times there, so an exact count of distinct urls follows for all candidates.

``whole_blocks`` are the blocks that no longer block on as many urls contains. Repeated lines are the lines of those
blocks, and ``without_blocks`` deletes their lines from each document of the site.

Joins on (site, line) leave the rows of hot keys where they are (``split_join``).

Runs of spaces, tabs and no-break spaces count as one space, ends are trimmed, empty lines are left out. Rows
with a NULL or empty site or NULL content take no part; NULL urls are no urls. Repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from ..sources import materialize

MIN_URLS = 8


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "[ \t ]+", " "))


def _listed(pages: DataFrame, site: str, url: str, content: str) -> DataFrame:
    """(site, u, ids): one row for each page, ids in order, empty lines left out."""
    lines = F.filter(F.transform(F.split(content, "\n"), squeezed), lambda x: x != "")
    rows = pages.where(F.col(site).isNotNull() & (F.col(site) != "") & (F.col(content) != ""))
    return rows.select(F.col(site).alias("site"), F.xxhash64(F.col(url)).alias("u"), F.col(url).isNotNull().alias("known"), F.transform(lines, lambda x: F.xxhash64(x)).alias("ids"))


def _suffixes(listed: DataFrame) -> DataFrame:
    """Distinct (site, u, s): the suffixes of the pages of each url."""
    # A line on fewer than MIN_URLS urls of its site is in no repeated block: the lists are cut there.
    spots = listed.select("site", "u", F.explode(F.array_distinct("ids")).alias("id")).distinct()
    often = materialize(spots.groupBy("site", "id").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_URLS))
    numbered = listed.select("site", "u", "p", F.posexplode("ids").alias("at", "id"))
    kept = split_join(numbered, often, ["site", "id"], "c", "left_semi").groupBy("site", "u", "p").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("k"))
    # Only unbroken stretches count: a suffix ends where the next kept line isn't the next line of the page.
    placed = kept.select("site", "u", "k", F.explode(F.sequence(F.lit(1), F.size("k"))).alias("i"))
    unbroken = F.filter(F.slice("k", F.col("i"), F.size("k")), lambda x, j: x["at"] == F.element_at("k", F.col("i"))["at"] + j)
    return placed.select("site", "u", F.transform(unbroken, lambda x: x["id"]).alias("s")).distinct()


def _candidates(suffixes: DataFrame) -> DataFrame:
    """(site, block, h): prefixes that MIN_URLS or more (suffix, url) pairs have in common."""
    array = suffixes.groupBy("site", "s").agg(F.count("*").alias("n"))
    ordered = array.repartitionByRange("site", "s").sortWithinPartitions("site", "s")

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Intervals of common prefixes: one open count for each prefix length, closed when the prefix changes."""
        at: str | None = None
        prefix: list[int] = []
        counts: list[int] = []
        # Prefixes of the task's first suffix may go on from the task before, whatever their count here.
        edge: int | None = None
        for pdf in batches:
            out: list[tuple[str, list[int], int]] = []
            for host, s, n in zip(pdf["site"], pdf["s"], pdf["n"]):
                s = s.tolist()
                common = 0
                if host == at:
                    while common < len(s) and common < len(prefix) and s[common] == prefix[common]:
                        common += 1
                if edge is None:
                    edge = len(s)
                for d in range(len(prefix), common, -1):
                    if counts[d - 1] >= MIN_URLS or d <= edge:
                        out.append((at, prefix[:d], counts[d - 1]))
                if at is not None:
                    edge = min(edge, common)
                counts = [c + n for c in counts[:common]] + [n] * (len(s) - common)
                at, prefix = host, s
            yield pd.DataFrame(out, columns=["site", "block", "n"])
        yield pd.DataFrame([(at, prefix[:d], counts[d - 1]) for d in range(len(prefix), 0, -1)], columns=["site", "block", "n"])

    parts = ordered.mapInPandas(intervals, "site string, block array<bigint>, n bigint")
    # Only intervals at the ends of a task can have another part; adding up treats all alike.
    whole = parts.groupBy("site", "block").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_URLS)
    return whole.select("site", "block", F.xxhash64("block").alias("h"), "n")


def repeated_blocks(pages: DataFrame, site: str = "domain", url: str = "url", content: str = "content") -> DataFrame:
    """(site, block array<long>, h, n): blocks of line ids of any length with the number of different urls they are on."""
    listed = materialize(_listed(pages, site, url, content).where("known").withColumn("p", F.monotonically_increasing_id()))
    suffixes = materialize(_suffixes(listed))
    candidates = materialize(_candidates(suffixes))
    prefixes = suffixes.select("site", "u", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d")).select("site", "u", F.xxhash64(F.slice("s", 1, F.col("d"))).alias("h"))
    exact = split_join(prefixes, candidates.select("site", "h", "n"), ["site", "h"], "n", "left_semi").distinct().groupBy("site", "h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_URLS)
    return candidates.drop("n").join(exact, ["site", "h"]).select("site", "block", "h", "n")


def whole_blocks(blocks: DataFrame) -> DataFrame:
    """Those of the repeated blocks that are not part of a longer one on the same number of urls."""
    # A block inside a longer one on as many urls is also the longer one less its first or last line, or inside that.
    inner = F.array(*[F.xxhash64(F.slice("block", i, F.size("block") - 1)) for i in (1, 2)])
    covered = blocks.where(F.size("block") > 1).select("site", "n", F.explode(inner).alias("h")).distinct()
    return blocks.join(covered, ["site", "h", "n"], "left_anti")


def block_lines(blocks: DataFrame) -> DataFrame:
    """(site, id, n): the lines of blocks, with the number of urls of their widest block."""
    return blocks.select("site", "n", F.explode("block").alias("id")).groupBy("site", "id").agg(F.max("n").alias("n"))


def repeated_lines(pages: DataFrame, site: str = "domain", url: str = "url", content: str = "content") -> DataFrame:
    """(site, line): the lines of the whole repeated blocks of each site."""
    found = materialize(block_lines(whole_blocks(materialize(repeated_blocks(pages, site, url, content)))))
    texts = pages.where(F.col(site).isNotNull() & (F.col(site) != "") & (F.col(content) != ""))
    texts = texts.select(F.col(site).alias("site"), F.explode(F.array_distinct(F.transform(F.split(content, "\n"), squeezed))).alias("line")).where("line <> ''")
    texts = split_join(texts.withColumn("id", F.xxhash64("line")), found, ["site", "id"], "n", "left_semi")
    return texts.groupBy("site", "id").agg(F.first("line").alias("line")).select(F.col("site").alias(site), "line")


def without_blocks(pages: DataFrame, key: str = "page_id", site: str = "domain", url: str = "url", content: str = "content") -> DataFrame:
    """(page_id, content): each page's content without the lines of its site's repeated blocks; NULL stays NULL.

    The lines of a page meet those of its site one by one, and what goes is gathered per page.
    """
    found = materialize(block_lines(whole_blocks(materialize(repeated_blocks(pages, site, url, content)))))
    rows = materialize(pages.select(key, site, content).withColumn("row", F.monotonically_increasing_id()))
    ids = F.array_distinct(F.transform(F.split(content, "\n"), lambda x: F.xxhash64(squeezed(x))))
    spots = rows.where(F.col(site).isNotNull() & (F.col(site) != "")).select("row", F.col(site).alias("site"), F.explode(ids).alias("id"))
    gone = split_join(spots, found, ["site", "id"], "n", "left_semi").groupBy("row").agg(F.collect_set("id").alias("gone"))
    kept = F.filter(F.split(content, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(squeezed(x))))
    text = F.when(F.col("gone").isNull() | F.col(content).isNull(), F.col(content)).otherwise(F.array_join(kept, "\n"))
    return rows.join(gone, "row", "left").select(key, text.alias(content))
