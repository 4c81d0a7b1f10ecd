"""Link graph: backlinks, outlinks, referring domains, rank.

Pages are nodes by the hash of their url, as one url may be crawled several times. Links to pages never crawled
have no node. Repeated links count once, links of a page to itself not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import materialize
from .skew import split_join


def nodes(pages: DataFrame) -> DataFrame:
    """(node, domain, url): one row for each url hash, from its latest crawl."""
    last = F.max_by(F.struct("domain", "url"), F.struct(F.coalesce("crawled_at", F.lit("1970-01-01").cast("timestamp_ntz")), "page_id"))
    return pages.groupBy(F.col("url_hash").alias("node")).agg(last.alias("p")).select("node", "p.domain", "p.url")


def edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between known pages."""
    source = pages.select(F.col("page_id").alias("source_id"), F.col("url_hash").alias("src"))
    # How often a page is linked to is counted first, so that the links to a hot one stay where they are.
    known = pages.select(F.col("url_hash").alias("dst")).distinct().join(links.groupBy(F.col("target_hash").alias("dst")).agg(F.count("*").alias("n")), "dst")
    rows = links.join(source, "source_id").select("src", F.col("target_hash").alias("dst")).where("src <> dst")
    return split_join(rows, known, ["dst"], "n", "left_semi").select("src", "dst").distinct()


def referring_domains(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(node, referring): distinct domains that link to a page from another domain; 0 without any."""
    n = nodes(pages)
    src = n.select(F.col("node").alias("src"), F.col("domain").alias("from_domain"))
    dst = n.select(F.col("node").alias("dst"), F.col("domain").alias("to_domain"))
    # Distinct pairs first: the links to a page that all link to are one row for each domain before they meet it.
    pairs = edges(links, pages).join(src, "src").select("dst", "from_domain").distinct().join(dst, "dst").where("from_domain <> to_domain")
    counted = pairs.groupBy("dst").agg(F.count("*").alias("c"))
    return n.select("node").join(counted, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("c", F.lit(0)).alias("referring"))


def backlinks(links: DataFrame, pages: DataFrame, url: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest links to a url with the title of their page."""
    target = pages.where(F.col("url") == url).select(F.col("url_hash").alias("target_hash")).distinct()
    rows = links.join(F.broadcast(target.limit(1)), "target_hash")
    titles = pages.select(F.col("page_id").alias("source_id"), "url", "title")
    return rows.join(titles, "source_id", "left").orderBy(F.col("created_at").desc(), "source_id").offset(offset).limit(limit).select("source_id", "url", "title", "anchor_text", "created_at")


def outlinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """All links with the url of their target, or 'hash:<n>' where it was never crawled."""
    urls = nodes(pages).select(F.col("node").alias("target_hash"), "url")
    return links.join(urls, "target_hash", "left").select("source_id", F.coalesce("url", F.concat(F.lit("hash:"), F.col("target_hash").cast("string"))).alias("target"), "anchor_text", "created_at")


def pagerank(edge_rows: DataFrame, node_rows: DataFrame, rounds: int = 15, damping: float = 0.85, keep_every: int = 5) -> DataFrame:
    """(node, rank): every node starts at 1; the rank of nodes without links is shared by all.

    Each round is one join on the source and one partial sum by target. Edges carry their share 1/outdegree and
    are written once; lineage is cut every few rounds by a reliable checkpoint.
    """
    out = edge_rows.groupBy("src").agg(F.count("*").alias("deg"))
    weighted = materialize(edge_rows.join(out, "src").select("src", "dst", (1 / F.col("deg")).alias("share")).repartition("src"))
    n = materialize(node_rows.select("node").join(out, F.col("node") == F.col("src"), "left").select("node", F.col("deg").isNull().alias("dangling")))
    total = n.count()
    if not total:
        return n.select("node", F.lit(1.0).alias("rank"))
    ranks = n.withColumn("rank", F.lit(1.0))
    for i in range(1, rounds + 1):
        got = weighted.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        lost = ranks.where("dangling").agg((F.coalesce(F.sum("rank"), F.lit(0.0)) / total).alias("lost"))
        ranks = n.join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost))
        ranks = ranks.select("node", "dangling", (1 - damping + damping * (F.coalesce("sum", F.lit(0.0)) + F.col("lost"))).alias("rank"))
        if i % keep_every == 0 or i == rounds:
            ranks = materialize(ranks)
    return ranks.select("node", "rank")
