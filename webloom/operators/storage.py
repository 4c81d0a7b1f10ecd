"""Writing rows by key: upserts, replacements, purges, micro-batches.

Plain Parquet has no MERGE, so an upsert is a single aggregation by key over the old and the new rows, in the
order in which they were written; nothing is sorted or collected, and replaying a batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def last_write_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """The last row of each key; columns in ``keep`` take their last value that isn't NULL."""
    rest = [c for c in rows.columns if c not in key and c not in keep]
    at = F.struct(*order)
    aggs = [F.max_by(F.struct(*rest), at).alias("_row")] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in keep]
    got = rows.groupBy(*key).agg(*aggs)
    return got.select(*[F.col(c) if c in key else F.col(f"_{c}").alias(c) if c in keep else F.col(f"_row.{c}") for c in rows.columns])


def upsert_pages(rows: DataFrame) -> DataFrame:
    """Replay of page writes by url in the order of their crawl.

    The last write wins; ``published_at`` stays when the new one is NULL; ``ingest_hits`` starts with the first
    write and grows by later writes of the mode 'extension' only; ``last_seen_at`` is the last one of that mode,
    else the first write's.
    """
    order = [F.coalesce("crawled_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.col("page_id")]
    at = F.struct(*order)
    ext = F.col("fetch_mode") == "extension"
    base = last_write_wins(rows, ["url"], order, ["published_at"]).drop("ingest_hits", "last_seen_at")
    extra = rows.groupBy(F.col("url").alias("_u")).agg(
        (F.min_by("ingest_hits", at) + F.coalesce(F.sum(F.when(ext, F.col("ingest_hits"))), F.lit(0)) - F.min_by(F.when(ext, F.col("ingest_hits")).otherwise(0), at)).cast("int").alias("ingest_hits"),
        F.coalesce(F.max_by("last_seen_at", F.when(ext & F.col("last_seen_at").isNotNull(), at)), F.min_by("last_seen_at", at)).alias("last_seen_at"),
    )
    return base.join(extra, base["url"].eqNullSafe(extra["_u"])).drop("_u").select(*rows.columns)


def discovered_resources(log: DataFrame) -> DataFrame:
    """(url, url_fingerprint, kind, status, last_crawled): what was fetched and holds links without being a page.

    One row for each url, from its latest fetch: an upsert by url in the order of the log's times.
    """
    kept = log.where(U.discovery_type(F.col("content_type")) & ~U.html_type(F.col("content_type")) & F.col("url").isNotNull())
    rows = kept.select("url", U.fingerprint(F.col("url")).alias("url_fingerprint"), U.asset_kind(F.col("content_type")).alias("kind"), "status", F.col("ts").alias("last_crawled"), "fetch_id")
    return last_write_wins(rows, ["url"], [F.col("last_crawled"), F.col("fetch_id")]).drop("fetch_id")


def known_addresses(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """(url, url_fingerprint) of everything that was fetched, to seed what is seen."""
    return pages.select("url", "url_fingerprint").unionByName(resources.select("url", "url_fingerprint"))


def migrated(df: DataFrame, version: int, steps: Sequence[tuple[int, str, str]]) -> tuple[DataFrame, int]:
    """A table brought from its schema version to the last of ``steps`` (version, column, type), in their order.

    A step adds a column of NULLs; a column that is there already is left as it is. Steps up to ``version`` are
    skipped, so a second run changes nothing. Gives the table and its version now.
    """
    for number, column, kind in sorted(steps):
        if number > version:
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast(kind))
            version = number
    return df, version


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows and the first new row of each key that the old ones lack."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in new.columns])
    return old.unionByName(first.join(old.select(*key), list(key), "left_anti"))


def replace_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of the new sources replace all old ones of these sources; repeated pairs are written once."""
    kept = old.join(new.select("source_id").distinct(), "source_id", "left_anti")
    first = new.groupBy("source_id", "target_hash").agg(F.min_by(F.struct("anchor_text", "created_at"), F.struct("created_at", "anchor_text")).alias("r"))
    return kept.unionByName(first.select("source_id", "target_hash", "r.anchor_text", "r.created_at"))


def upsert_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts and times of the new rows win; an empty robots text or a missing time keeps the old one."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, "domain", "full_outer")
    return j.select(
        "domain",
        F.when(F.coalesce(F.col("n.robots_txt"), F.lit("")) != "", F.col("n.robots_txt")).otherwise(F.coalesce("o.robots_txt", F.lit(""))).alias("robots_txt"),
        F.coalesce("n.last_crawled", "o.last_crawled").alias("last_crawled"),
        F.coalesce("n.pages_count", "o.pages_count").alias("pages_count"),
        F.coalesce("n.avg_response_ms", "o.avg_response_ms").alias("avg_response_ms"),
    )


def upsert_seeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """New seeds are added; of a known one only the interval changes. Columns: url, domain, recrawl_interval_seconds."""
    j = old.alias("o").join(new.alias("n"), "url", "full_outer")
    return j.select("url", F.coalesce("o.domain", "n.domain").alias("domain"), F.coalesce("n.recrawl_interval_seconds", "o.recrawl_interval_seconds").alias("recrawl_interval_seconds"), F.col("o.last_enqueued").alias("last_enqueued"))


def of_domains(rows: DataFrame, gone: DataFrame, column: str = "domain") -> DataFrame:
    """Rows of the domains ``gone(blocked)`` and of their subdomains, by a join on the exploded parents."""
    key = rows.select(F.col(column).alias("_d")).where("_d <> ''").distinct().select("_d", F.explode(U.parents(F.lower("_d"))).alias("blocked"))
    hit = key.join(gone.select("blocked"), "blocked", "left_semi").select("_d").distinct()
    return rows.join(hit, rows[column] == hit["_d"], "left_semi")


def purge_domains(pages: DataFrame, links: DataFrame, queue: DataFrame, gone: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, links and queue rows without the given domains; the ids of the pages are taken before they go."""
    bad = of_domains(pages, gone)
    left = pages.join(bad.select(key), key, "left_anti")
    targets = bad.select(F.col("url_hash").alias("target_hash")).distinct()
    links_left = links.join(bad.select(F.col(key).alias("source_id")), "source_id", "left_anti").join(targets, "target_hash", "left_anti")
    return left, links_left, queue.join(of_domains(queue, gone).select("queue_id"), "queue_id", "left_anti")


def ingest(pages: DataFrame, outlinks: int = 3) -> DataFrame:
    """Pages pushed from outside: canonical address, hash, region, fingerprint; at most three http links are kept.

    Rows whose address is no http address, a page of search results or no document are left out.
    """
    u = F.col("canonical")
    rows = pages.withColumn("canonical", U.canonical(F.col("url"))).where(u.isNotNull())
    rows = rows.where(~U.non_indexable(u) & ~U.search_results_page(u))
    return rows.select(
        u.alias("url"), U.domain(u).alias("domain"), U.region(U.domain(u)).alias("region"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), U.fingerprint(u).alias("url_fingerprint"), U.fnv1a(u).alias("url_hash"), "title",
        *([F.slice(F.filter("outlinks", lambda x: x.rlike("^https?://[^/]+")), 1, outlinks).alias("outlinks")] if "outlinks" in pages.columns else []),
    )
