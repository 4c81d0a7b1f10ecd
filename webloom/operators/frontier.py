"""Crawl frontier: admission, scoring, fair order, outcomes of a fetch, domain statistics, recrawl choices.

Every choice that depends on the time takes an explicit ``as_of``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .skew import places_per_key, top_per_key

NORMAL, SEED, DISCOVERY, RECRAWL = 10.0, 100.0, 50.0, 5.0
DEPTH_K = 12.0
EMA = 0.3


def static_score(base: Column, depth: Column, k: float = DEPTH_K) -> Column:
    """Base less k * ln(1 + depth), not below 0; a base of 0 counts as normal."""
    b = F.when(F.coalesce(base, F.lit(0.0)) == 0, NORMAL).otherwise(base)
    return F.greatest(F.lit(0.0), b - k * F.log1p(depth.cast("double")))


def admit(links: DataFrame, pages: DataFrame, blocked: DataFrame | None = None, per_shape: int = 10_000, strict: bool = False) -> DataFrame:
    """New addresses of ``links(url, depth, base)``: canonical, crawlable, not blocked, not known, scored.

    At most ``per_shape`` addresses of one fingerprint, known ones included; with ``strict`` only the first.
    """
    u = F.col("canonical")
    rows = links.withColumn("canonical", U.canonical(F.col("url"))).where(u.isNotNull()).where(~U.non_indexable(u))
    rows = rows.groupBy("canonical").agg(F.min("depth").alias("depth"), F.max("base").alias("base")).withColumn("domain", U.domain(u)).withColumn("fingerprint", U.fingerprint(u))
    if blocked is not None:
        from .storage import of_domains

        rows = rows.join(of_domains(rows, blocked).select("canonical"), "canonical", "left_anti")
    rows = rows.join(pages.select(U.canonical(F.col("url")).alias("canonical")).distinct(), "canonical", "left_anti")
    known = pages.groupBy(U.fingerprint(F.col("url")).alias("fingerprint")).agg(F.count("*").alias("known"))
    rows = rows.join(known, "fingerprint", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    most = 1 if strict else per_shape
    rows = top_per_key(rows, "fingerprint", [F.col("depth"), F.col("canonical")], most).where(F.col("nth") + F.col("known") <= most)
    return rows.select(u.alias("url"), "domain", "fingerprint", "depth", static_score(F.col("base"), F.col("depth")).alias("score"))


def per_page_links(links: DataFrame, most: int = 100) -> DataFrame:
    """At most the first ``most`` links of a page, by their place."""
    return links.withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy("created_at", "target_hash"))).where(F.col("nth") <= most).drop("nth")


def fair_order(queue: DataFrame) -> DataFrame:
    """Pending jobs with their place in their domain, and the turn in which domains alternate.

    Within a domain by score, then age; turns go round the domains in the order of their names.
    """
    pending = queue.where("status = 'pending'").select("queue_id", "domain", "score", "added_at")
    return places_per_key(pending, "domain", [F.col("score").desc(), F.col("added_at"), F.col("queue_id")]).select("queue_id", "domain", "score", "place")


def take_round_robin(queue: DataFrame, n: int) -> DataFrame:
    """The next n jobs when domains take turns."""
    # No domain can take more than n places.
    pending = queue.where("status = 'pending'").select("queue_id", "domain", "score", "added_at")
    best = top_per_key(pending, "domain", [F.col("score").desc(), F.col("added_at"), F.col("queue_id")], n)
    return best.withColumnRenamed("nth", "place").orderBy("place", "domain", "queue_id").limit(n).select("queue_id", "domain", "score", "place")


def dequeue(queue: DataFrame, n: int, as_of: datetime, without: list[str] | None = None) -> DataFrame:
    """The queue after its n best pending jobs were taken."""
    pending = queue.where("status = 'pending'")
    if without:
        pending = pending.where(~F.col("domain").isin(without))
    taken = pending.orderBy(F.col("score").desc(), "added_at", "queue_id").limit(n).select("queue_id", F.lit(True).alias("taken"))
    j = queue.join(taken, "queue_id", "left")
    return j.select("queue_id", "url", "domain", "score", F.when(F.col("taken"), "in_progress").otherwise(F.col("status")).alias("status"), F.when(F.col("taken"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("locked_at")).alias("locked_at"))


def reset_stalled(queue: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    stalled = (F.col("status") == "in_progress") & (F.col("locked_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))
    return queue.withColumn("status", F.when(stalled, "pending").otherwise(F.col("status"))).withColumn("locked_at", F.when(stalled, None).otherwise(F.col("locked_at")))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs after their outcome ``done(queue_id, error)``: gone on success, else failed with one more retry."""
    j = queue.join(done, "queue_id", "left")
    gone = F.col("error").isNotNull() & (F.col("error") == "")
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    return j.where(~gone).select("queue_id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), F.when(bad, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"), F.when(bad, F.col("error")).otherwise(F.col("error_msg")).alias("error_msg"))


def outcome(status: Column, content_type: Column, url: Column, retries: Column, max_retries: int = 3, render_on: tuple[int, ...] = (403, 503)) -> Column:
    """What becomes of a fetch: indexed, discovery, skipped, render, throttled, retry or error."""
    ok = status.between(200, 299)
    again = F.when(retries < max_retries, "retry").otherwise("error")
    return (
        F.when(status.isNull() | (status == 0), again)
        .when(~ok & status.isin(*render_on), "render")
        .when(status == 429, F.when(retries < max_retries, "throttled").otherwise("error"))
        .when(status.between(400, 499), "error")
        .when(~ok, again)
        .when(U.non_indexable(url), "skipped")
        .when(~U.html_type(content_type), F.when(U.discovery_type(content_type), "discovery").otherwise("skipped"))
        .otherwise("indexed")
    )


def demoted(score: Column) -> Column:
    """Score after a 429."""
    return F.greatest(F.lit(1.0), score * 0.25)


def retried(queue: DataFrame, most: int = 3) -> DataFrame:
    """Failed jobs with their retries counted up, and whether they are tried again."""
    again = F.col("retries") < most
    return queue.where("status = 'failed'").select("queue_id", F.when(again, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"), again.alias("again"))


def render_backlog(pages: DataFrame) -> DataFrame:
    """Pages to render, each shape and reason once."""
    return pages.where("render_reason <> ''").groupBy("url_fingerprint", "render_reason").agg(F.min("page_id").alias("page_id"))


def backoff_seconds(failures: Column, most: float = 60.0) -> Column:
    """2 * 2**n seconds for n failures in a row, 60 at most."""
    return F.least(F.lit(most), 2 * F.pow(F.lit(2.0), F.least(failures, F.lit(5))))


# Wording and markup of pages that need a browser.
NEEDS_SCRIPT = ["enable javascript", "javascript is required", "requires javascript", "please enable js", "necesitas activar javascript", "necesita activar javascript", "habilita javascript", "active javascript"]
INTERSTITIAL = ["just a moment", "checking your browser", "verify you are human", "ddos-guard", "cf-browser-verification", "cf-challenge"]
EMPTY_SHELL = ['id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', "data-reactroot", "ng-version"]


def render_reason(body: Column, text: Column, links: Column, least_chars: int = 200, least_links: int = 3) -> Column:
    """Why a page must be rendered, or ''."""
    low = F.lower(F.coalesce(body, F.lit("")))
    any_of = lambda marks: low.rlike("|".join(m.replace(".", "[.]") for m in marks))
    chars = F.octet_length(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(any_of(NEEDS_SCRIPT), "javascript_required_message")
        .when(any_of(INTERSTITIAL), "browser_interstitial")
        .when((chars < 200) & (links == 0) & any_of(EMPTY_SHELL), "empty_spa_shell")
        .when((chars < least_chars) & (links < least_links), "weak_http_parse")
        .otherwise("")
    )


def flushes(log: DataFrame, seconds: int = 30) -> DataFrame:
    """(domain, flush, pages, avg_ms, last): fetches of a domain in each interval; deliveries count once.

    The first step of the statistics: it bounds what the ordered fold has to read to one row for each interval,
    however many fetches a domain has.
    """
    once = log.where(F.col("domain") != "").groupBy("fetch_id").agg(F.first(F.struct("domain", "duration_ms", "ts")).alias("f")).select("f.*").where("duration_ms is not null")
    flush = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    got = once.groupBy("domain", flush.alias("flush")).agg(F.count("*").alias("pages"), F.sum("duration_ms").alias("ms"), F.max("ts").alias("last"))
    return got.select("domain", "flush", "pages", F.floor(F.col("ms") / F.col("pages")).alias("avg_ms"), "last")


def domain_stats(log: DataFrame, seconds: int = 30, alpha: float = EMA) -> DataFrame:
    """(domain, pages, avg_ms, last): the moving average over the flushes of a domain, cut to whole ms each time.

    The fold streams over sorted partitions and keeps one number per domain.
    """
    rows = flushes(log, seconds)
    ordered = rows.repartition("domain").sortWithinPartitions("domain", "flush")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pages, avg, last = None, 0, 0, None
        for pdf in batches:
            out = []
            for d, p, a, t in zip(pdf["domain"], pdf["pages"], pdf["avg_ms"], pdf["last"]):
                if d != at:
                    if at is not None:
                        out.append((at, pages, avg, last))
                    at, pages, avg, last = d, int(p), int(a), t
                else:
                    pages, avg, last = pages + int(p), int(alpha * int(a) + (1 - alpha) * avg), max(last, t)
            yield pd.DataFrame(out, columns=["domain", "pages", "avg_ms", "last"])
        if at is not None:
            yield pd.DataFrame([(at, pages, avg, last)], columns=["domain", "pages", "avg_ms", "last"])

    return ordered.select("domain", "pages", "avg_ms", "last").mapInPandas(fold, "domain string, pages bigint, avg_ms bigint, last timestamp_ntz")


def stale_seeds(seeds: DataFrame, as_of: datetime, limit: int = 100) -> DataFrame:
    """Seeds whose interval has passed, the longest waiting first."""
    last = F.coalesce("last_enqueued", F.lit("1970-01-01").cast("timestamp_ntz"))
    due = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) > F.col("recrawl_interval_seconds")
    return seeds.where(due).orderBy(last, "seed_id").limit(limit)


def stale_domains(domains: DataFrame, seeds: DataFrame, as_of: datetime, least_pages: int = 50, hours: int = 24, limit: int = 100) -> DataFrame:
    """Larger domains without a seed that were not crawled for a while, by size, then age."""
    rows = domains.join(seeds.select("domain").distinct(), "domain", "left_anti").where(F.col("pages_count") >= least_pages)
    old = F.col("last_crawled").isNull() | (F.col("last_crawled") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))
    return rows.where(old).orderBy(F.col("pages_count").desc(), F.col("last_crawled").asc_nulls_first(), "domain_id").limit(limit)


def scheduler_tick(queue: DataFrame, seeds: DataFrame, domains: DataFrame, as_of: datetime) -> DataFrame:
    """(source, url, score) of what one tick enqueues: due seeds, homepages of stale domains, pending jobs."""
    s = stale_seeds(seeds, as_of).select(F.lit("seed").alias("source"), "url", F.lit(SEED).alias("score"))
    d = stale_domains(domains, seeds, as_of).select(F.lit("domain").alias("source"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.lit(RECRAWL).alias("score"))
    q = reset_stalled(queue, as_of).where("status = 'pending'").orderBy(F.col("score").desc(), "added_at", "queue_id").limit(100).select(F.lit("queue").alias("source"), "url", "score")
    return s.unionByName(d).unionByName(q)
