"""One function for each endpoint of a search and crawl service: tables in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import urls as U
from .operators import frontier, graph, profile, storage
from .operators import search as S
from .sources import shared_folder, table
from .sources.tables import spread, stamp


@dataclass
class Engine:
    """The tables of a folder and the index over its pages."""

    spark: SparkSession
    root: str
    index: S.Index | None = None
    indexed: tuple | None = None
    streams: list[StreamingQuery] = field(default_factory=list)
    stopping: bool = False

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def _index(self) -> S.Index:
        """Written once for each state of the pages, then read for each search."""
        now = stamp(self.spark, self.root, "pages")
        if self.index is None or self.indexed not in (None, now):
            folder = shared_folder(self.spark, "index")
            S.build(spread(self._t("pages"))).write(folder)
            self.index, self.indexed = S.Index.read(self.spark, folder), now
        return self.index

    @staticmethod
    def page_size(limit: int | None, default: int = 10, most: int = 100) -> int:
        return default if not limit or limit < 1 else min(limit, most)

    def search(self, query: str, as_of: datetime, limit: int = 10, offset: int = 0, lang: str = "", domain: str = "", schema_type: str = "") -> DataFrame:
        clicks = profile.click_counts(self._t("click_log")).withColumnRenamed("clicks", "n")
        return S.search(self._index(), self._t("pages"), query, as_of, self.page_size(limit), max(0, offset), lang, domain, schema_type, clicks, domains=self._t("domains"))

    def search_images(self, images: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return S.search_images(images, query, self.page_size(limit, 20), max(0, offset))

    def page_by_id(self, page_id: int) -> DataFrame:
        return self._t("pages").where(F.col("page_id") == page_id)

    def page_by_url(self, url: str) -> DataFrame:
        return self._t("pages").where(F.col("url") == url)

    def page_by_fingerprint(self, fingerprint: str) -> DataFrame:
        return self._t("pages").where(F.col("url_fingerprint") == fingerprint).orderBy("page_id").limit(1)

    def outlinks(self, page_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
        links = self._t("links").where(F.col("source_id") == page_id)
        return graph.outlinks(links, self._t("pages")).orderBy(F.col("created_at").desc(), "target").offset(offset).limit(self.page_size(limit, 50))

    def backlinks(self, url: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return graph.backlinks(self._t("links"), self._t("pages"), url, self.page_size(limit, 20), offset)

    def interact(self, query: str, url: str, at: datetime) -> DataFrame:
        """The row to append to the click log."""
        return self.spark.createDataFrame([(query, url, at)], "query string, url string, ts timestamp_ntz")

    def stats(self) -> DataFrame:
        counts = None
        for name in ("pages", "domains", "seed_urls", "links", "crawl_queue"):
            one = self._t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
            counts = one if counts is None else counts.unionByName(one)
        states = self._t("crawl_queue").groupBy(F.concat(F.lit("queue_"), "status").alias("what")).agg(F.count("*").alias("n"))
        return counts.unionByName(states)

    def crawl(self, urls: list[str], as_of: datetime, depth: int = 0, force: bool = False) -> DataFrame:
        """Up to a thousand addresses for the queue; those crawled in the last day are left out unless forced."""
        if len(urls) > 1000:
            raise ValueError("at most 1000 addresses a request")
        asked = self.spark.createDataFrame([(u,) for u in urls], "raw string").select(U.canonical(F.col("raw")).alias("url")).where("url is not null").distinct()
        if not force:
            day = F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 24 hours")
            asked = asked.join(self._t("pages").where(F.col("crawled_at") >= day).select("url"), "url", "left_anti")
        return asked.select("url", U.domain(F.col("url")).alias("domain"), F.lit(depth).alias("depth"), frontier.static_score(F.lit(frontier.SEED), F.lit(depth)).alias("score"))

    def queue(self) -> DataFrame:
        q = self._t("crawl_queue")
        return q.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.countDistinct(F.when(F.col("status") == "pending", F.col("domain"))).alias("domains"), F.count("*").alias("total"))

    def seeds(self) -> DataFrame:
        return self._t("seed_urls").orderBy("created_at", "seed_id")

    def add_seed(self, url: str, interval: int = 86_400) -> DataFrame:
        new = self.spark.createDataFrame([(url, interval)], "url string, recrawl_interval_seconds long").withColumn("domain", U.domain(F.col("url")))
        return storage.upsert_seeds(self._t("seed_urls"), new)

    def delete_seed(self, url: str) -> DataFrame:
        return self._t("seed_urls").where(F.col("url") != url)

    def interests(self) -> DataFrame:
        clicks = self._t("click_log")
        return profile.interest_terms(clicks.select("query"), clicks)

    def ingest(self, pages: DataFrame) -> DataFrame:
        return storage.ingest(pages)

    # --- life cycle of the streams that keep the tables up to date ---

    def start(self, *starts: Callable[[], StreamingQuery]) -> dict[str, object]:
        """Start the given streams; an engine that runs already refuses."""
        if self.status()["status"] == "running":
            raise RuntimeError("already running")
        self.streams, self.stopping = [start() for start in starts], False
        return self.status()

    def stop(self) -> dict[str, object]:
        """Ask all streams to end after the batch that they are in; an engine that doesn't run refuses."""
        if self.status()["status"] != "running":
            raise RuntimeError("not running")
        self.stopping = True
        for query in self.streams:
            query.stop()
        return self.status()

    def status(self) -> dict[str, object]:
        """idle, running or stopping, with the rows that the streams have read and how many of them failed."""
        active = [q for q in self.streams if q.isActive]
        state = "idle" if not active else "stopping" if self.stopping else "running"
        rows = sum(p["numInputRows"] for q in self.streams for p in q.recentProgress)
        return {"status": state, "rows": rows, "failed": sum(q.exception() is not None for q in self.streams)}

    def rank(self) -> DataFrame:
        """Rank and referring domains of each page."""
        pages, links = self._t("pages"), self._t("links")
        nodes = graph.nodes(pages)
        return graph.pagerank(graph.edges(links, pages), nodes).join(graph.referring_domains(links, pages), "node")

    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"))
