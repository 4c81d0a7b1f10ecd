"""Settings of the engine with their ranges, and loading from a YAML or JSON file merged with seed files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    # crawl
    workers: int = 100
    max_depth: int = 5
    request_timeout_s: int = 15
    max_page_kb: int = 512
    max_retries: int = 3
    per_domain: int = 4
    delay_s: float = 1.0
    max_pages_per_fingerprint: int = 10_000
    links_per_page: int = 100
    blocked_domains: list[str] = field(default_factory=list)
    # scores
    seed_score: float = 100.0
    discovery_score: float = 50.0
    normal_score: float = 10.0
    recrawl_score: float = 5.0
    depth_k: float = 12.0
    anchor_weight: float = 40.0
    address_weight: float = 30.0
    source_title_weight: float = 20.0
    reputation_weight: float = 15.0
    min_queries: int = 3
    # search
    language: str = "en"
    language_boost: float = 3000.0
    secondary_boost: float = 1500.0
    platforms: list[str] = field(default_factory=list)
    site_types: list[str] = field(default_factory=list)
    # graph
    damping: float = 0.85
    rounds: int = 15
    # seeds: url, recrawl interval in seconds
    seeds: list[dict] = field(default_factory=list)

    RANGES = {
        "workers": (1, 10_000), "max_depth": (0, 100), "request_timeout_s": (1, 600), "max_page_kb": (1, 102_400), "max_retries": (0, 20), "per_domain": (1, 1000), "delay_s": (0, 3600),
        "max_pages_per_fingerprint": (1, 10**9), "links_per_page": (1, 10_000), "depth_k": (0, 1000), "damping": (0, 1), "rounds": (1, 1000), "min_queries": (0, 10**6),
    }

    def __post_init__(self) -> None:
        if not self.language:
            self.language = "en"
        if self.language_boost <= 0:
            self.language_boost = 3000.0
        for name, (low, high) in self.RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}, not {getattr(self, name)}")


def load(path: str, seed_folder: str | None = None) -> Settings:
    """Settings of a file; unknown keys are an error. Seed files are lists of seeds, added in the order of their names."""
    raw = _read(Path(path))
    known = {f.name for f in fields(Settings)}
    if bad := sorted(set(raw) - known):
        raise ValueError(f"unknown settings: {', '.join(bad)}")
    settings = Settings(**raw)
    for p in sorted(Path(seed_folder).glob("*.*")) if seed_folder else []:
        settings.seeds += _read(p)
    return settings


def _read(p: Path):
    text = p.read_text(encoding="utf-8")
    if p.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise RuntimeError("YAML files need PyYAML; use JSON instead") from None
    return yaml.safe_load(text) or {}


def seed_table(spark, settings: Settings):
    """(url, domain, recrawl_interval_seconds) of the configured seeds; a day where no interval is given."""
    from pyspark.sql import functions as F

    from .functions import urls as U

    rows = [(s["url"], int(s.get("recrawl_interval_seconds") or 86_400)) for s in settings.seeds]
    df = spark.createDataFrame(rows, "url string, recrawl_interval_seconds long")
    return df.select("url", U.domain(F.col("url")).alias("domain"), "recrawl_interval_seconds")
