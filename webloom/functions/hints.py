"""Landing pages of large platforms: a table of path shapes, the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import domain, path

LARGE, MEDIUM = 6000.0, 4000.0
LIGHT, MIDDLE, HEAVY = 1000.0, 2500.0, 4000.0
_META = "(?:special|talk|user|wikipedia|help|category|file|template):"
_GITHUB = "(?:features|marketplace|explore|topics|trending|collections|sponsors|settings|notifications|login|signup|join|about|pricing|enterprise|team|orgs|organizations)"
_TWITCH = "(?:directory|downloads|jobs|turbo|settings|friends|subscriptions|inventory|wallet|search|team|p|videos)"

# Platform, domains, and shapes (path pattern, points as a hub or None, penalty, group of the hub's name).
RULES: dict[str, tuple[str, list[tuple[str, float | None, float, int]]]] = {
    "reddit": ("reddit[.]com", [("/r/([^/]+)", LARGE, 0, 1), ("/r/[^/]+/comments(?:/.*)?", None, MIDDLE, 0), ("/r/[^/]+/.*", None, LIGHT, 0)]),
    "github": ("github[.]com", [(f"/{_GITHUB}(?:/.*)?", None, 0, 0), ("/[^/]+/([^/]+)", LARGE, 0, 1), ("/([^/]+)", MEDIUM, 0, 1), ("/[^/]+/[^/]+/(?:releases|tags)(?:/.*)?", None, HEAVY, 0), ("/[^/]+/[^/]+/(?:issues|pull|discussions)/.+", None, MIDDLE, 0), ("/[^/]+/[^/]+/(?:tree|blob|commits?)(?:/.*)?", None, MIDDLE, 0), ("/[^/]+/[^/]+/.*", None, LIGHT, 0)]),
    "youtube": ("youtube[.]com|youtu[.]be", [("/@([^/]+)(?:/[^/]+)?", LARGE, 0, 1), ("/(?:c|channel|user)/([^/]+)(?:/[^/]+)?", LARGE, 0, 1), ("/watch(?:/.*)?", None, MIDDLE, 0), ("/shorts(?:/.*)?", None, HEAVY, 0), ("/playlist(?:/.*)?", None, LIGHT, 0)]),
    "wikipedia": ("wikipedia[.]org", [(f"/wiki/{_META}[^/]*", None, HEAVY, 0), ("/wiki/[^/]+", MEDIUM, 0, 0), ("/wiki/[^/]+/.*", None, LIGHT, 0)]),
    "stackoverflow": ("stackoverflow[.]com|stackexchange[.]com|superuser[.]com|serverfault[.]com|askubuntu[.]com", [("/questions/tagged(?:/.*)?", None, LIGHT, 0), ("/questions/.+", MEDIUM, 0, 0), ("/users(?:/.*)?", None, MIDDLE, 0)]),
    "gitlab": ("gitlab[.]com", [("/(?:explore|help|admin|users|groups|dashboard)(?:/.*)?", None, 0, 0), ("/[^/]+/([^/]+)", LARGE, 0, 1), ("/[^/]+/[^/]+/-/(?:releases|tags)(?:/.*)?", None, HEAVY, 0), ("/[^/]+/[^/]+/-/(?:issues|merge_requests)/.+", None, MIDDLE, 0), ("/[^/]+/[^/]+/-/.+", None, LIGHT, 0)]),
    "npm": ("npmjs[.]com", [("/package/(@[^/]+/[^/]+)", LARGE, 0, 1), ("/package/([^@/][^/]*)", LARGE, 0, 1), ("/package/.+", None, MIDDLE, 0)]),
    "pypi": ("pypi[.]org", [("/project/([^/]+)", LARGE, 0, 1), ("/project/.+", None, MIDDLE, 0)]),
    "docker": ("hub[.]docker[.]com", [("/[r_]/[^/]+/[^/]+", MEDIUM, 0, 0), ("/_/[^/]+", MEDIUM, 0, 0), ("/[^/]+/[^/]+/[^/]+/.+", None, LIGHT, 0)]),
    "twitch": ("twitch[.]tv", [(f"/{_TWITCH}(?:/.*)?", None, 0, 0), ("/([^/]+)", LARGE, 0, 1), ("/[^/]+/clips?(?:/.*)?", None, MIDDLE, 0), ("/[^/]+/.+", None, LIGHT, 0)]),
    "steam": ("store[.]steampowered[.]com|steampowered[.]com|steamcommunity[.]com", [("/app/[^/]+(?:/[^/]+)?", MEDIUM, 0, 0), ("/app/.+", None, LIGHT, 0)]),
    "mercadolibre": ("mercadolibre[.](?:com[.](?:uy|ar|mx|br|co|ve|pe|ec)|cl)", [("/[^/]+/[^/]+/[^/]+/.+", None, LIGHT, 0)]),
    "nuget": ("nuget[.]org", [("/packages/([^/]+)", LARGE, 0, 1), ("/packages/.+", None, MIDDLE, 0)]),
    "amazon": ("amazon[.](?:com|co[.]uk|de|fr|es|it|co[.]jp|ca|com[.](?:au|br|mx|tr)|in|nl|sg|ae|sa|pl|se)", [("/dp/[^/]+(?:/[^/]+)?", MEDIUM, 0, 0), ("/dp/.+", None, LIGHT, 0), ("/gp/product/[^/]+(?:/[^/]+)?", MEDIUM, 0, 0), ("/gp/product/.+", None, LIGHT, 0), ("/(?:product-reviews|offer-listing)(?:/.*)?", None, MIDDLE, 0), ("/s(?:/.*)?", None, HEAVY, 0)]),
}


def classify(url: Column, platform: str = "") -> Column:
    """Struct (platform, hub, name, boost, penalty) of an address; empty where no platform's domain fits."""
    host = domain(url)
    clean = F.lower(F.concat(F.lit("/"), F.array_join(F.filter(F.split(path(url), "/"), lambda x: x != ""), "/")))

    def answer(name: str, hub: bool, label: Column, boost: float, penalty: float) -> Column:
        return F.struct(F.lit(name).alias("platform"), F.lit(hub).alias("hub"), label.alias("name"), F.lit(boost).alias("boost"), F.lit(penalty).alias("penalty"))

    out = F.when(F.lit(False), answer("", False, F.lit(""), 0.0, 0.0))
    for name, (domains, shapes) in RULES.items():
        if platform and name != platform:
            continue
        there = host.rlike(f"^(?:.*[.])?(?:{domains})$")
        for shape, points, penalty, group in shapes:
            label = F.regexp_extract(clean, f"^{shape}$", group) if group else F.lit("")
            out = out.when(there & clean.rlike(f"^{shape}$"), answer(name, points is not None, label, points or 0.0, float(penalty)))
        out = out.when(there, answer(name, False, F.lit(""), 0.0, 0.0))
    return out.otherwise(answer("", False, F.lit(""), 0.0, 0.0))
