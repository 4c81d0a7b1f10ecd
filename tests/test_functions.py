import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import hints
from webloom.functions import text as X
from webloom.functions import urls as U


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "u string").withColumn("i", F.monotonically_increasing_id())
    return [r["x"] for r in df.select("i", make(F.col("u")).alias("x")).orderBy("i").collect()]


def test_canonical(spark):
    cases = {
        "HTTP://Example.COM:80/a/b/#frag": "http://example.com/a/b",
        "https://example.com:443": "https://example.com/",
        "https://example.com:8443/x": "https://example.com:8443/x",
        "https://e.com/p?b=2&utm_source=x&a=1&ref=y": "https://e.com/p?a=1&b=2",
        "https://e.com/p?page=2&page=1&sessionid=9": "https://e.com/p?page=1&page=2",
        "https://e.com/p?q=x": "https://e.com/p",
        "  https://e.com/a//  ": "https://e.com/a",
        "ftp://e.com/a": None,
        "": None,
        "no url": None,
        None: None,
    }
    assert one(spark, U.canonical, *cases) == list(cases.values())
    again = [c for c in cases.values() if c]
    assert one(spark, U.canonical, *again) == again


def test_fingerprint(spark):
    assert one(spark, U.fingerprint, "https://e.com/user/123/profile", "https://e.com/search?q=foo&a=1", "https://e.com/d/2024-01-02/1700000000/deadbeef01/", "https://e.com/", "https://e.com") == [
        "https://e.com/user/{num}/profile", "https://e.com/search?a&q", "https://e.com/d/{date}/{ts}/{hex}/", "https://e.com/", "https://e.com"]


def test_fnv(spark):
    assert one(spark, U.fnv1a, "https://example.com/", "https://a.b/c?x=1", "é", "") == [903888511234722068, -1026671092988612458, 775207407765167617, -3750763034362895579]


def test_url_classes(spark):
    assert one(spark, U.is_homepage, "https://e.com/", "https://e.com", "https://e.com/es-UY", "https://e.com/x/y", "https://e.com/?a=1") == [True, True, True, False, False]
    assert one(spark, U.language_of_url, "https://e.com/pt-BR/a", "https://es.wikipedia.org/wiki/A", "https://www.e.com/", "https://m.e.com/") == ["pt", "es", "", ""]
    assert one(spark, U.region, "elpais.com.uy", "vandal.elespanol.com", "x.io", None) == ["uy", "", "", ""]
    assert one(spark, U.registered_domain, "a.b.example.com.uy", "www.example.org", "localhost") == ["example.com.uy", "example.org", "localhost"]
    assert one(spark, U.disallowed_path, "/wp-admin/x", "/Wiki/Special:All", "/a/captcha/b", "/article") == [True, True, True, False]
    assert [str(d) for d in one(spark, U.date_of_url, "https://e.com/2024/3/05/slug", "https://e.com/2021-12-31-x", "https://e.com/2024/13/05/")] == ["2024-03-05", "2021-12-31", "None"]
    assert one(spark, U.parents, "a.b.c") == [["a.b.c", "b.c", "c"]]


HUBS = {
    "https://www.reddit.com/r/Warframe": True, "https://reddit.com/r/Warframe/": True, "https://reddit.com/r/Warframe/wiki/faq": False, "https://reddit.com/": False,
    "https://github.com/chromium/chromium": True, "https://github.com/nicbarker": True, "https://github.com/chromium/chromium/issues": False, "https://github.com/explore": False,
    "https://www.youtube.com/@name": True, "https://www.youtube.com/watch?v=1": False, "https://en.wikipedia.org/wiki/Talk:X": False, "https://stackoverflow.com/questions/1/x": True,
    "https://www.npmjs.com/package/@a/b": True, "https://www.npmjs.com/package/a/v/1": False, "https://www.twitch.tv/someone": True, "https://store.steampowered.com/app/1/x": True,
    "https://www.nuget.org/packages/A": True, "https://www.amazon.com/gp/product/B0": True, "https://www.amazon.com/s?k=x": False, "https://example.com/a": False,
}


def test_hints(spark):
    got = one(spark, hints.classify, *HUBS)
    assert [g["hub"] for g in got] == list(HUBS.values())
    assert all(g["boost"] > 0 for g in got if g["hub"])
    release, issue, issues = (g["penalty"] for g in one(spark, hints.classify, "https://github.com/a/b/releases/tag/1", "https://github.com/a/b/issues/1", "https://github.com/a/b/issues"))
    assert release > issue > issues


def test_dates(spark):
    got = one(spark, X.parse_date, "2024-03-05T10:00:00+02:00", "March 5, 2024", "5 de marzo de 2024", "05/03/2024", "2024/3/5", "1970-01-01", "nonsense", None)
    assert [str(g) for g in got] == ["2024-03-05 08:00:00", "2024-03-05 00:00:00", "2024-03-05 00:00:00", "2024-03-05 00:00:00", "2024-03-05 00:00:00", "None", "None", "None"]


def test_plain_and_stopwords(spark):
    assert one(spark, X.plain, "  El País — ¡Ñandú! 3 ", None, "") == ["el pais nandu 3", None, ""]
    df = spark.createDataFrame([(["el", "pais"],), (["from", "serie"],), (["the", "of"],), (["the"],)], "w array<string>")
    assert [r[0] for r in df.select(X.without_stopwords(F.col("w"))).collect()] == [["pais"], ["from", "serie"], ["the", "of"], ["the"]]
    assert one(spark, lambda c: X.truncated(c, 4), "aéé", "abc") == ["aé", "abc"]


def brute_osa(a, b):
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa(a, b):
    assert X.osa(a, b) == brute_osa(a, b) == X.osa(b, a)
    assert 0 <= X.edit_similarity(a, b) <= 1


def test_osa_known_cases():
    assert X.osa("ca", "abc") == 3 and X.osa("ca", "ac") == 1
    assert X.token_similarity("garden", "gardens") == 0.94 and X.token_similarity("abc", "xbc") == 0


def test_porter():
    p = X.Porter()
    cases = dict(x.split(":") for x in "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop filing:file happy:happi relational:relat conditional:condit triplicate:triplic hopeful:hope goodness:good revival:reviv adjustable:adjust adoption:adopt rate:rate controll:control roll:roll sky:sky running:run uruguay:uruguai".split())
    assert {w: p(w) for w in cases} == cases


@pytest.mark.parametrize("seed", range(3))
def test_phrase_score_bounds(seed):
    rng = random.Random(seed)
    for _ in range(50):
        q = [rng.choice("ab cd ef".split()) for _ in range(2)]
        f = [rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(6))]
        assert 0 <= X.phrase_score(" ".join(q), q, " ".join(f), f) <= 1
