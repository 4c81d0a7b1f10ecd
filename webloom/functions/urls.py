"""URL functions as native column expressions.

All parts are cut out by anchored regular expressions, so that no expression raises on malformed input; a NULL
url gives NULL parts. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTH = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"

# Query parameters that don't name a document.
TRACKING = """fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid zanpid _gl auth sid phpsessid jsessionid expires expiry exp""".split()
VIEW_STATE = """f filter sort order view layout theme feedviewtype feedsort sort_by sort_order dir direction mode type q query s search action diff oldid printable
ref source t ref_src ref_url referer referrer context""".split()
_DROP_PATTERN = r"^(utm_|_hs|mkt_|x-amz-)|token|session|signature"

# File endings by class.
BINARY = """.pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .rar .7z .bz2 .xz .jpg .jpeg .png .gif .bmp .svg .webp .ico .tif .tiff .heic .heif .avif .apng
.mp3 .mp4 .avi .mkv .mov .wmv .flv .wav .webm .m4a .ogg .ogv .flac .exe .msi .dmg .apk .deb .rpm .woff .woff2 .ttf .eot .otf .wasm .swf .map .mjs .webmanifest .iso .bin .img""".split()
ASSET = ".css .js .json .xml .rss .atom".split()
IMAGE = ".jpg .jpeg .png .gif .bmp .svg .webp .ico .tif .tiff .heic .heif .avif .apng".split()
# Paths that hold no content, and marks of challenge pages.
NO_CONTENT = """/wp-admin /wp-login /admin /login /logout /signup /register /cart /checkout /account /api/ /cgi-bin/ /wiki/special: /wiki/talk: /wiki/user: /wiki/user_talk:
/wiki/wikipedia: /wiki/file: /wiki/mediawiki: /wiki/template: /wiki/help: /wiki/category: /wiki/portal: /wiki/draft: /wiki/module:""".split()
CHALLENGE = "/cdn-cgi/ /challenge-platform/ /captcha/ /recaptcha/ /turnstile/ /__cf_chl_ /cf-challenge".split()
# Suffixes under which domains are registered, beyond the last label.
TWO_LEVEL = "com.uy com.ar com.br com.mx com.co com.au co.uk org.uk gov.uk ac.uk co.jp co.nz co.za com.tr com.cn com.pe com.ve com.ec com.py com.bo com.es gub.uy edu.uy org.uy gov.ar gov.br".split()


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def host(u: Column) -> Column:
    """Host name in lower case, without user and port."""
    auth = F.regexp_replace(F.regexp_extract(u, _AUTH, 1), r"^[^@]*@", "")
    return F.lower(F.regexp_replace(auth, r":[0-9]*$", ""))


def port(u: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(u, _AUTH, 1), r":([0-9]+)$", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PATH, 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, _QUERY, 1)


def domain(u: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(u), r"^www\.", "")


def _key(pair: Column) -> Column:
    return F.regexp_extract(pair, r"^([^=]*)", 1)


def drop_param(key: Column) -> Column:
    """Parameters that don't name a document: tracking, sessions, view state, searches."""
    k = F.lower(F.trim(key))
    return (k == "") | k.rlike(_DROP_PATTERN) | k.isin(TRACKING + VIEW_STATE)


def drop_param_cosmetic(key: Column) -> Column:
    """The smaller set: tracking and sessions only."""
    k = F.lower(F.trim(key))
    return (k == "") | k.rlike(_DROP_PATTERN) | k.isin(TRACKING)


def is_http(u: Column) -> Column:
    return scheme(F.trim(u)).isin("http", "https")


def canonical(url: Column) -> Column:
    """One form for all spellings of an address; NULL for anything but http and https.

    Scheme and host in lower case, no default port, no fragment, no trailing slashes, parameters that don't name
    a document dropped, the rest sorted by key, then value.
    """
    u = F.trim(url)
    s, p = scheme(u), port(u)
    default = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443")) | (p == "")
    bare = F.regexp_replace(path(u), "/+$", "")
    pairs = F.filter(F.split(query(u), "&"), lambda x: (x != "") & ~drop_param(_key(x)))
    full = F.transform(pairs, lambda x: F.when(F.instr(x, "=") > 0, x).otherwise(F.concat(x, F.lit("="))))
    # Ordered by key first: '=' sorts after digits, so the key is compared on its own.
    ordered = F.transform(F.array_sort(F.transform(full, lambda x: F.struct(_key(x).alias("k"), x.alias("x")))), lambda y: y["x"])
    kept = F.array_join(ordered, "&")
    out = F.concat(s, F.lit("://"), host(u), F.when(default, "").otherwise(F.concat(F.lit(":"), p)), F.when(bare == "", "/").otherwise(bare), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(s.isin("http", "https"), out)


def _segment(x: Column) -> Column:
    letter = x.rlike("[a-fA-F]")
    return (
        F.when(x.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}")
        .when(x.rlike("^[0-9a-fA-F]{64}$") & letter, "{sha256}")
        .when(x.rlike("^[0-9a-fA-F]{40}$") & letter, "{sha1}")
        .when(x.rlike("^[0-9a-fA-F]{32}$") & letter, "{md5}")
        .when(x.rlike("^[0-9a-fA-F]{24}$") & letter, "{oid}")
        .when(x.rlike("^[0-9a-fA-F]{8,}$") & letter, "{hex}")
        .when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "{date}")
        .when(x.rlike("^[0-9]{10}([0-9]{3})?$"), "{ts}")
        .when(x.rlike("^[0-9]+$"), "{num}")
        .otherwise(x)
    )


def fingerprint(u: Column) -> Column:
    """Shape of an address: variable path segments become placeholders, parameters keep their sorted keys only."""
    p = path(u)
    inner = F.regexp_replace(p, "^/+|/+$", "")
    shaped = F.concat(F.lit("/"), F.array_join(F.transform(F.split(inner, "/"), _segment), "/"), F.when(p.endswith("/"), "/").otherwise(""))
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query(u), "&"), lambda x: x != ""), _key))), "&")
    auth = F.regexp_extract(u, _AUTH, 1)
    return F.concat(scheme(u), F.lit("://"), auth, F.when(inner == "", p).otherwise(shaped), F.when(keys == "", "").otherwise(F.concat(F.lit("?"), keys)))


def fnv1a(s: Column) -> Column:
    """FNV-1a, 64 bits, as a signed long. The state is kept in two 32-bit halves, so no product overflows."""
    data = F.hex(F.encode(s, "UTF-8"))
    size = F.octet_length(s)
    low32 = (1 << 32) - 1
    start = F.struct(F.lit(3421674724).alias("hi"), F.lit(2216829733).alias("lo"))

    def step(state: Column, i: Column) -> Column:
        byte = F.conv(F.substr(data, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
        x = state["lo"].bitwiseXOR(byte)
        hi = (state["hi"] * 435 + F.shiftleft(x, 8) + F.shiftrightunsigned(x * 435, 32)).bitwiseAND(F.lit(low32))
        return F.struct(hi.alias("hi"), (x * 435).bitwiseAND(F.lit(low32)).alias("lo"))

    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(places, start, step)
    return F.shiftleft(end["hi"], 32).bitwiseOR(end["lo"])


def extension(u: Column) -> Column:
    return F.lower(F.regexp_extract(path(u), r"(\.[^./]*)$", 1))


def is_binary(u: Column) -> Column:
    return extension(u).isin(BINARY)


def is_asset(u: Column) -> Column:
    return extension(u).isin(ASSET)


def is_image(u: Column) -> Column:
    return (extension(u) == "") | extension(u).isin(IMAGE)


def disallowed_path(p: Column) -> Column:
    low = F.lower(p)
    return low.rlike("^(" + "|".join(NO_CONTENT) + ")") | low.rlike("|".join(CHALLENGE))


def non_indexable(u: Column) -> Column:
    return is_binary(u) | is_asset(u) | disallowed_path(path(u))


def parents(d: Column) -> Column:
    """A domain and its parents, e.g. a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(d, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_homepage(u: Column) -> Column:
    p = F.regexp_replace(path(u), "^/+|/+$", "")
    return (query(u) == "") & (F.regexp_extract(u, "#(.*)$", 1) == "") & ((p == "") | p.rlike("^[a-z]{2}(-[a-zA-Z0-9]{2,4})?$"))


def registered_domain(d: Column, suffixes: list[str] = TWO_LEVEL) -> Column:
    """Suffix plus one label; suffixes of two labels come from the given list."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(d)), r"^www\.", ""), r"\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    last3 = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(last2.isin(suffixes), last3).otherwise(last2)


def root_label(d: Column) -> Column:
    return F.regexp_extract(registered_domain(d), r"^([^.]*)", 1)


def search_results_page(u: Column) -> Column:
    """Pages of results of public search engines and of their self-hosted kin."""
    h, p = host(u), F.lower(path(u))
    keys = F.transform(F.split(query(u), "&"), _key)
    has = lambda *k: F.arrays_overlap(keys, F.array(*[F.lit(x) for x in k]))
    term, at_search, at_root = has("q", "query", "p", "text", "s"), p == "/search", p == "/"
    bare = F.regexp_replace(h, r"^www\.", "")
    searx = at_search & has("q") & has("categories", "language", "engines", "theme", "time_range", "safesearch")
    whoogle = (at_search | at_root) & has("q") & has("safe", "tbm", "start", "region", "near")
    return (
        F.when(bare.startswith("google."), at_search | p.startswith("/search/") | (p == "/imgres") | p.startswith("/sorry/"))
        .when(bare == "duckduckgo.com", (at_root & term) | (p == "/html"))
        .when(bare.isin("bing.com", "ecosia.org", "mojeek.com", "stract.com") | h.isin("search.yahoo.com", "search.brave.com") | bare.startswith("yandex."), at_search)
        .when(bare == "baidu.com", p == "/s")
        .when(bare == "metager.org", p.startswith("/meta/") | at_root)
        .when(bare == "mwmbl.org", at_root & term)
        .when(h.contains("yacy"), p.isin("/yacysearch.html", "/solr/select"))
        .when(bare == "startpage.com", (p == "/sp/search") | (at_root & term))
        .when(h.contains("searx") | searx, at_search)
        .when(h.contains("whoogle") | whoogle, (at_search | at_root) & has("q"))
        .otherwise(False)
    )


def language_tag(raw: Column) -> Column:
    """Primary tag in lower case; '' unless it has two or three bytes."""
    low = F.lower(F.trim(raw))
    head = F.when(low.rlike("^[-_]"), low).otherwise(F.regexp_extract(low, "^([^-_]*)", 1))
    return F.when(F.octet_length(head).between(2, 3), head).otherwise("")


def language_of_url(u: Column, letters_only: bool = True) -> Column:
    """Language from the first path segment, else from the first host label (not www, m).

    By default a tag has two or three letters; without ``letters_only`` any two or three characters pass.
    """
    tag = "([a-z]{2,3})" if letters_only else "([^-_/?#.]{2,3})"
    low = F.lower(u)
    first = F.regexp_extract(low, rf"^[a-z][a-z0-9+.-]*://[^/?#]*/+{tag}(?:[-_][^/?#]*)?(?:[/?#]|$)", 1)
    label = F.regexp_extract(low, rf"^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?{tag}(?:[-_][^./?#]*)?[.][^/?#]", 1)
    return F.when(first != "", first).when(label.isin("www", "m"), "").otherwise(label)


def date_of_url(u: Column) -> Column:
    """Date in a path like /2024/03/05/ or /2024-3-5-."""
    y, m, d = "/((?:19|20)[0-9]{2})", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])(?:/|$|[-_])"
    found = None
    for sep in ("/", "-"):
        pat = f"{y}{sep}{m}{sep}{d}"
        got = F.try_to_date(F.concat(F.regexp_extract(u, pat, 1), F.lit("-"), F.lpad(F.regexp_extract(u, pat, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(u, pat, 3), 2, "0")), "yyyy-MM-dd")
        found = got if found is None else F.coalesce(found, got)
    return F.when(F.year(found) >= 1990, found)


def region(d: Column) -> Column:
    """Country of a two-letter top domain that is not used as a generic one."""
    tld = F.lower(F.regexp_extract(d, r"\.([^.]*)$", 1))
    return F.when((F.length(tld) == 2) & ~tld.isin("io", "tv", "co", "me"), tld).otherwise("")


def html_type(ct: Column) -> Column:
    low = F.lower(F.coalesce(ct, F.lit("")))
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def discovery_type(ct: Column) -> Column:
    low = F.lower(F.coalesce(ct, F.lit("")))
    return html_type(ct) | low.rlike("text/css|(application|text)/javascript|application/(x-javascript|ecmascript|json|ld[+]json|xml|rss[+]xml|atom[+]xml)|text/xml")


def asset_kind(ct: Column) -> Column:
    low = F.lower(F.coalesce(ct, F.lit("")))
    return (
        F.when(low.contains("text/css"), "css")
        .when(low.rlike("javascript|ecmascript"), "js")
        .when(low.contains("json"), "json")
        .when(low.contains("rss"), "rss")
        .when(low.contains("atom"), "atom")
        .when(low.contains("xml"), "xml")
        .otherwise("other")
    )


def blocked_patterns(images: bool) -> list[str]:
    """Address patterns of files that a renderer need not load: four for each ending."""
    ends = [e for e in BINARY if e not in IMAGE and e not in (".mjs",)] + (IMAGE if images else [])
    return [f"{start}{e}{tail}" for e in ends for start in ("*://*/*", "*://*:*/*") for tail in ("", "?*")]


def client_address(forwarded: Column, real: Column, peer: Column) -> Column:
    """The first forwarded address, else the real one, else the peer's."""
    first = F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real), F.lit("")), peer)
