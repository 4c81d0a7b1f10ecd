"""HTML to rows: one parse of each page gives headings, text, links, images, structured data and dates.

The parse is an Arrow-batched ``mapInPandas`` over the standard library's tokenizer; what can be said by native
expressions (links in style sheets, scripts and feeds) stays in the JVM. NULL and empty bodies give empty
fields; broken markup never fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls as U

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body title".split())
# Elements and class names that hold no content.
NO_TEXT = frozenset("script style noscript iframe svg template canvas video audio object embed applet head".split())
FURNITURE = frozenset("nav footer header aside form button input select textarea label fieldset legend dialog menu menuitem slot source track map area".split())
FURNITURE_CLASSES = frozenset(
    "ad ads advertisement ad-container google-ad sidebar comments comment-list comment-section related-posts newsletter cookie-banner popup modal social-share share-buttons author-bio toc table-of-contents".split()
)
MAX_H1, MAX_H2, MAX_CONTENT, MAX_ANCHOR, MAX_IMAGES = 1200, 2000, 100 * 1024, 500, 50


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is self or not skip(n):
                if n.tag in BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack += reversed(n.children)
        return "".join(out)

    def classes(self) -> set[str]:
        return {*self.attrs.get("class", "").lower().split(), self.attrs.get("id", "").lower()}


class _Builder(HTMLParser):
    #: An opening tag on the left ends an open element on the right.
    ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in self.ENDS.get(tag, ()):
            self._up()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        # Deeply nested junk is kept flat beyond a bound, so that no page can exhaust the stack.
        if tag not in VOID and self.depth < 400:
            self.at, self.depth = node, self.depth + 1

    def _up(self) -> None:
        if self.at.parent is not None:
            self.at, self.depth = self.at.parent, self.depth - 1

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            while self.at is not n:
                self._up()
            self._up()

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):
        pass  # what was read so far
    return b.root


def squeeze(s: str) -> str:
    return " ".join(s.split())


def cut(s: str, limit: int) -> str:
    """At most ``limit`` bytes, no character split."""
    raw = s.encode("utf-8", "ignore")
    return s if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def resolve(base: str, href: str) -> str:
    """Absolute http address without fragment, or ''."""
    try:
        full = urljoin(base, href.strip())
        parts = urlsplit(full)
    except ValueError:
        return ""
    return full.split("#")[0] if parts.scheme in ("http", "https") and parts.netloc else ""


# --- dates --------------------------------------------------------------------------------------------------

# Layouts of dates in pages.
LAYOUTS = """%Y-%m-%dT%H:%M:%S%z|%Y-%m-%dT%H:%M:%S.%f%z|%Y-%m-%dT%H:%M:%S|%Y-%m-%d|%Y-%m-%d %H:%M:%S|%B %d, %Y|%b %d, %Y|%d %B %Y|%d %b %Y|%d/%m/%Y|%m/%d/%Y|%d-%m-%Y|%Y/%m/%d|%d de %B de %Y|%d de %b de %Y""".split("|")


def parse_date(s: str | None) -> datetime | None:
    """First layout that fits, years from 1990 to 2100; UTC without zone."""
    s = (s or "").strip()
    for es, en in X.MONTHS.items():
        s = re.sub(es, en, s, flags=re.I)
    for layout in LAYOUTS:
        try:
            t = datetime.strptime(s, layout)
        except ValueError:
            continue
        if 1990 <= t.year <= 2100:
            return (t - t.utcoffset()).replace(tzinfo=None) if t.utcoffset() is not None else t
    return None


# Names under which pages give their dates, in the order of trust.
PUBLISHED = "article:published_time og:article:published_time datePublished dateCreated date pubdate publish_date published_date publication_date DC.date dc.date og:published_time".split()
MODIFIED = "article:modified_time og:updated_time dateModified lastmod".split()
TIME_CLASSES = "published posted entry-date article-date".split()
_URL_DATE = re.compile(r"/((?:19|20)\d\d)([/-])(0?[1-9]|1[0-2])\2(0?[1-9]|[12]\d|3[01])(?:/|$|[-_])")


def _named(metas: list[Node], name: str) -> list[str]:
    return [m.attrs.get("content", "") for m in metas if name in (m.attrs.get("property"), m.attrs.get("name"), m.attrs.get("itemprop"))]


def _newest(times: list[Node]) -> datetime | None:
    got = [d for t in times if (d := parse_date(t.attrs.get("datetime")) or parse_date(t.attrs.get("content")) or parse_date(squeeze(t.text())))]
    return max(got, default=None)


def published_at(root: Node, url: str) -> datetime | None:
    """Meta dates, then times marked as published, then modified dates, then any time, then the address."""
    metas, times = root.find("meta"), root.find("time")
    for name in PUBLISHED:
        for c in _named(metas, name):
            if d := parse_date(c):
                return d
    marked = [t for t in times if t.attrs.get("itemprop") == "datePublished"], [t for t in times if "pubdate" in t.attrs], *([t for t in times if c in t.classes()] for c in TIME_CLASSES)
    for group in marked:
        if d := _newest(group):
            return d
    for name in MODIFIED:
        for c in _named(metas, name):
            if d := parse_date(c):
                return d
    m = _URL_DATE.search(url)
    return _newest(times) or (parse_date(f"{m[1]}-{m[3]:0>2}-{m[4]:0>2}") if m else None)


# --- structured data ----------------------------------------------------------------------------------------

# Types that describe the site and not the page.
SITE_TYPES = {"BreadcrumbList", "WebSite", "Organization"}


def scalar(v: object) -> str:
    """A value of structured data as one string: itself, the name of an object, the first of a list."""
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, bool) or v is None:
        return ""
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, list):
        return next((s for x in v if (s := scalar(x))), "")
    return scalar(v.get("name") or v.get("@id") or v.get("@value")) if isinstance(v, dict) else ""


def image_of(v: object) -> str:
    if isinstance(v, dict):
        return scalar(v.get("url") or v.get("contentUrl") or "")
    if isinstance(v, list):
        return next((s for x in v if (s := image_of(x))), "")
    return scalar(v)


def structured(root: Node, base: str) -> dict[str, object]:
    """First value of each field over all blocks of a page."""
    out: dict[str, object] = {"type": "", "title": "", "description": "", "image": "", "author": "", "keywords": "", "rating": None, "date": None}
    for script in root.find("script"):
        if script.attrs.get("type", "").lower() != "application/ld+json":
            continue
        try:
            data = json.loads(script.text())
        except ValueError:
            continue
        graph = data.get("@graph") if isinstance(data, dict) else None
        for o in graph if isinstance(graph, list) else data if isinstance(data, list) else [data]:
            if not isinstance(o, dict) or scalar(o.get("@type")) in SITE_TYPES:
                continue
            author, rating = o.get("author"), o.get("aggregateRating")
            image = image_of(o.get("image")) or image_of(o.get("thumbnailUrl"))
            found = {
                "type": scalar(o.get("@type")),
                "title": scalar(o.get("headline")) or scalar(o.get("name")),
                "description": scalar(o.get("description")),
                "image": resolve(base, image) if image else "",
                "author": scalar(author),
                "keywords": scalar(o.get("keywords")) or scalar(o.get("articleSection")),
                "rating": _number(rating.get("ratingValue")) if isinstance(rating, dict) else None,
                "date": next((d for k in ("datePublished", "dateCreated", "dateModified", "uploadDate") if (d := parse_date(o.get(k) if isinstance(o.get(k), str) else None))), None),
            }
            for k, v in found.items():
                out[k] = out[k] or v
    return out


def _number(v: object) -> float | None:
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


# --- parts of a page ----------------------------------------------------------------------------------------


def is_furniture(n: Node) -> bool:
    return n.tag in NO_TEXT or n.tag in FURNITURE or not FURNITURE_CLASSES.isdisjoint(n.classes())


def main_element(root: Node) -> Node | None:
    """Element with the most running text: the length of its paragraphs, half of it passed to its parent, links taken off."""
    score: dict[int, float] = {}
    by_id: dict[int, Node] = {}
    for p in root.find("p", "pre", "blockquote", "td"):
        up: Node | None = p
        inside = False
        while up is not None:
            inside |= is_furniture(up)
            up = up.parent
        text = squeeze(p.text())
        if inside or len(text) < 25 or p.parent is None:
            continue
        linked = sum(len(squeeze(a.text())) for a in p.find("a"))
        points = 1 + text.count(",") + min(len(text) / 100, 3) * (1 - linked / len(text))
        for node, share in ((p.parent, 1.0), (p.parent.parent, 0.5)):
            if node is not None and node.tag:
                score[id(node)] = score.get(id(node), 0.0) + points * share
                by_id[id(node)] = node
    return by_id[max(score, key=lambda k: score[k])] if score else None


def headings(root: Node, tag: str, limit: int) -> str:
    return cut(" ".join(dict.fromkeys(t for n in root.find(tag) if (t := squeeze(n.text())))), limit)


def links_of(root: Node, base: str) -> list[tuple[str, str]]:
    """(address, anchor) of the crawlable links, each once, in order."""
    out: dict[str, str] = {}
    for a in root.find("a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")) or "nofollow" in a.attrs.get("rel", ""):
            continue
        full = resolve(base, href)
        path = urlsplit(full).path.lower() if full else ""
        ext = re.search(r"\.[^./]*$", path)
        if not full or (ext and ext.group() in U.BINARY) or path.startswith(tuple(U.NO_CONTENT)) or any(c in path for c in U.CHALLENGE):
            continue
        out.setdefault(full, cut(squeeze(a.text()), MAX_ANCHOR))
    return list(out.items())


def resources_of(root: Node, base: str) -> list[str]:
    found = [n.attrs.get(k, "") for tag, k in (("script", "src"), ("link", "href"), ("iframe", "src")) for n in root.find(tag)]
    return list(dict.fromkeys(r for f in found if f and (r := resolve(base, f))))


def images_of(root: Node, base: str) -> list[dict[str, object]]:
    """The preview image first, then images that are no data, no icons and no trackers."""
    title = next((squeeze(n.text()) for n in root.find("title")), "")
    out: dict[str, dict[str, object]] = {}
    for m in root.find("meta"):
        if m.attrs.get("property") == "og:image" and (u := resolve(base, m.attrs.get("content", ""))):
            out.setdefault(u, {"url": u, "alt": title, "title": "", "context": title, "width": 0, "height": 0})
    for n in root.find("img"):
        src = n.attrs.get("src", "").strip()
        u = resolve(base, src) if src and not src.startswith("data:") else ""
        ext = re.search(r"\.[^./]*$", urlsplit(u).path.lower()) if u else None
        size = [int(v) if (v := n.attrs.get(k, "0")).isdigit() else 0 for k in ("width", "height")]
        if not u or (ext and ext.group() not in U.IMAGE) or any(0 < s < 50 for s in size):
            continue
        context = cut(squeeze(n.parent.text()), 200) if n.parent is not None else ""
        out.setdefault(u, {"url": u, "alt": n.attrs.get("alt", "").strip(), "title": n.attrs.get("title", "").strip(), "context": context, "width": size[0], "height": size[1]})
    return list(out.values())[:MAX_IMAGES]


def language_of(root: Node, url: str) -> str:
    """html@lang, then http-equiv, then meta language, then the address."""
    metas = root.find("meta")
    found = [n.attrs.get("lang", "") for n in root.find("html")]
    found += [m.attrs.get("content", "") for m in metas if m.attrs.get("http-equiv", "").lower() == "content-language"] + _named(metas, "language")
    parts = urlsplit(url)
    found += [s for s in parts.path.strip("/").split("/")[:1] if re.fullmatch(r"[A-Za-z]{2,3}([-_].*)?", s)] + [s for s in (parts.hostname or "").split(".")[:1] if re.fullmatch(r"[a-z]{2,3}", s) and s not in ("www", "m")]
    for f in found:
        tag = re.split(r"[-_]", f.strip().lower())[0]
        if 2 <= len(tag.encode()) <= 3:
            return tag
    return ""


def parse(html: str, url: str) -> dict[str, object]:
    """All fields of one page."""
    root = tree(html or "")
    metas = root.find("meta")
    data = structured(root, url)
    title = next((t for n in root.find("title") if (t := squeeze(n.text()))), "") or next(iter(_named(metas, "og:title")[-1:]), "")
    canonical = ""
    for n in root.find("link"):
        if "canonical" in n.attrs.get("rel", "").lower().split():
            canonical = resolve(url, n.attrs.get("href", "")) or canonical
    main = main_element(root)
    content = squeeze(main.text(is_furniture)) if main is not None else ""
    h1, h2 = headings(main, "h1", MAX_H1) if main is not None else "", ""
    links = links_of(root, url)
    if len(content.encode()) > 100 and main is not None:
        h1 = h1 or title
        inner = links_of(main, url)
        links = list(dict(inner + links).items())
    else:
        area = next(iter([n for n in root.walk() if n.tag in ("main", "article") or n.attrs.get("role") == "main"] or root.find("body")), root)
        content, h1, h2 = squeeze(area.text(is_furniture)), headings(area, "h1", MAX_H1), headings(area, "h2", MAX_H2)
    description = next((squeeze(d) for d in _named(metas, "description") + _named(metas, "og:description") if d.strip()), "")
    return {
        "title": title, "h1": h1, "h2": h2, "description": description, "canonical": canonical, "language": language_of(root, url), "content": cut(content or description or str(data["description"]), MAX_CONTENT),
        "links": [{"url": u, "anchor": a} for u, a in links], "resources": resources_of(root, url), "images": images_of(root, url),
        "schema_type": data["type"], "schema_title": data["title"], "schema_description": data["description"], "schema_image": data["image"], "schema_author": data["author"], "schema_keywords": data["keywords"], "schema_rating": data["rating"],
        "published_at": data["date"] or published_at(root, url),
    }


PARSED = (
    "title string, h1 string, h2 string, description string, canonical string, language string, content string, links array<struct<url: string, anchor: string>>, resources array<string>, "
    "images array<struct<url: string, alt: string, title: string, context: string, width: int, height: int>>, schema_type string, schema_title string, schema_description string, schema_image string, schema_author string, schema_keywords string, schema_rating double, published_at timestamp_ntz"
)


def parse_pages(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(url, parsed fields) of rows with a url and its HTML."""
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", PARSED)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(h, u or "") for u, h in zip(pdf["u"], pdf["h"])]
            out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="object") for n in names})
            out["published_at"] = pd.to_datetime(out["published_at"])
            out["schema_rating"] = out["schema_rating"].astype("float64")
            out.insert(0, key, pdf["u"])
            yield out

    return pages.select(F.col(key).alias("u"), F.col(html).alias("h")).mapInPandas(run, f"`{key}` string, {PARSED}")


# --- native parts -------------------------------------------------------------------------------------------


def resource_links(body: Column, content_type: Column) -> Column:
    """Raw addresses in style sheets, scripts and feeds, by the kind of the body."""
    kind = U.asset_kind(content_type)
    css = F.regexp_extract_all(body, F.lit(r"""(?:url|@import)\s*\(\s*['"]?([^'"()]+)['"]?\s*\)"""), F.lit(1))
    quoted = F.concat(F.regexp_extract_all(body, F.lit(r"""["']((?:https?://|//)[^"']+)["']"""), F.lit(1)), F.regexp_extract_all(body, F.lit(r"""["'](/[^"'/][^"']*)["']"""), F.lit(1)))
    xml = F.regexp_extract_all(body, F.lit(r"""\b(?:href|src|url|loc)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    found = F.when(kind == "css", css).when(kind.isin("js", "json"), quoted).when(kind.isin("xml", "rss", "atom"), xml).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def to_utf8(raw: bytes, content_type: str = "") -> str:
    """Text of a body: UTF-8 if it is valid, else the declared encoding, else the first common one that fits."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    head = raw[:2048].decode("latin-1")
    named = re.findall(r"charset\s*=\s*[\"']?([\w-]+)", content_type + " " + head, re.I)
    for enc in [*named, "shift_jis" if b"\x82" in raw[:4096] else "cp1252", "cp1252", "iso8859-15", "gbk", "euc-jp", "shift_jis"]:
        try:
            return raw.decode(enc)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else to_utf8(bytes(b), c or "") for b, c in zip(body, content_type)])


@F.pandas_udf(T.BooleanType())
def robots_allowed(robots: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    """Robots test that lets all pass where there is no text."""
    from urllib.robotparser import RobotFileParser

    parsers: dict[str, RobotFileParser] = {}
    out = []
    for text, u, a in zip(robots, url, agent):
        if not text or not u:
            out.append(True)
            continue
        if text not in parsers:
            p = RobotFileParser()
            p.parse(text.splitlines())
            parsers[text] = p
        out.append(parsers[text].can_fetch(a, u))
    return pd.Series(out)
