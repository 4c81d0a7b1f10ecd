"""Evaluation passages inside training texts.

Search: every run of ``ANCHOR`` consecutive words of every passage is a pattern. A multi-pattern search with
block shifts walks over the normalised text from the right end of a window: the table of shifts says how far
the window may jump, a shift of 0 opens the bucket of patterns with that ending block, and direct comparison
confirms. Confirmed anchors are then extended word by word in both directions with a budget of errors.

A document is reported with an item when it holds a run of at least ``MIN_WORDS`` words of the item's passage
in which at most one word in ``ERROR_EVERY`` is changed, added, left out or misspelt. With n errors spread
over 15 words some 5 words in a row stay intact for n <= 2, so no such run is without an anchor.

Items of one set may be written with the same stock phrases, so that two texts share some fifteen words by chance,
all but their names and numbers. How much a word says is measured in bits: its surprisal after the word before it,
in the other passages of the set. A run with errors must match ``BITS_RATIO`` times the bits that it misses and
``BITS_OVER`` bits more. Where no phrases are shared, all words say much, and the errors alone decide.

Words are compared without case, accents, punctuation, spacing and markup. NULL, empty and blank texts give no
rows; a document that holds a passage twice gives one row for the item; an item given twice under one id counts
with its longest run. Items without id or text are left out.

The set of items may have any size: it is split by the hash of the id into parts of about ``PART_BYTES``, each part
is searched in its own pass over the texts, and the rows are united. A part travels as a broadcast variable of that
bounded size; a worker builds its search tables once. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = 5
MIN_WORDS = 15
ERROR_EVERY = 7
BLOCK = 6
#: What a run with errors must match: so many times the bits it misses, and so many bits more.
BITS_RATIO, BITS_OVER = 4.0, 40.0
#: Words of running text that stand behind the items' own when rates are estimated, and weight of a word's own rate.
BACKGROUND, OWN_RATE = 10_000, 2.0
#: Text of the items that one pass over the documents searches for.
PART_BYTES = 4_000_000

_TAG = re.compile(r"</?[a-z!][^<>]{0,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+|#x[0-9a-f]+);")
_GAP = re.compile(r"[\W_]+")


class _Fold(dict):
    """Lower-case letters without marks; each character is looked up once."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kept = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        self[code] = kept
        return kept


_FOLD = _Fold()


def normal(text: str) -> str:
    """Words in lower case without marks, each parted by one space, with a space at both ends."""
    text = text.lower()
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = text.translate(_FOLD)
    return f" {_GAP.sub(' ', text).strip()} "


class BlockSearch:
    """Many patterns at once: shifts by block, buckets by ending block, direct comparison."""

    def __init__(self, patterns: dict[str, list[tuple[str, int]]], block: int = BLOCK) -> None:
        self.patterns = patterns
        self.m = min(map(len, patterns), default=0)
        self.block = b = min(block, self.m) if self.m else 1
        self.far = self.m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[int, set[str]]] = {}
        for p in patterns:
            # The window is the last m characters of a pattern.
            tail = p[len(p) - self.m :]
            for q in range(b, self.m + 1):
                block_ = tail[q - b : q]
                if self.m - q < self.shift.get(block_, self.far):
                    self.shift[block_] = self.m - q
            self.bucket.setdefault(p[-b:], {}).setdefault(len(p), set()).add(p)

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(end, pattern) of each occurrence."""
        if not self.m:
            return
        n, b, far, get, i = len(text), self.block, self.far, self.shift.get, self.m
        while i <= n:
            s = get(text[i - b : i], far)
            if s:
                i += s
                continue
            for length, group in self.bucket.get(text[i - b : i], {}).items():
                if length <= i and text[i - length : i] in group:
                    yield i, text[i - length : i]
            i += 1


def word_bits(words: dict[str, list[str]]) -> dict[str, list[float]]:
    """Surprisal in bits of each word of each item after the word before it, from the other items' words."""
    own = {i: (Counter(zip(["", *w], w)), Counter(["", *w[:-1]]), Counter(w)) for i, w in words.items()}
    pairs, before, single = (Counter() for _ in range(3))
    for p, b, c in own.values():
        pairs.update(p), before.update(b), single.update(c)
    total = single.total()
    out = {}
    for i, w in words.items():
        p, b, c = own[i]
        n = total - len(w) + BACKGROUND
        out[i] = [-math.log2((pairs[x, y] - p[x, y] + OWN_RATE * (single[y] - c[y] + 0.5) / n) / (before[x] - b[x] + OWN_RATE)) for x, y in zip(["", *w], w)]
    return out


def _walk(a: list[str], i: int, b: list[str], j: int, step: int, bits: list[float]) -> list[tuple[int, int, float, float]]:
    """Extend a match from a[i], b[j] (already matched) in one direction.

    Gives (words of a, errors, bits matched, bits missed) after each matched word. A changed, added or missing
    word may be bridged where the words after it match again.
    """
    out = [(0, 0, 0.0, 0.0)]
    n = errors = 0
    good = bad = 0.0
    na, nb = len(a), len(b)

    def same(x: int, y: int) -> bool:
        return 0 <= x < na and 0 <= y < nb and a[x] == b[y]

    while True:
        x, y = i + step, j + step
        if not same(x, y):
            # (words of a, words of b) to leave out: a changed word, an added one, a missing one, two of them.
            for da, db in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1)):
                x, y = i + step * (da + 1), j + step * (db + 1)
                if same(x, y) and (same(x + step, y + step) or same(x + 2 * step, y + 2 * step) or not (0 <= x + step < na and 0 <= y + step < nb)):
                    break
            else:
                return out
            errors += max(da, db)
            n += da
            bad += sum(bits[i + step * k] for k in range(1, da + 1))
            if errors > 2 + n / ERROR_EVERY:
                return out
        i, j, n = x, y, n + 1
        good += bits[i]
        out.append((n, errors, good, bad))


def longest_run(a: list[str], i: int, b: list[str], j: int, length: int, bits: list[float]) -> tuple[int, int]:
    """Longest run (words, errors) around ``length`` equal words at a[i:], b[j:] that keeps the rate of errors and says enough."""
    right = _walk(a, i + length - 1, b, j + length - 1, 1, bits)
    left = _walk(a, i, b, j, -1, bits)
    core = sum(bits[i : i + length])
    best = (0, 0)
    for ln, le, lg, lb in left:
        for rn, re_, rg, rb in right:
            n, e = length + ln + rn, le + re_
            if n > best[0] and e * ERROR_EVERY <= n:
                good, bad = core + lg + rg, lb + rb
                if not e or good >= BITS_RATIO * bad and good >= bad + BITS_OVER:
                    best = (n, e)
    return best


class LeakFinder:
    def __init__(self, passages: list[tuple[str, str]]) -> None:
        # Items often share their passage, which must not make its words look common: each passage counts once.
        self.ids: dict[str, list[str]] = {}
        for item, p in passages:
            self.ids.setdefault(normal(p), []).append(item)
        self.words = {p: p.split() for p in self.ids}
        self.bits = word_bits(self.words)
        patterns: dict[str, list[tuple[str, int]]] = {}
        for item, words in self.words.items():
            for k in range(len(words) - ANCHOR + 1):
                patterns.setdefault(f" {' '.join(words[k : k + ANCHOR])} ", []).append((item, k))
        self.search = BlockSearch(patterns)

    def items(self, text: str | None) -> list[tuple[str, int, int]]:
        """(item, words, errors) of the longest run of each item that the text leaks."""
        if not text:
            return []
        flat = normal(text)
        words: list[str] = []
        best: dict[str, tuple[int, int]] = {}
        reached: dict[tuple[str, int], int] = {}
        gaps = at = 0
        for end, pattern in self.search.find(flat):
            if not words:
                words = flat.split()
            gaps, at = gaps + flat.count(" ", at, end), end
            j = gaps - 1 - ANCHOR
            for item, i in self.search.patterns[pattern]:
                d = (item, j - i)
                if reached.get(d, -1) >= i:
                    continue
                n, errors = longest_run(self.words[item], i, words, j, ANCHOR, self.bits[item])
                k = 0
                a = self.words[item]
                while i + k < len(a) and j + k < len(words) and a[i + k] == words[j + k]:
                    k += 1
                reached[d] = i + k - ANCHOR
                if n > best.get(item, (0, 0))[0]:
                    best[item] = (n, errors)
        found: dict[str, tuple[int, int]] = {}
        for p, (n, e) in best.items():
            for item in self.ids[p] if n >= MIN_WORDS else ():
                found[item] = max(found.get(item, (0, 0)), (n, e))
        return [(item, n, e) for item, (n, e) in found.items()]


def passage(text: str | None) -> str:
    """The passage of an item: what lies between its first and last blank line."""
    parts = [p for p in re.split(r"\n\s*\n", text or "") if p.strip()]
    return "\n".join(parts[1:-1]) if len(parts) > 2 else (parts[-1] if len(parts) == 1 else "\n".join(parts[1:]))


#: The finder of the part that this worker searches for at present.
_FINDER: list = [None, None]


def _finder(name: str, part) -> LeakFinder:
    """Built once a worker and part."""
    if _FINDER[0] != name:
        _FINDER[:] = name, LeakFinder(part.value)
    return _FINDER[1]


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, item_id, words, errors): one row for each item that a document leaks."""
    known = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    parts = max(1, -(-(known.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // part_bytes))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col))]
    # Keys pass through Python as text: a NULL among integers would turn the others into floats.
    texts = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t <> ''")

    def search(part: int) -> DataFrame:
        rows = known.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r["i"], passage(r["t"])) for r in rows])
        name = uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = _finder(name, sent)
            for pdf in batches:
                yield pd.DataFrame([(i, *hit) for i, t in zip(pdf["i"], pdf["t"]) for hit in finder.items(t)], columns=["i", "item", "words", "errors"])

        return texts.mapInPandas(run, "i string, item string, words int, errors int")

    out = reduce(DataFrame.union, [search(k) for k in range(parts)])
    return out.select(F.col("i").cast(kinds[0]).alias(id_col), F.col("item").cast(kinds[1]).alias(item_col), "words", "errors")
