"""Text functions: normalisation, tokens, stop words, similarity. Columns stay native unless noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKED = "áàâäãåāăąçćčďéèêëēęěíìîïīñńňóòôöõōőřśšşťúùûüūůűýÿžźżйё"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiinnnooooooorssstuuuuuuuyyzzzие"

# Function words that say nothing in a query (Spanish, English).
STOPWORDS = frozenset(
    """a al con de del el en es la las lo los le les me mi no nos o por que se si sin su sus te tu tus un una y ya como cual donde este esta esto ese esa eso para pero mas muy fue hay ser cuando cuanto quien
    quienes cuyo sobre entre hasta desde tras an and are as at be but by do for from had has have he her him his how if in is it its my not of on or our she so the to up us was we who you when what where which
    why with about into through during before after above below than""".split()
)
# Stop words that are also titles of films and series, and the words that announce such a query.
TITLE_WORDS = frozenset("from the it you we her him us me my up in on el la lo los las un una su si no ya".split())
MEDIA_WORDS = frozenset("serie series tv pelicula peliculas film films movie movies show shows anime manga dorama novela novelas documental documentales documentary".split())


def plain(c: Column) -> Column:
    """Lower case without accents; everything but letters and digits becomes one space."""
    flat = F.translate(F.lower(F.trim(c)), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"\p{M}+", ""), r"[^\p{L}\p{Nd}]+", " "))


def tokens(c: Column) -> Column:
    """Words of the plain text; an empty array for NULL and for text without words."""
    p = F.coalesce(plain(c), F.lit(""))
    return F.filter(F.split(p, " "), lambda x: x != "")


def first_occurrences(words: Column) -> Column:
    """Words without their repetitions, in order."""
    return F.array_distinct(words)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_stopwords(words: Column) -> Column:
    """Stop words removed, unless nothing would be left; titles stay where a media word announces them."""
    stop = F.array(*[F.lit(w) for w in sorted(STOPWORDS)])
    hard = F.array(*[F.lit(w) for w in sorted(STOPWORDS - TITLE_WORDS)])
    media = F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(MEDIA_WORDS)]))
    left = F.filter(words, lambda w: F.when(media, ~F.array_contains(hard, w)).otherwise(~F.array_contains(stop, w)))
    return F.when((F.size(words) <= 1) | (F.size(left) == 0), words).otherwise(left)


def interest_tokens(c: Column) -> Column:
    """Words of more than two bytes, in lower case with their accents."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda t: F.octet_length(t) > 2)


def truncated(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes, never cutting a character."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, limit).cast("string")), "\ufffd+$", ""))


def parse_time(c: Column) -> Column:
    """First of the usual layouts that fits, from 1990 to 2100; NULL otherwise."""
    s = F.trim(c)
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    got = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])
    return F.when(F.year(got).between(1990, 2100), got)


# Spanish month names.
MONTHS = dict(zip("enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre".split(), "January February March April May June July August September September October November December".split()))


def parse_date(c: Column) -> Column:
    """Dates as pages write them: ISO, numeric with the day first, English or Spanish month names."""
    s = F.trim(c)
    for es, en in MONTHS.items():
        s = F.regexp_replace(s, f"(?i){es}", en)
    s = F.regexp_replace(s, r"\s+de\s+", " ")
    forms = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d"]
    got = F.coalesce(parse_time(s), *[F.try_to_timestamp(s, F.lit(f)) for f in forms])
    return F.when(F.year(got).between(1990, 2100), got)


# --- similarity ---------------------------------------------------------------------------------------------


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (each character used once)."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def edit_similarity(a: str, b: str) -> float:
    """1 - distance / length; 0 where the lengths differ by more than three in ten."""
    if not a or not b:
        return 0.0
    longest = max(len(a), len(b))
    if a == b:
        return 1.0
    return 0.0 if abs(len(a) - len(b)) > 0.3 * longest else max(0.0, 1 - osa(a, b) / longest)


def token_similarity(q: str, t: str) -> float:
    """1 equal, 0.94 one begins the other, 0.88 one holds the other, else the edit similarity from 0.72 on."""
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    short, long = sorted((q, t), key=len)
    if long.startswith(short):
        return 0.94
    if short in long:
        return 0.88
    s = edit_similarity(q, t) if len(short) >= 4 else 0.0
    return s if s >= 0.72 else 0.0


def phrase_score(query: str, words: list[str], field: str, field_words: list[str]) -> float:
    """How well a field holds the query as a phrase; windows of about its length are compared by edits."""
    if not query or not field:
        return 0.0
    if field == query:
        return 1.0
    if field.startswith(query):
        return 0.97
    if query in field:
        return 0.92
    n = len(words)
    windows = (" ".join(field_words[i : i + k]) for k in range(max(1, n - 1), min(len(field_words), n + 1) + 1) for i in range(len(field_words) - k + 1))
    return max((edit_similarity(query, w) for w in windows), default=0.0) if n else 0.0


@F.pandas_udf(T.DoubleType())
def edit_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_similarity(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def token_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_similarity(x or "", y or "") for x, y in zip(a, b)])


def strip_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def plain_str(s: str) -> str:
    """``plain`` for a string on the driver."""
    return " ".join("".join(c if c.isalpha() or c.isdigit() else " " for c in strip_marks(s.lower())).split())


# --- stemming -----------------------------------------------------------------------------------------------


class Porter:
    """The stemmer of M. F. Porter (1980), written from the published rules."""

    VOWELS = "aeiou"
    # Suffix tables of the published algorithm.
    STEP2 = [x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()]
    STEP3 = [x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

    def _vowel(self, w: str, i: int) -> bool:
        return w[i] in self.VOWELS or (w[i] == "y" and i > 0 and not self._vowel(w, i - 1))

    def _measure(self, w: str) -> int:
        shape = "".join("v" if self._vowel(w, i) else "c" for i in range(len(w)))
        return sum(1 for i in range(1, len(shape)) if shape[i] == "c" and shape[i - 1] == "v")

    def _has_vowel(self, w: str) -> bool:
        return any(self._vowel(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and not self._vowel(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        n = len(w)
        return n > 2 and not self._vowel(w, n - 1) and self._vowel(w, n - 2) and not self._vowel(w, n - 3) and w[-1] not in "wxy"

    def _swap(self, w: str, table: list, least: int) -> str:
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                return stem + new if self._measure(stem) > least else w
        return w

    def __call__(self, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and self._has_vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self._measure(w) == 1 and self._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self._has_vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(self._swap(w, self.STEP2, 0), self.STEP3, 0)
        for suffix in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if self._measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if self._double(w) and w[-1] == "l" and self._measure(w[:-1]) > 1:
            w = w[:-1]
        return w


class StemMemo(dict):
    """Stem of each word; found once a worker."""

    porter = Porter()

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = got = self.porter(word)
        return got


STEM = StemMemo()


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stem of each word of an array."""
    return words.map(lambda ws: [STEM[w] for w in ws])
