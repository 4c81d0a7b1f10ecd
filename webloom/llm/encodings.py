"""Text that was decoded with the wrong character encoding.

A *transformation* is a pair of encodings: the bytes were written in one and read in the other. UTF-8 read as a
single-byte encoding leaves sequences of two to four odd characters for each letter; one single-byte encoding
read as another leaves words of odd letters; bytes read as UTF-8 leave replacement characters.

What occurs in a corpus is learned from near-twins: records (titles and content lines) that are equal but for their
non-ASCII characters. ``align`` sets the runs of such characters of a garbled record against those of its clean twin,
character by character, and gives the pairs of garbled sequence and clean character. ``explain`` names the known
transformations that turn the clean runs into the garbled ones; for garblings that have no name, the pairs themselves
are the mapping. A ``Repairer`` applies named and learned mappings to all records, twin or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

# Encodings in which web pages are read by mistake, and those they are written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp437", "mac-roman", "cp1251", "koi8-r", "cp866")
SINGLE = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"))
#: All transformations: (written in, read as).
TRANSFORMS = tuple(("utf-8", r) for r in READ_AS) + SINGLE


def _table(enc: str) -> list[str]:
    """Character of each byte; undefined bytes keep their code, as browsers do."""
    return [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256)]


_TABLES = {e: _table(e) for e in {x for t in TRANSFORMS for x in t if x != "utf-8"}}
_BYTES = {e: {c: b for b, c in enumerate(t)} for e, t in _TABLES.items()}


def garble(text: str, transform: tuple[str, str]) -> str | None:
    """The text as it looks after being written in one encoding and read in the other; None if it can't be written."""
    written, read = transform
    if written == "utf-8":
        raw: Iterable[int] = text.encode("utf-8", "surrogatepass")
    else:
        back = _BYTES[written]
        raw = []
        for c in text:
            if c not in back:
                return None
            raw.append(back[c])
    t = _TABLES[read]
    return "".join(t[b] for b in raw)


def ungarble(text: str, transform: tuple[str, str]) -> str | None:
    """The inverse of ``garble``; None if the text can't have come from it."""
    written, read = transform
    back = _BYTES[read]
    try:
        raw = bytes([back[c] for c in text])
        return raw.decode("utf-8") if written == "utf-8" else "".join(_TABLES[written][b] for b in raw)
    except (KeyError, UnicodeDecodeError):
        return None


def _cls(chars: Iterable[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


def _sequences(read: str) -> str:
    """Pattern of one UTF-8 sequence read in a single-byte encoding."""
    t = _TABLES[read]
    cont = _cls(t[b] for b in range(0x80, 0xC0))
    two, three, four = (_cls(t[b] for b in r) for r in (range(0xC2, 0xE0), range(0xE0, 0xF0), range(0xF0, 0xF5)))
    return f"(?:{two}{cont}|{three}{cont}{{2}}|{four}{cont}{{3}})"


_UTF8_RUN = {("utf-8", r): re.compile(f"{_sequences(r)}+") for r in READ_AS}
#: Characters of which a garbled UTF-8 sequence begins with one.
_UTF8_LEADS = {("utf-8", r): frozenset(_TABLES[r][b] for b in range(0xC2, 0xF5)) for r in READ_AS}
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Letters and signs that the seven languages use, and what a second garbling leaves; a repair must not lead outside.
_SOUND = re.compile(r"[\u0080-\u00ffŒœŠšŽžŸА-Яа-яЁё‐-‧‹›€ƒ™ˆ˜…]+")
_LETTERS = re.compile(r"[^\W\d_]")
_VOWEL_RU = set("аеёиоуыэюяАЕЁИОУЫЭЮЯ")


def _cyrillic_word(s: str) -> bool:
    """Lower case apart from the first letter, or all upper case, with a vowel."""
    letters = "".join(c for c in s if c.isalpha())
    return len(letters) >= 3 and all("А" <= c <= "я" or c in "Ёё" for c in letters) and (letters[1:].islower() or letters.isupper()) and bool(set(letters) & _VOWEL_RU)


def _odd_case(s: str) -> bool:
    """Cyrillic read in another Cyrillic encoding has its case turned round: 'пЕЖЕОР'."""
    return len(s) >= 3 and s[0].islower() and s[1:].isupper()


_COMMON_RU = set("оеаинтсрвл")


def _common(s: str) -> float:
    """Share of the ten most frequent Russian letters among the letters of s."""
    letters = [c for c in s.lower() if c.isalpha()]
    return sum(c in _COMMON_RU for c in letters) / len(letters) if letters else 0.0


_TURNED = re.compile("[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4}")
_HIGH = re.compile("[À-ÿ]{3}")


class Repairer:
    """Applies transformations; of several that fit, the one that explains most characters."""

    def __init__(self, transforms: Iterable[tuple[str, str]] = TRANSFORMS, learned: dict[str, str] | None = None) -> None:
        """``learned`` maps garbled sequences to characters; it goes before the transformations."""
        self.transforms = list(transforms)
        self.learned = learned or {}
        self.sequences = re.compile("|".join(map(re.escape, sorted(self.learned, key=len, reverse=True)))) if self.learned else None
        self.utf8 = [(t, _UTF8_RUN[t]) for t in self.transforms if t[0] == "utf-8"]
        self.single = [t for t in self.transforms if t[0] != "utf-8"]

    @staticmethod
    def _multi(text: str, transform: tuple[str, str], pattern: re.Pattern[str]) -> list[tuple[int, int, str]]:
        found = []
        known: dict[str, str | None] = {}
        for m in pattern.finditer(text):
            run = m.group()
            if run not in known:
                fixed = ungarble(run, transform)
                known[run] = fixed if fixed is not None and _SOUND.fullmatch(fixed) else None
            if known[run] is not None:
                found.append((m.start(), m.end(), known[run]))
        # Two Cyrillic letters can be a sequence by chance; one longer run settles it for the text.
        return found if transform[1] not in ("cp1251", "koi8-r", "cp866") or any(b - a >= 4 for a, b, _ in found) else []

    @staticmethod
    def _one_to_one(text: str, transform: tuple[str, str]) -> list[tuple[int, int, str]]:
        out, start = [], 0
        cyrillic = transform[1] in ("cp1251", "koi8-r", "cp866")
        for line in text.split("\n"):
            at, start = start, start + len(line) + 1
            if line.isascii():
                continue
            words = []
            for m in _RUN.finditer(line):
                letters = "".join(c for c in m.group() if c.isalpha())
                if letters and ("А" <= letters[0] <= "я" or letters[0] in "Ёё" if cyrillic else "À" <= letters[0] <= "ÿ"):
                    words.append((m.start() + at, m.end() + at, letters, ungarble(m.group(), transform)))
            long = [w for w in words if len(w[2]) >= 3]
            if not long:
                continue
            if cyrillic:
                odd = sum(_odd_case(w[2]) for w in long)
                raw, fixed = "".join(w[2] for w in words), "".join(w[3] or "" for w in words)
                if not odd and not raw.isupper() and sum(w[2].isupper() for w in long) * 2 < len(long) or _common(fixed) < _common(raw) + 0.12:
                    continue
            good = [w for w in long if w[3] is not None and _cyrillic_word(w[3])]
            if len(good) * 10 < len(long) * 6 or sum(w[1] - w[0] for w in good) < 4:
                continue
            out += [(a, b, f) for a, b, _, f in words if f is not None and _SOUND.fullmatch(f)]
        return out

    def fix(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """(restored text, spans of the garbled runs in the given text)."""
        first: list[tuple[int, int]] | None = None
        if self.sequences and (found := [m.span() for m in self.sequences.finditer(text)]):
            first = found
            text = self.sequences.sub(lambda m: self.learned[m.group()], text)
        for _ in range(4):
            best: list[tuple[int, int, str]] = []
            weight = 0
            chars = set(text)
            for transform, pattern in self.utf8:
                if not chars.isdisjoint(_UTF8_LEADS[transform]) and pattern.search(text):
                    found = self._multi(text, transform, pattern)
                    if (w := sum(b - a for a, b, _ in found)) > weight:
                        best, weight = found, w
            turned, high = _TURNED.search(text) is not None, _HIGH.search(text) is not None
            for transform in self.single:
                if not (turned if transform[1] in ("cp1251", "koi8-r", "cp866") else high):
                    continue
                found = self._one_to_one(text, transform)
                if (w := sum(b - a for a, b, _ in found)) > weight:
                    best, weight = found, w
            if not best:
                break
            if first is None:
                first = [(a, b) for a, b, _ in best]
            out, at = [], 0
            for a, b, f in best:
                out += [text[at:a], f]
                at = b
            text = "".join(out) + text[at:]
            if not suspicious(text):
                break
        return text, first or []


_ALL = Repairer()
# Sequences that no sound text of the seven languages holds, by the characters that they need.
_ALWAYS = frozenset(map(chr, [*range(0x80, 0xA0), 0xFFFD, *range(0x2500, 0x2580), *range(0x402, 0x410), *range(0x452, 0x460)])) | frozenset("Γ√∩≈ĂăĹĺҐґ")
_LEADS = frozenset("ÃÂÐÑÅÄÎÏ‚â")
_AFTER_LEAD = re.compile("[ÃÂÐÑÅÄÎÏ][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|‚[Ä-ÿ]|â[\u0080-¿€‚]")
#: Characters next to which nothing is odd: all but those of scripts that aren't mixed with Latin.
_USUAL = frozenset(map(chr, [*range(0x370), *range(0x400, 0x530), *range(0x1E00, 0x2E80)]))


def _high_run(text: str) -> bool:
    """Four letters of the upper half of Latin-1 in a row."""
    high = np.frombuffer(text.encode("latin-1", "replace"), "uint8") >= 0xC0
    return len(high) > 3 and bool((high[:-3] & high[1:-2] & high[2:-1] & high[3:]).any())


_HIGH_LETTERS = frozenset(map(chr, range(0xC0, 0x100)))
_CAPITALS = frozenset("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_TURNED_RU = re.compile("[РС][^\\sа-яёА-ЯЁ\\x00-\\x7f]|[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4}")
#: Letters of the seven languages and common signs. Others are looked at more closely, in case they stand for some of these.
_FAMILIAR = frozenset(map(chr, [*range(0x100), *range(0x400, 0x460), *range(0x2000, 0x2070), *range(0x20A0, 0x20D0), *range(0x2100, 0x2150), *range(0x2190, 0x2200), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC, 0xFEFF]))


def _high_run(text: str) -> bool:
    """Four letters of the upper half of Latin-1 in a row."""
    high = np.frombuffer(text.encode("latin-1", "replace"), "uint8") >= 0xC0
    return len(high) > 3 and bool((high[:-3] & high[1:-2] & high[2:-1] & high[3:]).any())


def suspicious(text: str) -> bool:
    """A quick test before any repair; it looks for a sequence only where the text has the characters for it."""
    if text.isascii():
        return False
    chars = set(text)
    if not chars <= _FAMILIAR or not chars.isdisjoint(_ALWAYS):
        return True
    if not chars.isdisjoint(_LEADS) and _AFTER_LEAD.search(text):
        return True
    if not chars.isdisjoint(_CAPITALS) and _TURNED_RU.search(text):
        return True
    return not chars.isdisjoint(_HIGH_LETTERS) and _high_run(text)


REPLACED = "\ufffd"
_OPEN, _CLOSE = set("“«„\"'‘(‹`["), set("”»“\"'’)›`]")


def untangle(text: str) -> str:
    """Text with every recognised garbled run restored; sound text comes back as it is."""
    return _ALL.fix(text)[0] if suspicious(text) else text


def garbled_spans(text: str, repairer: Repairer) -> list[tuple[int, int]]:
    """Spans of garbled runs, those that a sound text quotes as an example left out."""
    if not suspicious(text):
        return []
    spans = repairer.fix(text)[1]
    spans += [m.span() for m in re.finditer(REPLACED + "+", text)]
    return [(a, b) for a, b in spans if not (a and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE)]


# --- learning from near-twins -------------------------------------------------------------------------------


def _chunks(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The garbled sequence of each character of a clean run; none where the lengths tell nothing.

    A wrong decoding turns each character into as many others as it had bytes: one each, as many as UTF-8 has, or an
    equal number.
    """
    sizes = [len(c.encode("utf-8", "surrogatepass")) for c in clean]
    if len(garbled) == len(clean):
        sizes = [1] * len(clean)
    elif sum(sizes) != len(garbled):
        if len(garbled) % len(clean):
            return []
        sizes = [len(garbled) // len(clean)] * len(clean)
    out, at = [], 0
    for c, n in zip(clean, sizes):
        out.append((garbled[at : at + n], c))
        at += n
    return out


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """(garbled sequence, clean character) of two near-twins; unchanged characters and lost ones are left out."""
    g, c = _RUN.findall(garbled), _RUN.findall(clean)
    if len(g) != len(c):
        return []
    return [(x, y) for a, b in zip(g, c) if a != b for x, y in _chunks(a, b) if x != y and REPLACED not in x]


def explain(garbled: str, clean: str) -> list[int]:
    """Transformations (indexes) that turn the runs of the clean record into those of the garbled one."""
    g, c = _RUN.findall(garbled), _RUN.findall(clean)
    pairs = [(x, y) for x, y in zip(g, c) if x != y] if len(g) == len(c) else []
    if not pairs:
        return []
    out = []
    for k, t in enumerate(TRANSFORMS):
        hits = sum(garble(y, t) == x or garble(garble(y, t) or "", t) == x for x, y in pairs)
        if hits * 2 > len(pairs):
            out.append(k)
    return out
