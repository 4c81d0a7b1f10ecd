"""Repeated content inside one document.

The share of a document's words that lie in a sentence, a line or a run of ``RUN`` words that stood earlier in
it, without regard to case, punctuation and numbers. ``repeated_share`` measures it exactly.

``repetitive`` decides by a logistic regression over hashed word and character n-grams. The value of an n-gram is
how often it stands again in the document, as a share of all n-grams of its length; n-grams are hashed to
``BUCKETS`` features for each length. The model is trained on a bounded sample of texts (``TRAIN_ROWS``) and on
texts made from them by saying parts again, in shares from none to nearly all, so that both labels and the ground
between them are always there; labels are whether the exact share reaches ``SHARE``, as the data has no other. It is
calibrated by Platt scaling on texts held out from the fit, and run in Arrow batches against two fixed thresholds:
documents above ``SURE`` are cases and those below ``1 - SURE`` are none. For the doubtful ones between them the
exact check follows.

NULL, empty and blank texts have share 0 and are no cases. Every text is read as a whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample

RUN = 10
SHARE = 0.4
TRAIN_ROWS = 2000
#: Calibrated probability from which, and below whose complement, the model decides alone.
SURE = 0.98

WORD_ORDERS = (1, 2, 3, 5, 10)
CHAR_ORDERS = (16,)
#: Ridge penalty, so large that a length of n-gram weighs about the same in all its buckets.
RIDGE = 1e-2
#: Features for each length of n-gram.
BUCKETS = 32
N_FEATURES = BUCKETS * (len(WORD_ORDERS) + len(CHAR_ORDERS))

_WORD = re.compile(r"[\d_]*[^\W\d_]\w*")
_LINE = re.compile(r"[\r\n  \u0085]+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\s\"'”’»“)\]]*\s+|(?<=[。！？])")


def repeated_share(text: str | None) -> float:
    """Exact share of repeated words."""
    if not text:
        return 0.0
    words: list[str] = []
    marks: list[tuple[int, int]] = []
    lines: set[tuple[str, ...]] = set()
    sentences: set[tuple[str, ...]] = set()
    find = _WORD.findall
    for line in _LINE.split(text.lower()):
        start = len(words)
        for sentence in _SENTENCE.split(line):
            w = find(sentence)
            if not w:
                continue
            key = tuple(w)
            if key in sentences:
                marks.append((len(words), len(words) + len(w)))
            else:
                sentences.add(key)
            words += w
        if len(words) > start:
            key = tuple(words[start:])
            if key in lines:
                marks.append((start, len(words)))
            else:
                lines.add(key)
    n = len(words)
    if not n:
        return 0.0
    repeated = np.zeros(n + 1, "int32")
    for a, b in marks:
        repeated[a] += 1
        repeated[b] -= 1
    if n > RUN:
        ids: dict[str, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "int64", n)
        h = _runs(codes)
        order = np.argsort(h, kind="stable")
        again = order[1:][h[order][1:] == h[order][:-1]]
        np.add.at(repeated, again, 1)
        np.subtract.at(repeated, again + RUN, 1)
    return float((np.cumsum(repeated[:-1]) > 0).sum()) / n


def _runs(codes: np.ndarray) -> np.ndarray:
    """A number for each run of RUN codes, equal for equal runs only, by doubling; memory is a few numbers a code."""
    rank, length = codes, 1
    while length < RUN:
        step = min(length, RUN - length)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, length = np.unique(pairs, return_inverse=True)[1].reshape(-1).astype("int64"), length + step
    return rank


_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _repeated_ngrams(codes: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """For each order: how often n-grams of each bucket stand again, as a share of all."""
    out = []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 1:
            out.append(np.zeros(BUCKETS))
            continue
        h = np.zeros(m, "uint64")
        for k in range(n):
            h = h * _MULT + codes[k : k + m]
            h ^= h >> _SHIFT
        h.sort()
        again = h[1:][h[1:] == h[:-1]]
        # Scaled so that the mean over the buckets is the share of all repeated n-grams.
        out.append(np.bincount((again % np.uint64(BUCKETS)).astype("int64"), minlength=BUCKETS) * (BUCKETS / m))
    return out


def features(text: str | None) -> np.ndarray:
    """Hashed n-gram features of one document. Words count by their own hash, so a bucket means the same everywhere."""
    words = _WORD.findall((text or "").lower())
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "int64", len(words))
    codes = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in ids), "uint64", len(ids))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "uint32")
    return np.concatenate(_repeated_ngrams(codes[at] if len(at) else codes, WORD_ORDERS) + _repeated_ngrams(flat.astype("uint64"), CHAR_ORDERS))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights with the bias last, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], l2 * len(a))
    reg[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + reg * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-9)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, weights: np.ndarray, slope: float, offset: float) -> None:
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def said_again(text: str, rng: np.random.Generator) -> str:
    """The text with some of its sentences, lines or words said again, in a share from none to nearly all."""
    kind, wanted = int(rng.integers(4)), float(rng.uniform(0, 0.9))
    parts = [x for x in (_SENTENCE.split(text.replace("\n", " ")), text.split("\n"), text.split(), text.split())[kind] if x and x.strip()]
    glue = ("  ", "\n", " ", " ")[kind]
    if not parts:
        return text
    size = int(rng.integers(RUN, 3 * RUN)) if kind == 2 else int(rng.integers(1, 4))
    out, again = list(parts), 0
    if kind == 3:
        # One word over and over.
        again = int(wanted * len(parts) / (1 - wanted))
        return glue.join([*out, *[out[int(rng.integers(len(out)))]] * again])
    while again < wanted * (len(parts) + again) and again < 20 * len(parts):
        a = int(rng.integers(len(parts)))
        piece = parts[a : a + size]
        if kind == 1 or rng.random() < 0.5:
            out += piece
        else:
            cut = int(rng.integers(len(out) + 1))
            out[cut:cut] = piece
        again += len(piece)
    return glue.join(out)


def train(texts: list[str], seed: int = 5) -> Model:
    """Model from texts and as many made from them. Where only one label can be had, every document is doubtful."""
    rng = np.random.default_rng(seed)
    texts = texts + [said_again(t, rng) for t in texts]
    x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
    y = np.array([repeated_share(t) >= SHARE for t in texts], float)
    fit = rng.random(len(y)) < 0.67
    if not 0 < y[fit].sum() < fit.sum() or not 0 < y[~fit].sum() < (~fit).sum():
        return Model(np.zeros(N_FEATURES + 1), 1.0, 0.0)
    w = fit_logistic(x[fit], y[fit], l2=RIDGE)
    z = x[~fit] @ w[:-1] + w[-1]
    # Platt's targets keep the probabilities inside (0, 1).
    pos, neg = y[~fit].sum(), (1 - y[~fit]).sum()
    target = np.where(y[~fit] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, offset = fit_logistic(z[:, None], target, l2=1e-6)
    return Model(w, max(float(slope), 1e-3), float(offset))


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, share double) of every document, exact."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "share": [repeated_share(t) for t in pdf["t"]]})

    return _keyed(docs, id_col, text_col).mapInPandas(run, "i string, share double").select(F.col("i").cast(kind).alias(id_col), "share")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys pass through Python as text: a NULL among integers would turn the others into floats."""
    return docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))


def repetitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, probability, share) of the repetitive documents; share, the exact measure, is given for the doubtful ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = model or train([r[0] for r in sample(docs, id_col, TRAIN_ROWS, text_col)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = model.probability(np.array([features(t) for t in pdf["t"]]).reshape(-1, N_FEATURES))
            share = [repeated_share(t) if 1 - SURE <= q <= SURE else None for t, q in zip(pdf["t"], p)]
            keep = [q > SURE if s is None else s >= SHARE for s, q in zip(share, p)]
            yield pd.DataFrame({"i": pdf["i"], "probability": p, "share": pd.array(share, "Float64")})[keep]

    out = _keyed(docs, id_col, text_col).where("t <> ''").mapInPandas(run, "i string, probability double, share double")
    return out.select(F.col("i").cast(kind).alias(id_col), "probability", "share")
