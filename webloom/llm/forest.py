"""Bagged decision trees, trained on all rows of a table and applied in Arrow batches.

``train_table`` grows all trees at once, a level with each pass over the rows: every row is counted in one bin of each
feature that its node looks at, and only the counts of the bins come to the driver. ``train`` does it on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of like mass into which the values of a feature fall. A value that many rows share has its own bin; towards both ends
#: the bins get smaller by halves, down to single rows, and the widest gaps between values part bins, so that rare rows stand apart.
BINS, GAPS = 100, 30
#: Lowest bits of a float that don't tell its bucket; the others tell values apart that differ by a thousandth.
LOW_BITS = 13


class Forest:
    """Average of the leaf rates of several trees; each tree is a list of (feature, cut, left, right, rate).

    All trees lie in one table, in which a leaf leads back to itself; so all rows walk down all trees at once.
    """

    def __init__(self, trees: list[np.ndarray], default: float) -> None:
        self.trees, self.default = trees, default
        starts = np.cumsum([0, *map(len, trees)])
        self.roots = starts[:-1].astype("int32")
        table = np.concatenate(trees) if trees else np.zeros((0, 5))
        here, leaf = np.arange(len(table)), table[:, 0] < 0
        shift = np.repeat(self.roots, list(map(len, trees))) if trees else here
        self.feature = np.where(leaf, 0, table[:, 0]).astype("int32")
        self.cut = np.where(leaf, np.inf, table[:, 1])
        self.next = np.stack([np.where(leaf, here, table[:, 3] + shift), np.where(leaf, here, table[:, 2] + shift)], 1).astype("int32")
        self.rate = table[:, 4]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.default)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            down = self.next[at, (x[rows, self.feature[at]] <= self.cut[at]).astype("int8")]
            if np.array_equal(down, at):
                return self.rate[at].mean(1)
            at = down


def _best_cut(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    best, gain = None, 1e-9
    n, s = len(y), y.sum()
    whole = s * (n - s) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (n - k >= least)]
        if not len(k):
            continue
        left, right = c[k - 1], s - c[k - 1]
        impurity = left * (k - left) / k + right * (n - k - right) / (n - k)
        i = int(np.argmin(impurity))
        if whole - impurity[i] > gain:
            best, gain = (int(f), float((v[k[i] - 1] + v[k[i]]) / 2)), whole - impurity[i]
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> np.ndarray:
    nodes: list[list[float]] = []

    def build(idx: np.ndarray, d: int) -> int:
        me = len(nodes)
        rate = (y[idx].sum() + 0.5) / (len(idx) + 1)
        nodes.append([-1, 0, 0, 0, rate])
        if d < depth and 0 < y[idx].sum() < len(idx) and len(idx) >= 2 * least:
            # Every tree sees a random part of the features at each node, so that no single one decides all.
            features = rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
            cut = _best_cut(x[idx], y[idx], features, least)
            if cut:
                go = x[idx, cut[0]] <= cut[1]
                nodes[me][:2] = cut
                nodes[me][2] = build(idx[go], d + 1)
                nodes[me][3] = build(idx[~go], d + 1)
        return me

    build(np.arange(len(y)), 0)
    return np.array(nodes)


def train(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, least: int = 2, seed: int = 7) -> Forest:
    """Each tree is grown on a bootstrap sample. With one label only, every row gets that label's rate."""
    if not len(y) or y.min() == y.max():
        return Forest([], float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        if y[pick].min() != y[pick].max():
            grown.append(_grow(x[pick], y[pick].astype(float), rng, depth, least))
    return Forest(grown, float(y.mean()))


def _draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree: Poisson numbers by the hash of its key, alike wherever it lies."""
    with np.errstate(over="ignore"):
        z = keys.astype("uint64") + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right")


_POISSON = np.exp(-1) * np.cumsum(1 / np.cumprod([1.0, *range(1, 12)]))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Cuts between the bins of each feature, from all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, v in enumerate(_features(b).T if b.num_rows else ()):
                v = np.sort(v)
                bits = v.view("int32").astype("int64")
                bucket = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> LOW_BITS
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.concatenate((at[1:], [len(v)]))
                columns = [np.full(len(at), f, "int32"), bucket[at], ends - at, v[at], v[ends - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "b", "n", "lo", "hi"])

    counted = rows.select("x").mapInArrow(count, "f int, b bigint, n bigint, lo float, hi float")
    got = counted.groupBy("f", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().to_pandas().sort_values(["f", "b"])
    out = []
    for _, g in got.groupby("f"):
        n, lo, hi = (g[c].to_numpy() for c in ("n", "lo", "hi"))
        if len(n) <= BINS:
            on = np.arange(len(n) - 1)
        else:
            total, ends = n.sum(), 2 ** np.arange(int(n.sum()).bit_length())
            shares = np.searchsorted(np.cumsum(n), np.concatenate((np.arange(1, BINS) * total // BINS, ends, total - ends)))
            on = np.union1d(np.concatenate((shares, np.argsort(lo[1:] - hi[:-1], kind="stable")[-GAPS:])), np.flatnonzero(n[1:] * BINS >= total))
            on = on[on < len(n) - 1]
        out.append((hi[on].astype(float) + lo[on + 1]) / 2)
    return out


class _Growing:
    """Trees that grow: nodes as in ``Forest``, the bin of each cut, and the nodes yet to be cut with their features."""

    def __init__(self, trees: int) -> None:
        self.nodes: list[list[list[float]]] = [[] for _ in range(trees)]
        self.bins: list[list[int]] = [[] for _ in range(trees)]
        self.open: list[list[int]] = [[] for _ in range(trees)]
        self.looks: list[list[np.ndarray]] = [[] for _ in range(trees)]

    def add(self, t: int, n: float, s: float) -> int:
        self.nodes[t].append([-1, 0, 0, 0, (s + 0.5) / (n + 1)])
        self.bins[t].append(0)
        return len(self.nodes[t]) - 1

    def places(self, t: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row."""
        nodes, cut = np.array(self.nodes[t])[:, [0, 2, 3]].astype("int64"), np.array(self.bins[t])
        at, rows = np.zeros(len(bins), "int64"), np.arange(len(bins))
        for _ in range(levels):
            f = nodes[at, 0]
            at = np.where(f < 0, at, np.where(bins[rows, np.maximum(f, 0)] <= cut[at], nodes[at, 1], nodes[at, 2]))
        return at


def train_table(rows: DataFrame, trees: int = 25, depth: int = 7, least: int = 2, seed: int = 7) -> Forest:
    """As ``train``, on all ``rows`` (k bigint, x array<float>, y int), where k is a hash that deals the bootstrap samples."""
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    n, s = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if s in (0, n):
        return Forest([], s / n if n else 0.0)
    cuts = _cuts(rows)
    width, wide = max(map(len, cuts)) + 1, max(2, len(cuts) // 2)
    rng = np.random.default_rng(seed)
    growing = _Growing(trees)
    for t in range(trees):
        growing.nodes[t], growing.bins[t], growing.open[t] = [[-1, 0, 0, 0, 0.0]], [0], [0]
    for level in range(depth):
        # Every tree sees a random part of the features at each node, so that no single one decides all.
        growing.looks = [[rng.permutation(len(cuts))[:wide] for _ in o] for o in growing.open]
        slots = max(map(len, growing.open))
        if not slots:
            break

        def count(batches: Iterator[pa.RecordBatch], level: int = level, slots: int = slots) -> Iterator[pa.RecordBatch]:
            total: list = [0] * trees
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, keys = _features(b), b.column("y").to_numpy(), b.column("k").to_numpy()
                bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
                for t in range(trees):
                    if not growing.open[t]:
                        continue
                    slot = np.full(len(growing.nodes[t]), -1)
                    slot[growing.open[t]] = np.arange(len(growing.open[t]))
                    at, w = slot[growing.places(t, bins, level)], _draws(keys, t)
                    on = np.flatnonzero((at >= 0) & (w > 0))
                    cell = (at[on, None] * wide + np.arange(wide)) * width + bins[on[:, None], np.array(growing.looks[t])[at[on]]]
                    w = np.repeat(w[on], wide)
                    sums = [np.bincount(cell.ravel(), v, len(growing.open[t]) * wide * width) for v in (w, w * np.repeat(y[on], wide))]
                    total[t] = total[t] + np.stack(sums)
            for t, cells in enumerate(total):
                if not np.isscalar(cells):
                    on = np.flatnonzero(cells[0])
                    columns = [on + t * slots * wide * width, *cells[:, on].astype("int64")]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "n", "s"])

        got = rows.mapInArrow(count, "cell bigint, n bigint, s bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
        cells = np.zeros((2, trees * slots * wide * width))
        cells[:, got["cell"].to_numpy()] = got["n"].to_numpy(), got["s"].to_numpy()
        cells = cells.reshape(2, trees, slots, wide, width)
        for t in range(trees):
            opened, growing.open[t] = growing.open[t], []
            for i, me in enumerate(opened):
                _cut_node(growing, t, me, growing.looks[t][i], cells[:, t, i], cuts, least, level + 1 < depth)
    # As in train, a tree whose sample has one label only is left out.
    grown = [np.array(g) for g in growing.nodes if g[0][4] not in (0, 1)]
    return Forest(grown, s / n)


def _cut_node(growing: _Growing, t: int, me: int, features: np.ndarray, cells: np.ndarray, cuts: list[np.ndarray], least: int, more: bool) -> None:
    """Cut a node where the impurity of its halves, counted in ``cells`` (rows and cases, feature, bin), is least."""
    n, s = cells[:, 0].sum(1)
    if not me:
        growing.nodes[t][0][4] = (s + 0.5) / (n + 1) if 0 < s < n else float(s > 0)
    if not 0 < s < n or n < 2 * least:
        return
    whole = s * (n - s) / n
    k, c = cells.cumsum(2)
    rest, left = n - k, s - c
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = np.where((k >= least) & (rest >= least), c * (k - c) / k + left * (rest - left) / rest, np.inf)
    j, b = np.unravel_index(int(impurity.argmin()), impurity.shape)
    if not whole - impurity[j, b] > 1e-9:
        return
    f = int(features[j])
    growing.nodes[t][me][:2], growing.bins[t][me] = [f, float(cuts[f][b])], int(b)
    for side, (m, d) in ((2, (k[j, b], c[j, b])), (3, (rest[j, b], left[j, b]))):
        growing.nodes[t][me][side] = child = growing.add(t, m, d)
        if more and 0 < d < m and m >= 2 * least:
            growing.open[t].append(child)
