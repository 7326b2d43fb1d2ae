"""Quality rules: gradient-boosted trees over document statistics.

Training is a histogram booster in numpy on a bounded sample of labelled rows;
chosen features have monotonic constraints. The forest is flattened into node
arrays that score all rows of a batch together.

Defined results: text that is null or holds no word scores 0 and is rejected;
without labelled rows of both classes every other document scores 1 and stays;
labels without a document, null labels and extra columns don't matter; equal
rows score alike; empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "punct", "space", "pipe", "line_words", "line_end",
    "unique", "top_word", "dup_lines", "dup_grams", "short_lines", "long_words", "repeat_char", "title_words",
)
#: -1: more of it never raises the score.
MONOTONE = {"symbol": -1, "upper": -1, "dup_lines": -1, "dup_grams": -1, "pipe": -1, "repeat_char": -1}
#: The bound on labelled rows that training gathers, and the score at which a document stays.
TRAIN_ROWS, KEEP_AT = 20_000, 0.5
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 48, 0.15, 2.0

_KIND = np.zeros((256, 7), np.float32)  # upper, letter, digit, symbol, punct, space, pipe
_KIND[65:91, 0] = 1
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)], 1] = 1
_KIND[48:58, 2] = 1
_KIND[[ord(c) for c in "#%&$*@^~<>{}[]\\=+_/!"], 3] = 1
_KIND[[ord(c) for c in ".,;:?'\"()-"], 4] = 1
_KIND[[9, 10, 11, 12, 13, 32], 5] = 1
_KIND[124, 6] = 1


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=pre[1:])
    return pre[first[1:]] - pre[first[:-1]]


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows: distinct hashes, and occurrences of the most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
    runs, owner = np.diff(np.r_[new, len(x)]), d[new]
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each row of a slice, and its number of words."""
    n, size = len(offs) - 1, np.maximum(np.diff(offs), 1)
    kinds = [_sums(_KIND[buf, j], offs) for j in range(7)]
    letters = np.maximum(kinds[1], 1)
    w = C.words(buf, offs)
    nw = np.diff(w.first).astype(float)
    some = np.maximum(nw, 1)
    length = w.end - w.start
    lower = buf | ((_KIND[buf, 0] > 0) * np.uint8(32))
    h = C.span_hashes(lower, w.start, w.end) if len(w.start) else np.zeros(0, np.uint64)
    distinct, top = _repeats(w.doc, h, n)
    g = C.gram_hashes(h, 3)
    inside = w.doc[: len(g)] == w.doc[2 : 2 + len(g)] if len(g) else np.zeros(0, bool)
    gd, _ = _repeats(w.doc[: len(g)][inside], g[inside], n)
    ng = np.maximum(nw - 2, 1)
    # lines: pieces between line feeds, blank ones left out
    stop = np.union1d(np.flatnonzero(buf == 10), offs[1:])
    begin = np.union1d(np.flatnonzero(buf == 10) + 1, offs[:-1])
    begin, stop = (np.unique(np.r_[begin, offs[:-1]]), np.unique(np.r_[stop, offs[1:]])) if len(buf) else (np.zeros(0, int),) * 2
    begin = begin[begin < len(buf)]
    end = stop[np.searchsorted(stop, begin)] if len(begin) else begin
    full = end > begin
    begin, end = begin[full], end[full]
    owner = np.searchsorted(offs, begin, "right") - 1
    lines = np.maximum(np.bincount(owner, minlength=n), 1) if len(begin) else np.ones(n)
    lh = C.span_hashes(buf, begin, end) if len(begin) else np.zeros(0, np.uint64)
    ld, _ = _repeats(owner, lh, n)
    closed = np.isin(buf[end - 1], [46, 33, 63, 34, 58]) if len(begin) else np.zeros(0)
    per_line = (np.searchsorted(w.start, end) - np.searchsorted(w.start, begin)) if len(begin) else np.zeros(0)
    same = np.r_[False, buf[1:] == buf[:-1]] & ~np.isin(buf, [32, 10]) if len(buf) else np.zeros(0, bool)
    x = np.stack([
        np.log1p(nw), _sums(length, w.first) / some, kinds[0] / letters, kinds[2] / size, kinds[3] / size, kinds[4] / size,
        kinds[5] / size, kinds[6] / size, nw / lines, np.bincount(owner, closed, n) / lines if len(begin) else np.zeros(n),
        distinct / some, top / some, np.where(nw > 0, 1 - ld / lines, 0), np.where(nw > 2, 1 - gd / ng, 0),
        np.bincount(owner, per_line < 4, n) / lines if len(begin) else np.zeros(n), _sums(length > 15, w.first) / some,
        _sums(same, offs) / size, _sums(_KIND[buf[w.start], 0], w.first) / some,
    ], 1)
    return x.astype(np.float32), nw


class Forest(NamedTuple):
    """Node arrays of all trees, of DEPTH levels each, laid end to end; base: the first log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float


def score(forest: Forest | None, x: np.ndarray) -> np.ndarray:
    if forest is None:
        return np.ones(len(x))
    width = (2 << DEPTH) - 1
    total, rows = np.full(len(x), forest.base), np.arange(len(x))
    for root in range(0, len(forest.feature), width):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = root + at
            at = 2 * at + 1 + (x[rows, forest.feature[node]] > forest.threshold[node])
        total += forest.value[root + at]
    return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest | None:
    """Boosts ``trees`` trees for the log loss; None where ``y`` has a single class."""
    if len(y) == 0 or y.min() == y.max():
        return None
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
    b = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)  # bin <= i exactly where x <= cuts[i]
    signs = [MONOTONE.get(f, 0) for f in FEATURES[:k]] + [0] * max(0, k - len(FEATURES))
    width = (2 << DEPTH) - 1
    feature, threshold, value = (np.zeros(trees * width, t) for t in (np.int32, np.float32, np.float64))
    threshold[:] = np.inf
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    f = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, hs = y - p, p * (1 - p)
        at, low, high = np.zeros(n, np.int64), np.full(width, -np.inf), np.full(width, np.inf)
        root = t * width
        for level in range(DEPTH):
            lo, nodes = (1 << level) - 1, 1 << level
            best, choice = np.zeros(nodes), [None] * nodes
            tot_g, tot_h = np.bincount(at - lo, g, nodes), np.bincount(at - lo, hs, nodes)
            for j in range(k):
                m = len(cuts[j])
                if not m:
                    continue
                key = (at - lo) * (m + 1) + b[:, j]
                hg = np.bincount(key, g, nodes * (m + 1)).reshape(nodes, m + 1).cumsum(1)[:, :m]
                hh = np.bincount(key, hs, nodes * (m + 1)).reshape(nodes, m + 1).cumsum(1)[:, :m]
                rg, rh = tot_g[:, None] - hg, tot_h[:, None] - hh
                bounds = low[lo : lo + nodes, None], high[lo : lo + nodes, None]
                lv, rv = np.clip(hg / (hh + L2), *bounds), np.clip(rg / (rh + L2), *bounds)
                gain = 2 * (lv * hg + rv * rg) - lv**2 * (hh + L2) - rv**2 * (rh + L2) - (tot_g**2 / (tot_h + L2))[:, None]
                ok = (hh > 1) & (rh > 1)
                if signs[j]:
                    ok &= signs[j] * (rv - lv) >= 0
                gain = np.where(ok, gain, -1)
                c = gain.argmax(1)
                for q in np.flatnonzero(gain[np.arange(nodes), c] > best + 1e-9):
                    best[q], choice[q] = gain[q, c[q]], (j, c[q], lv[q, c[q]], rv[q, c[q]])
            for q in range(nodes):
                node = lo + q
                for side in (1, 2):
                    low[2 * node + side], high[2 * node + side] = low[node], high[node]
                if choice[q]:
                    j, c, lv, rv = choice[q]
                    feature[root + node], threshold[root + node] = j, cuts[j][c]
                    if signs[j]:
                        mid = (lv + rv) / 2
                        (high if signs[j] > 0 else low)[2 * node + 1] = mid
                        (low if signs[j] > 0 else high)[2 * node + 2] = mid
            node = root + at
            at = 2 * at + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        lo = (1 << DEPTH) - 1
        lg, lh = np.bincount(at - lo, g, 1 << DEPTH), np.bincount(at - lo, hs, 1 << DEPTH)
        value[root + lo : root + width] = RATE * np.clip(lg / (lh + L2), low[lo:], high[lo:])
        f += value[root + at]
    return Forest(feature, threshold, value, base)


def _stats_batches(batches):
    for batch in batches:
        for s in C.slices(batch):
            x, nw = statistics(s.buf, s.offs)
            yield pa.record_batch([s.rows.column("_k"), s.rows.column("y"), C.list_column(x.ravel(), np.full(len(x), x.shape[1]), pa.float32())], ["_k", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest | None:
    """Trains on at most ``rows`` labelled documents, those with the least hash of doc_id."""
    C.prepare(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .dropna().groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    data = (
        C.keyed(docs).join(F.broadcast(chosen), "doc_id").select("_k", "y", "text")  # at most ``rows`` ids
        .mapInArrow(_stats_batches, "_k long, y double, x array<float>").toArrow()
    )
    if not data.num_rows:
        return None
    x = np.stack(data["x"].to_numpy()).astype(np.float32)
    y = (data["y"].to_numpy() >= 0.5).astype(float)
    order = np.lexsort((y, data["_k"].to_numpy()))
    return train(x[order], y[order])


def rate(docs: DataFrame, forest: Forest | None, keep_at: float = KEEP_AT) -> DataFrame:
    """``_k, doc_id, score, keep`` for every row."""
    C.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                x, nw = statistics(s.buf, s.offs)
                p = np.where(nw > 0, np.round(score(forest, x), 6), 0.0)
                yield pa.record_batch([s.rows.column("_k"), s.rows.column("doc_id"), C.column(p, pa.float64()), C.column((p >= keep_at) & (nw > 0), pa.bool_())], ["_k", "doc_id", "score", "keep"])

    return C.keyed(docs).mapInArrow(run, "_k long, doc_id long, score double, keep boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, keep`` for every document."""
    return rate(docs, fit(docs, labels)).select("doc_id", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep."""
    forest = fit(docs, labels)
    plain, restore = C.numbered(docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for s in C.slices(batch, f"c{at}"):
                x, nw = statistics(s.buf, s.offs)
                yield s.rows.filter(pa.array((np.round(score(forest, x), 6) >= keep_at) & (nw > 0)))

    return restore(plain.mapInArrow(run, plain.schema))
