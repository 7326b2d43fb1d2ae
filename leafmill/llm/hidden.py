"""LM scoring: a hidden Markov language model.

A text is its lines, and a line is a sequence of lower-case words, each observed
as its 64-bit hash. The model has ``STATES`` latent states and an emission count
for every word of the corpus and state, in a table that grows with the vocabulary
and stays distributed. Texts are written once in shares of about ``SHARE`` words
that hold their own list of distinct words. The words of the corpus are cut by hash
into parts, as many as there are ``PART`` words in the lists of all shares. In each
pass of Baum-Welch a share adds up the expected counts of starts, moves and
emissions and sends each part one packed block of the counts of its words; the part
sums them, as fixed-point integers, so that the result doesn't depend on their order
or on tasks that ran twice, and answers each share with one block of the sums of the
same words, for the next pass. So Spark moves blocks, never a row a word. The passes
go over all texts. Only starts, moves and totals by state come to the driver. Before
the first pass a word's emissions are drawn by its hash.

A word that the model hasn't met counts as ``SMOOTH`` in each state; the totals
have room for one such word beside the known ones, which have ``SMOOTH`` added.
With ``symbols`` given, words are folded into so many buckets first.

A line's likelihood is exact, by the scaled forward recursion; a text's is the
product over its lines. Lines run side by side, the longest first.

Defined results, one row for each input row: null and empty texts, and those
without words, have 0 words, log-likelihood 0 and null perplexity; lines of any
length are read whole; equal rows score alike; an empty table gives none; extra
columns don't matter.
"""

from __future__ import annotations

import ctypes
import gc
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STATES, PASSES, SMOOTH, SEED = 8, 4, 0.1, 20240607
#: Words whose lines run side by side; words of a share; words that shares send to a part; fixed-point units of a count.
BLOCK, SHARE, PART, UNIT = 1 << 17, 1 << 22, 1 << 19, 1 << 16
#: What spreads hashes over the parts, also those folded into a few buckets, and its inverse.
SPREAD = 0x9E3779B97F4A7C15
GATHER = pow(SPREAD, -1, 1 << 64)
#: What shares send to parts, and parts to shares; a row without a share is the part's own.
SENT = "part int, share long, keys binary, units binary"
SUMMED = f"{SENT}, n long, total array<long>"


class Model(NamedTuple):
    start: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states), rows sum to 1
    emit: np.ndarray  # (symbols, states), columns sum to 1 over all symbols


class Trained(NamedTuple):
    start: np.ndarray
    moves: np.ndarray
    total: np.ndarray  # (states,), the sums of all emissions with smoothing
    parts: int
    summed: DataFrame  # as SUMMED

    @property
    def counts(self) -> DataFrame:
        """``h, s0, s1, ...``: each word's expected emissions in fixed-point units."""
        names = [f"s{s}" for s in range(len(self.start))]

        def run(batches):
            for batch in batches:
                for keys, units in zip(batch.column("keys"), batch.column("units")):
                    h = _keys(keys.as_py()) * np.uint64(GATHER)
                    yield pa.record_batch([h.view(np.int64), *_ints(units.as_py()).view(np.int64).reshape(len(names), -1)], ["h", *names])

        return _table(self).mapInArrow(run, "h long, " + ", ".join(f"{s} long" for s in names))


def initial(states: int = STATES, symbols: int = 1, seed: int = SEED) -> Model:
    r = np.random.default_rng(seed)
    a, e = 0.5 + r.random((states, states)), 0.5 + r.random((symbols, states))
    return Model(np.full(states, 1 / states), a / a.sum(1, keepdims=True), e / e.sum(0))


def drawn(vocab: np.ndarray, states: int = STATES, seed: int = SEED, kind=np.float64) -> np.ndarray:
    """The weights from which the emissions of words start, between 0.5 and 1.5, by their hashes."""
    salt = C.mix(np.arange(1, states + 1, dtype=np.uint64) + np.uint64(seed))
    out = np.empty((len(vocab), states), kind)
    for s in range(states):
        out[:, s] = 0.5 + (C.mix(vocab ^ salt[s]) >> np.uint64(11)) / float(1 << 53)
    return out


def observe(buf: np.ndarray, offs: np.ndarray, symbols: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lower-case texts laid end to end: hashes of the words, words of each line, lines of each text."""
    w = C.words(buf, offs)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
    x = C.span_hashes(buf, w.start, w.end)
    if symbols:
        x %= np.uint64(symbols)
    feeds = np.cumsum(buf == 10)
    line = feeds[w.start]
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])])
    return x, np.diff(np.r_[first, len(x)]).astype(np.int32), np.bincount(w.doc[first], minlength=len(offs) - 1)


class _Layout(NamedTuple):
    """Words in the order of their place in the line; of one place, the longest lines first."""

    order: np.ndarray  # index of each word in the lines laid end to end
    live: np.ndarray  # lines that reach each place
    at: np.ndarray  # where each place begins
    rank: np.ndarray  # the line of each rank


def _layout(size: np.ndarray) -> _Layout:
    rank = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[rank]
    desc = size[rank]
    live = np.searchsorted(-desc, -np.arange(1, desc[0] + 1), "right")
    at = np.r_[0, np.cumsum(live)]
    order = np.repeat(np.arange(len(live)), live) + first[np.arange(at[-1]) - np.repeat(at[:-1], live)]
    return _Layout(order, live, at, rank)


def _forward(m: Model, e: np.ndarray, y: _Layout) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities, in place of ``e``'s order, and the scales."""
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    moves, start = m.moves.astype(e.dtype), m.start.astype(e.dtype)
    v = start * e[: y.live[0]]
    ones = np.ones(e.shape[1], e.dtype)
    a = 0
    for i, n in enumerate(y.live.tolist()):
        if i:
            v = v[:n] @ moves
            v *= e[a : a + n]
        s = v @ ones
        v /= s[:, None]
        alpha[a : a + n], scale[a : a + n] = v, s
        a += n
    return alpha, scale


def log_likelihoods(m: Model, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The exact log-likelihood of each line."""
    out = np.zeros(len(size))
    for a, b in _blocks(size):
        first, last = int(size[:a].sum()), int(size[:b].sum())
        y = _layout(size[a:b])
        _, scale = _forward(m, m.emit[x[first:last][y.order]], y)
        line = y.rank[np.arange(y.at[-1]) - np.repeat(y.at[:-1], y.live)]
        out[a:b] = np.bincount(line, np.log(scale), b - a)
    return out


def _blocks(size: np.ndarray):
    total = np.r_[0, np.cumsum(size, dtype=np.int64)]
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, "right")) - 1)
        yield a, b
        a = b


def expected(m: Model, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and (symbol, state) emissions of lines."""
    k = len(m.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(m.emit), k))
    table, trans = m.emit.astype(np.float32, copy=False), m.moves.astype(np.float32)
    back = np.ascontiguousarray(trans.T)
    for a, b in _blocks(size):
        first, last = int(size[:a].sum()), int(size[:b].sum())
        y = _layout(size[a:b])
        obs = x[first:last][y.order]
        e = table[obs]
        alpha, scale = _forward(m, e, y)
        e /= scale[:, None]
        beta = np.ones_like(e)
        joint = np.zeros((k, k), np.float64)
        for i in range(len(y.live) - 1, 0, -1):
            n, here, prev = int(y.live[i]), int(y.at[i]), int(y.at[i - 1])
            eb = e[here : here + n]
            eb *= beta[here : here + n]
            beta[prev : prev + n] = eb @ back
            joint += alpha[prev : prev + n].T @ eb
        moves += joint * m.moves
        alpha *= beta
        starts += alpha[: y.live[0]].sum(0, dtype=np.float64)
        for s in range(k):
            emits[:, s] += np.bincount(obs, alpha[:, s], len(m.emit))
    return starts, moves, emits


def _pack(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), kind)


def _pack_ints(x: np.ndarray) -> bytes:
    """Integers from 0, byte by byte without the high bytes that are all 0."""
    x = np.ascontiguousarray(x).view(np.uint64).ravel()
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + _pack(x.view(np.uint8).reshape(-1, 8)[:, :wide].T)


def _ints(raw: bytes) -> np.ndarray:
    planes = _unpack(raw[1:], np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return _pack_ints(np.diff(keys, prepend=np.uint64(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_ints(raw), dtype=np.uint64)


def _trim() -> None:
    """Gives the system back what the allocator holds of arrays that are gone, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _share(at: int, parts: list) -> pa.RecordBatch:
    ids, vocabs, ns, xs, sizes, lines = zip(*parts)
    vocab, of = np.unique(np.concatenate(vocabs), return_inverse=True)
    order = np.argsort(-np.bincount(of, np.concatenate(ns), len(vocab)), kind="stable")  # frequent words first, so that the high bytes are mostly 0
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    rank = np.split(rank[of], np.cumsum([len(v) for v in vocabs])[:-1])
    x = np.concatenate([r[x] for r, x in zip(rank, xs)])
    planes = x.view(np.uint8).reshape(-1, 4).T  # byte by byte, which packs best
    raw = [_pack(planes), _pack(np.concatenate(sizes).astype(np.int32)), _pack(np.concatenate(lines).astype(np.int64))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.concat_arrays(ids), pa.array(vocab[order].view(np.int64)))]
    return pa.record_batch([pa.array([at]), *lists, *(pa.array([v], pa.binary()) for v in raw)], ["share", "doc_id", "vocab", "words", "sizes", "lines"])


def _read(docs: DataFrame, symbols: int | None = None) -> DataFrame:
    """A row a share: ids of its texts, its words, each word of its lines by the place in them, words of its lines, lines of its texts."""

    def run(batches):
        at, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for s in C.slices(batch):
                x, size, lines = observe(s.buf, s.offs, symbols)
                held += len(x)
                vocab, x, n = np.unique(x, return_inverse=True, return_counts=True)
                parts.append((s.rows.column("doc_id"), vocab, n, x.astype(np.uint32), size, lines))
                if held >= SHARE:
                    yield _share(at, parts)
                    at, parts, held = at + 1, [], 0
                    _trim()
        if parts:
            yield _share(at, parts)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return C.materialize(plain.mapInArrow(run, "share long, doc_id array<long>, vocab array<long>, words binary, sizes binary, lines binary"))


class _Texts(NamedTuple):
    share: int
    ids: pa.Array
    vocab: np.ndarray
    x: np.ndarray
    size: np.ndarray
    lines: np.ndarray


def _vocab(t, row: int) -> np.ndarray:
    return t.column("vocab")[row].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _texts(t, row: int) -> _Texts:
    raw = lambda name, kind: _unpack(t.column(name)[row].as_py(), kind)
    x = np.ascontiguousarray(raw("words", np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return _Texts(t.column("share")[row].as_py(), t.column("doc_id")[row].values, _vocab(t, row), x, raw("sizes", np.int32), raw("lines", np.int64))


def _sent(share: int, vocab: np.ndarray, units: np.ndarray | None, few: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """A block for each part: the words of a share in the order of their keys, and their counts, whole numbers. Part -1 gets ``few``."""
    keys = vocab * np.uint64(SPREAD)
    by = np.argsort(keys)
    keys = keys[by]
    bounds = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
    cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)].tolist()
    rows = [(k, share, _pack_keys(keys[a:b]), None if units is None else _pack_ints(units[by[a:b]].T.astype(np.int64))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    if few is not None:
        rows.append((-1, share, _pack_keys(np.arange(len(few), dtype=np.uint64)), _pack_ints(few.T.astype(np.int64))))
    return pa.record_batch([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "share", "keys", "units"])


def _parts(read: DataFrame) -> int:
    return max(1, -(-(read.agg(F.sum(F.size("vocab"))).first()[0] or 0) // PART))


def _sums(rows: DataFrame, states: int, whole: bool) -> DataFrame:
    """Sums the blocks of each part. As SUMMED: for each share its words' sums in the order of their keys; for the part its words and their sums, if ``whole``, their number and totals (of part -1, all its sums)."""
    def run(t: pa.Table) -> pa.Table:
        _trim()
        part, shares, blocks = t.column("part")[0].as_py(), t.column("share").to_pylist(), t.column("units")
        keys = [_keys(x.as_py()) for x in t.column("keys")]
        ends = np.r_[0, np.cumsum([len(x) for x in keys])].tolist()
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = np.zeros((len(known), states), np.int64)
        for a, b, units in zip(ends, ends[1:], blocks):
            if units.is_valid:  # a share's words differ
                sums[at[a:b]] += _ints(units.as_py()).view(np.int64).reshape(states, -1).T
        own = [(x, _pack_ints(sums[at[a:b]].T)) for a, b, x in zip(ends, ends[1:], shares) if x is not None and part >= 0]
        total = sums.sum(0) if part >= 0 else sums.ravel()
        n = len(own)
        return pa.table({
            "part": pa.array([part] * (n + 1), pa.int32()), "share": pa.array([x for x, _ in own] + [None], pa.int64()), "keys": pa.array([None] * n + [_pack_keys(known) if whole else None], pa.binary()),
            "units": pa.array([x for _, x in own] + [_pack_ints(sums.T) if whole else None], pa.binary()), "n": pa.array([None] * n + [len(known)], pa.int64()), "total": pa.array([None] * n + [total.tolist()], pa.list_(pa.int64())),
        })

    return rows.groupBy("part").applyInArrow(run, SUMMED)


def _table(m: Trained) -> DataFrame:
    return m.summed.where("share is null and part >= 0").select("part", "share", "keys", "units")


def _over(read: DataFrame, m: Trained, summed: DataFrame, step, schema: str, kind=np.float64) -> DataFrame:
    """``step(model of the share's words, texts)`` for every share, with the sums that the parts sent it."""
    start, moves, total = m.start, m.moves, m.total

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        _trim()
        t = _texts(texts, 0)
        emit, a = np.empty((len(t.vocab), len(start)), kind), 0
        by = np.argsort(t.vocab * np.uint64(SPREAD))
        for i in np.argsort(rows.column("part").to_numpy()).tolist():
            units = _ints(rows.column("units")[i].as_py()).reshape(len(start), -1).T
            emit[by[a : a + len(units)]] = (units / UNIT + SMOOTH) / total
            a += len(units)
        if a != len(emit):
            raise ValueError(f"share {t.share}: sums of {a} of {len(emit)} words")
        return pa.Table.from_batches([step(Model(start, moves, emit), t)])

    rows = summed.where("share is not null").select(F.col("share").alias("of"), "part", "units")
    return read.groupBy("share").cogroup(rows.groupBy("of")).applyInArrow(run, schema)


def train(read: DataFrame, states: int = STATES, passes: int = PASSES) -> Trained:
    if passes < 1:
        raise ValueError("at least one pass")
    parts, first = _parts(read), initial(states)

    def count(m: Model, t: _Texts) -> pa.RecordBatch:
        starts, moves, emits = expected(m, t.x, t.size)
        few = np.concatenate((moves, starts[None]))
        for x in (emits, few):
            x *= UNIT
            np.rint(x, out=x)
        return _sent(t.share, t.vocab, emits, few, parts)

    def begin(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _trim()
                t = _texts(batch, row)
                yield count(Model(first.start, first.moves, drawn(t.vocab, states, kind=np.float32)), t)

    m = None
    for k in range(passes):
        rows = _over(read, m, m.summed, count, SENT, np.float32) if m else read.mapInArrow(begin, SENT)
        summed = C.materialize(_sums(rows, states, k == passes - 1))
        few, n, total = np.zeros((states + 1, states)), 0, np.zeros(states, object)
        for part, words, sums in summed.where("share is null").select("part", "n", "total").collect():  # one row a part
            if part < 0:
                few += np.array(sums).reshape(few.shape)
            else:
                n, total = n + words, total + np.array(sums, object)
        few = few / UNIT + SMOOTH
        moves, start = few[:-1], few[-1]
        old, m = m, Trained(start / start.sum(), moves / moves.sum(1, keepdims=True), total.astype(float) / UNIT + SMOOTH * (n + 1), parts, summed)
        del rows
        _let_go(read, old and old.summed)
    return m


def _let_go(read: DataFrame, old: DataFrame | None) -> None:
    """Removes the counts of the pass before, and has Spark remove the shuffle files of plans that are garbage."""
    jvm = read.sparkSession._jvm
    for file in old.inputFiles() if old else ():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(read.sparkSession._jsc.hadoopConfiguration()).delete(path, False)
    gc.collect()
    jvm.System.gc()


def score(read: DataFrame, m: Trained) -> DataFrame:
    """Scores the texts of ``read``, which needn't be those of the training."""
    parts = m.parts

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _sent(batch.column("share")[row].as_py(), _vocab(batch, row), None, None, parts)

    asked = read.select("share", "vocab").mapInArrow(ask, SENT)
    return _scored(read, m, _sums(asked.unionByName(_table(m)), len(m.start), False))


def _scored(read: DataFrame, m: Trained, summed: DataFrame) -> DataFrame:
    def run(m: Model, t: _Texts) -> pa.RecordBatch:
        text = np.repeat(np.arange(len(t.lines)), t.lines)
        n = np.bincount(text, t.size, len(t.lines)).astype(np.int64)
        ll = np.bincount(text, log_likelihoods(m, t.x, t.size), len(t.lines)) if len(t.size) else np.zeros(len(t.lines))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            ppl = np.exp(-ll / n)
        return pa.record_batch([t.ids, pa.array(n), pa.array(np.round(ll, 4)), pa.array(np.round(ppl, 4), mask=n == 0)], ["doc_id", "n_words", "log_likelihood", "perplexity"])

    return _over(read, m, summed, run, "doc_id long, n_words long, log_likelihood double, perplexity double")


def lm_scores(docs: DataFrame, states: int = STATES, symbols: int | None = None, passes: int = PASSES) -> DataFrame:
    """``doc_id, n_words, log_likelihood, perplexity`` for every row, by a model trained on all of them."""
    C.prepare(docs.sparkSession)
    read = _read(docs, symbols)
    m = train(read, states, passes)
    return _scored(read, m, m.summed)
