"""SentencePiece encoding and decoding: a max-plus parallel scan.

The public model is a merge (BPE) model: its scores are merge ranks, whose sum
says nothing about a segmentation. What makes a sequence of pieces the model's
own encoding is that every two neighbours are *compatible*: the merges of their
joint text give just these two. So the weights of the max-plus lattice are 0 for
compatible neighbours and minus infinity for others, and the one path of weight 0
is the encoding. Two neighbouring characters that no piece holds next to each
other are a *hard* boundary: every path passes through it.

A text of more than ``CHUNK`` characters is cut into chunks that are handled
anywhere on the cluster: (1) a chunk yields a transfer matrix between the states
of its two boundaries, a state being a piece that reaches the boundary or across
it; (2) the matrices of a text are combined associatively, which leaves one state
at each boundary; (3) each chunk is backtraced for itself between its two states.
Of the spans between hard boundaries, each distinct one of a slice (told apart by its
characters) is worked out once; short ones side by side, a merge of each a step.

Defined results, one row for each input row: null and empty texts have no ids;
characters outside the vocabulary become byte pieces; texts that hold the model's
space mark itself don't come back intact; texts of any length are read whole; equal
rows give equal rows; an empty table gives none; extra columns don't matter. Two
paths of weight 0, which merges rule out, would end the job with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

CHUNK = 16_384
#: Pairs of neighbours in a generation of those that a worker remembers.
PAIRS = 40_000
#: Spans of up to so many characters are worked out side by side, longer ones each for itself.
SIDE_BY_SIDE = 32
_NONE = np.iinfo(np.int32).max


class Pairs:
    """What is known about pairs of neighbours, in two generations: when the young one is full, the old one goes."""

    def __init__(self, fits):
        self.fits, self.young, self.old = fits, {}, {}

    def __call__(self, left: str, right: str) -> bool:
        key = left, right
        ok = self.young.get(key)
        if ok is None:
            ok = self.old.get(key)
            if ok is None:
                ok = self.fits(left, right)
            if len(self.young) >= PAIRS:
                self.old, self.young = self.young, {}
            self.young[key] = ok
        return ok


class Lattice:
    def __init__(self, pieces: P.Pieces):
        self.p, self.ids = pieces, pieces.pieces
        self.longest = max(map(len, self.ids))
        self.pairs = Pairs(self.fits)
        self._undo()
        chars = sorted({c for p in self.ids for c in p})
        self.cls = np.zeros(0x110000, np.int32)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.soft = np.zeros(self.width * self.width, bool)
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.soft[self.cls[ord(a)] * self.width + self.cls[ord(b)]] = True
        self._tables(chars)

    def _tables(self, chars: list[str]) -> None:
        """Merges as arrays. Symbols are piece ids, then characters that aren't pieces, by their code points."""
        self.first = max(self.ids.values()) + 1
        symbol = {c: self.ids.get(c, self.first + ord(c)) for c in chars} | self.ids
        self.base = self.first + 0x110000
        self.of_char = np.arange(self.first, self.base)
        self.of_char[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        order = {score: i for i, score in enumerate(sorted({*self.p.scores.values()}, reverse=True))}
        rows = sorted(
            (symbol[p[:i]] * self.base + symbol[p[i:]], order[self.p.scores[k]], k)
            for p, k in self.ids.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol
        )
        table = np.array([*rows, (1 << 62, _NONE, 0)], np.int64)
        self.pair, self.order, self.joined = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of merges, and result, of each pair of symbols; -1 is no symbol."""
        key = left.astype(np.int64) * self.base + right
        e = np.searchsorted(self.pair, key)
        hit = (self.pair[e] == key) & (right >= 0) & (left >= 0)
        return np.where(hit, self.order[e], _NONE), self.joined[e]

    def side_by_side(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of short spans, end to end, and how many each has: a step makes the next merge of every span.

        The path of weight 0 of a span is what the merges leave of it.
        """
        size = np.diff(offs)
        count = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        edges = [0, 4, 8, 12, 20, SIDE_BY_SIDE]
        for low, width in zip(edges, edges[1:]):  # spans of similar lengths are the rows of a matrix
            rows = np.flatnonzero((size > low) & (size <= width))
            if not len(rows):
                continue
            col = np.arange(width)
            at = offs[rows][:, None] + col
            inside = col < size[rows][:, None]
            s = np.where(inside, self.of_char[cps[np.minimum(at, len(cps) - 1)]], -1).astype(np.int32)
            rank, to = np.full(s.shape, _NONE, np.int32), np.zeros(s.shape, np.int32)
            rank[:, :-1], to[:, :-1] = self._merge_of(s[:, :-1], s[:, 1:])
            while True:
                best = rank.argmin(1)  # the leftmost of equals
                on = rank[np.arange(len(rows)), best] < _NONE
                if not on.all():
                    done.append((rows[~on], s[~on]))
                    rows, best, s, rank, to = rows[on], best[on], s[on], rank[on], to[on]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                s[line, best] = to[line, best]
                take = np.minimum(col + (col > best[:, None]), width - 1) + line[:, None] * width
                s, rank, to = s.ravel()[take], rank.ravel()[take], to.ravel()[take]
                s[:, -1], rank[:, -1] = -1, _NONE  # a span is one symbol shorter now
                for j in (best - 1, best):  # the pairs that the new symbol is in
                    ok = (j >= 0) & (j < width - 1)
                    i, j = line[ok], j[ok]
                    rank[i, j], to[i, j] = self._merge_of(s[i, j], s[i, j + 1])
        for rows, s in done:
            count[rows] = np.count_nonzero(s >= 0, axis=1)
        out, first = np.empty(count.sum(), np.int32), np.cumsum(count) - count
        for rows, s in done:
            held = s >= 0
            out[np.repeat(first[rows], count[rows]) + (np.cumsum(held, axis=1) - 1)[held]] = s[held]
        return out, count

    def hard(self, cps: np.ndarray) -> np.ndarray:
        """For each character but the first: whether the boundary before it is hard."""
        c = self.cls[cps]
        return ~self.soft[c[:-1] * self.width + c[1:]]

    def merges(self, text: str, but: str = "") -> list[str]:
        """The model's merges on a short text, the plain way; ``but`` is never made."""
        s, ids, scores = list(text), self.ids, self.p.scores
        while True:
            best, at = -np.inf, -1
            for i in range(len(s) - 1):
                k = ids.get(s[i] + s[i + 1])
                if k is not None and scores[k] > best and s[i] + s[i + 1] != but:
                    best, at = scores[k], i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _undo(self) -> None:
        """For each piece the two that its last merge joins (None for characters), and the rank of that merge."""
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.rank: dict[str, float] = {}
        for p, k in self.ids.items():
            if len(p) > 1:
                # the merges of a piece but the last leave two; pieces that merges don't reach are never neighbours
                s = self.merges(p, p)
                self.parts[p] = (s[0], s[1]) if len(s) == 2 else None
                self.rank[p] = -self.p.scores[k]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces may be neighbours; ``left`` is '' at the start of a text.

        The merges of both sides are undone, the last one first, while no merge across
        their boundary would have come before the one undone; of equal ranks the
        leftmost merge comes first.
        """
        if P.SPACE + P.SPACE in left + right:  # runs of the space mark share one rank
            return self.merges(left + right) == ([left, right] if left else [right])
        if not left:
            return len(right) == 1 or self.parts.get(right) is not None
        parts, rank, limit, inclusive = self.parts, self.rank, np.inf, True
        if (len(left) > 1 and parts.get(left) is None) or (len(right) > 1 and parts.get(right) is None):
            return False
        while True:
            across = rank.get(left + right)
            if across is not None and (across < limit or (inclusive and across == limit)):
                return False
            a, b = rank.get(left, -1.0) if len(left) > 1 else -1.0, rank.get(right, -1.0) if len(right) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit, inclusive = parts[left][1], a, False
            else:
                right, limit, inclusive = parts[right][0], b, True

    def path(self, text: str) -> list[str]:
        """The pieces of a text: forward over the lattice, then back along the only path."""
        n, ids, longest, fits = len(text), self.ids, self.longest, self.pairs
        last = [""] * (n + 1)
        for i in range(1, n + 1):
            for k in range(i - longest if i > longest else 0, i):
                piece = text[k:i]
                if (piece in ids or k == i - 1) and (last[k] or not k) and fits(last[k], piece):
                    last[i] = piece
                    break
        out = []
        while n:
            if not last[n]:  # a model whose merges never leave this: none is known
                return self.merges(text)
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _ids(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters outside the vocabulary become bytes."""
        odd = np.flatnonzero(symbols >= self.first)
        if not len(odd):
            return symbols, count
        size = np.ones(len(symbols), np.int64)
        chars, which = np.unique(symbols[odd] - self.first, return_inverse=True)
        spelled = [[self.p.bytes_[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars]
        size[odd] = np.array([len(x) for x in spelled])[which]
        first = np.cumsum(size) - size
        out = np.repeat(symbols, size)
        for k, ids in enumerate(spelled):
            for i, b in enumerate(ids):
                out[first[odd[which == k]] + i] = b
        total = np.r_[0, np.cumsum(size)]
        ends = np.r_[0, np.cumsum(count)]
        return out, total[ends[1:]] - total[ends[:-1]]

    def symbols(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of spans between hard boundaries, end to end, and how many each has."""
        size = np.diff(offs)
        long = np.flatnonzero(size > SIDE_BY_SIDE)
        out, count = self.side_by_side(cps, offs)
        if len(long):
            parts = []
            for i in long:
                text = cps[offs[i] : offs[i + 1]].tobytes().decode("utf-32-le", "surrogatepass")
                parts.append(np.array([self.ids[p] if p in self.ids else self.first + ord(p) for p in self.path(text)], np.int32))
            at = (np.cumsum(count) - count)[long]
            count[long] = [len(p) for p in parts]
            out = np.insert(out, np.repeat(at, count[long]), np.concatenate(parts))
        return out, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked texts, one after the other, and how many each has."""
        cps = P.code_points("".join(texts))
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        offs = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        cut = np.ones(len(cps) + 1, bool)
        cut[1:-1] = self.hard(cps)
        cut[offs] = True
        at = np.flatnonzero(cut)
        spans = P.distinct(cps, at)
        ids, count = self._ids(*self.symbols(spans.cps, spans.offs))
        size = count[spans.which]
        total = np.r_[0, np.cumsum(size)]
        flat = ids[np.arange(total[-1]) + np.repeat((np.cumsum(count) - count)[spans.which] - total[:-1], size)]
        first = np.searchsorted(at, offs)
        return flat, total[first[1:]] - total[first[:-1]]

    def states(self, text: str, c: int) -> list[tuple[int, int]]:
        """The pieces text[s:e] with s < c <= e."""
        out = []
        for s in range(max(0, c - self.longest), c):
            for e in range(c, min(len(text), s + self.longest) + 1):
                if (e == s + 1 or text[s:e] in self.ids) and self.pairs("", text[s:e]):
                    out.append((s, e))
        return out

    def transfer(self, text: str, a: int, b: int, first: bool, last: bool) -> list[int]:
        """For each state at ``b``, a bit for each state at ``a`` from which a path of weight 0 leads to it."""
        ends: dict[int, dict[int, int]] = {}  # end -> start -> mask

        def forward(lo: int, hi: int) -> None:
            for p in range(lo, hi):
                here = ends.get(p)
                if not here:
                    continue
                for e in range(p + 1, min(len(text), p + self.longest) + 1):
                    piece = text[p:e]
                    if e > p + 1 and piece not in self.ids:
                        continue
                    mask = 0
                    for s, m in here.items():
                        if self.pairs(text[s:p] if s >= 0 else "", piece):
                            mask |= m
                    if mask:
                        ends.setdefault(e, {})[p] = mask

        if first:
            ends[a] = {-1: 1}
        else:
            for i, (s, e) in enumerate(self.states(text, a)):
                ends.setdefault(e, {})[s] = 1 << i
        hard = np.flatnonzero(self.hard(P.code_points(text))) + 1
        inner = hard[(hard >= a + self.longest) & (hard <= b - self.longest)]
        if len(inner):
            h1, h2 = int(inner[0]), int(inner[-1])
            forward(a, h1)
            mask = 0
            for m in ends.get(h1, {}).values():
                mask |= m
            ends.clear()
            ends[h2] = {-1: mask}
            forward(h2, b)
        else:
            forward(a, b)
        return [ends.get(e, {}).get(s, 0) for s, e in (self.states(text, b) if not last else [(s, len(text)) for s in range(max(0, len(text) - self.longest), len(text))])]


def combine(x: list[int], y: list[int]) -> list[int]:
    """The product of two transfer matrices; it is associative."""
    out = []
    for row in y:
        m = 0
        while row:
            low = row & -row
            m |= x[low.bit_length() - 1]
            row ^= low
        out.append(m)
    return out


def scan(matrices: list[list[int]]) -> list[list[int]]:
    """All products of the first 1, 2, ... matrices, by a balanced tree."""
    if len(matrices) < 2:
        return matrices
    pairs = [combine(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    even = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(even[i // 2] if i % 2 else combine(even[i // 2 - 1], matrices[i]))
    return out


def resolve(matrices: list[list[int]]) -> list[int]:
    """The state at each boundary: the one on the path of weight 0 from start to end."""
    before = scan(matrices)  # row j of before[k]: whether the start leads to state j
    good, out = [j for j, m in enumerate(before[-1]) if m], []
    if len(good) != 1:
        raise ValueError(f"{len(good)} paths of weight 0")
    at = good[0]
    for k in range(len(matrices) - 1, -1, -1):
        out.append(at)
        if k:
            from_ = [i for i in range(len(before[k - 1])) if matrices[k][at] >> i & 1 and before[k - 1][i]]
            if len(from_) != 1:
                raise ValueError(f"{len(from_)} paths of weight 0")
            at = from_[0]
    return out[::-1]


def decode(pieces: P.Pieces):
    """A function from ids, one text after the other, and their counts to UTF-8 bytes and sizes."""
    size_of = np.array([len(r) for r in pieces.raw], np.int64)
    start_of = np.r_[0, np.cumsum(size_of)[:-1]]
    table = np.frombuffer(b"".join(pieces.raw), np.uint8)

    def run(flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = size_of[flat]
        start, total = start_of[flat], np.r_[0, np.cumsum(size)]
        out = table[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        offs = total[np.r_[0, np.cumsum(count)]]
        some = np.flatnonzero(offs[1:] > offs[:-1])
        mark = offs[some][out[offs[some]] == 32]  # the space that encoding puts first
        sizes = np.diff(offs)
        sizes[some[out[offs[some]] == 32]] -= 1
        return np.delete(out, mark), sizes

    return run


def marked(text: str | None) -> str:
    return P.SPACE + text.replace(" ", P.SPACE) if text else ""


_lattices: dict[str, Lattice] = {}


def _lattice(pieces: P.Pieces, name: str) -> Lattice:
    if name not in _lattices:
        _lattices.clear()
        _lattices[name] = Lattice(pieces)
    return _lattices[name]


def _cuts(n: int, chunk: int) -> list[int]:
    k = max(1, n // chunk)
    return [i * chunk for i in range(k)] + [n]


_CHUNK_DDL = "_k string, doc_id long, no int, last boolean, a int, b int, text string"
#: Bytes of chunks that make a batch.
BATCH = 1 << 22


def encode_documents(docs: DataFrame, path: str = P.MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids`` for every row."""
    spark = C.prepare(docs.sparkSession)
    pieces = P.load(path)
    longest = max(map(len, pieces.pieces))
    if chunk < 2 * longest:
        raise ValueError(f"chunk must be at least {2 * longest}")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    giant = F.coalesce(F.length("text") >= 2 * chunk - 1, F.lit(False))

    def whole(batches):
        lattice = _lattice(pieces, path)
        for batch in batches:
            for s in C.slices(batch):
                flat, count = lattice.encode([marked(t) for t in s.rows.column("text").to_pylist()])
                yield pa.record_batch([s.rows.column("doc_id"), C.list_column(flat, count, pa.int32())], ["doc_id", "ids"])

    def split(batches):
        schema = pa.schema([("_k", pa.string()), ("doc_id", pa.int64()), ("no", pa.int32()), ("last", pa.bool_()), ("a", pa.int32()), ("b", pa.int32()), ("text", pa.string())])
        held, size = [], 0
        for batch in batches:
            for key, doc_id, raw in zip(*(batch.column(c) for c in ("_k", "doc_id", "text"))):
                text = marked(raw.as_py())
                cuts = _cuts(len(text), chunk)
                for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    lo, hi = max(0, a - longest), min(len(text), b + longest)
                    held.append((key.as_py(), doc_id.as_py(), no, b == len(text), a - lo, b - lo, text[lo:hi]))
                    size += hi - lo
                    if size >= BATCH:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def matrices(batches):
        lattice = _lattice(pieces, path)
        for batch in (s.rows for whole_batch in batches for s in C.slices(whole_batch)):
            rows = [lattice.transfer(r["text"], r["a"], r["b"], r["no"] == 0, r["last"]) for r in batch.to_pylist()]
            packed = [[m.to_bytes(-(-m.bit_length() // 8), "little") for m in r] for r in rows]
            yield pa.record_batch([batch.column("_k"), batch.column("no"), pa.array(packed, pa.list_(pa.binary()))], ["_k", "no", "matrix"])

    def states(batches):  # sorted by (_k, no)
        key, held = None, []

        def out():
            s = resolve(held)
            cols = [pa.array([key] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array([None, *s[:-1]], pa.int32()), pa.array(s, pa.int32())]
            return pa.record_batch(cols, ["_k", "no", "enter", "leave"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["_k"] != key and held:
                    yield out()
                    held = []
                key = r["_k"]
                held.append([int.from_bytes(m, "little") for m in r["matrix"]])
        if held:
            yield out()

    def trace(batches):
        lattice = _lattice(pieces, path)
        for batch in (s.rows for whole_batch in batches for s in C.slices(whole_batch)):
            texts = []
            for r in batch.to_pylist():
                t = r["text"]
                lo = r["a"] if r["enter"] is None else lattice.states(t, r["a"])[r["enter"]][1]
                hi = len(t) if r["last"] else lattice.states(t, r["b"])[r["leave"]][1]
                texts.append(t[lo:hi])
            flat, count = lattice.encode(texts)
            yield pa.record_batch([batch.column("_k"), batch.column("doc_id"), batch.column("no"), C.list_column(flat, count, pa.int32())], ["_k", "doc_id", "no", "ids"])

    short = plain.where(~giant).mapInArrow(whole, "doc_id long, ids array<int>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # the chunks are shuffled once and stay in buckets; matrices and states come and go to them; equal rows share chunks
    long = plain.where(giant).withColumn("_k", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256))
    chunks = C.bucketed(long.mapInArrow(split, _CHUNK_DDL), parts, "_k", "no")
    table = chunks.mapInArrow(matrices, "_k string, no int, matrix array<binary>")
    state = table.repartition(parts, "_k").sortWithinPartitions("_k", "no").mapInArrow(states, "_k string, no int, enter int, leave int")
    met = chunks.join(state.hint("shuffle_hash"), ["_k", "no"]).select("_k", "doc_id", "no", "last", "a", "b", "text", "enter", "leave")
    traced = met.mapInArrow(trace, "_k string, doc_id long, no int, ids array<int>")
    joined = traced.groupBy("_k").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    copies = long.groupBy("_k").agg(F.count("*").alias("copies")).join(joined, "_k").select("doc_id", F.flatten("parts.ids").alias("ids"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_"))
    return short.unionByName(copies.drop("_"))


def _by_ids(batch: pa.RecordBatch, limit: int = 1 << 20):
    """Cuts a batch between rows into pieces of about ``limit`` ids."""
    ends = batch.column("ids").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def decode_documents(encoded: DataFrame, path: str = P.MODEL) -> DataFrame:
    """``doc_id, ids, text``: the text that the ids stand for; null ids have the empty text."""
    C.prepare(encoded.sparkSession)
    back = decode(P.load(path))

    def run(batches):
        for batch in (b for whole in batches for b in _by_ids(whole)):
            ids = batch.column("ids")
            count = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy().astype(np.int64)
            flat, sizes = back(ids.flatten().to_numpy(), count)
            offs = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            try:
                text = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))])
                text.validate(full=True)
                text = text.cast(pa.string())
            except pa.ArrowInvalid:  # ids that stand for bytes outside UTF-8
                raw = flat.tobytes()
                text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs, offs[1:])])
            yield pa.record_batch([batch.column("doc_id"), ids, text], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
