"""MinHash near-dedup: the chosen-path set similarity join.

A document is the set of its word 3-grams (lower case; fewer than three words:
one gram of all). 128 minwise tokens stand for the set. In each of several
independent trees, as many as the target ``RECALL`` needs, a node picks ``BRANCH``
token positions by a hash of its own path and passes each document to the children
named by its tokens there. A node of at most ``SMALL`` members is compared
exhaustively; a larger one branches again, and one that is still large at ``LEVELS``
is compared exhaustively too, leaving out only pairs that are already known to be in
one group, so that no partner is ever dropped. Documents with the same tokens are
one member.

A comparison counts the tokens (their low bytes) in which two members agree. Counts
``SURE`` standard deviations above what ``SIMILAR`` gives are links; those down to
``DOUBT`` standard deviations below are only proposed, and the exact Jaccard similarity
of the two sets of grams decides, unless links already join the two in that node.

Groups are the connected components of the links; the least (doc_id, key) of a group
stays, null ids last.

Defined results: text that is null or has no word belongs to no group; texts of any
length are read whole; rows equal in doc_id and text count as one document; equal
texts with different ids are a group; an empty table gives no rows; extra columns
don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOKENS, GRAM, SIMILAR, RECALL, BRANCH, SMALL, LEVELS = 128, 3, 0.55, 0.98, 2, 256, 5
SURE, DOUBT = 4.0, 3.0
#: Documents in doubt whose keys are broadcast (each with one block; fewer if with more); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of sets of grams, and of proposals, in a slot.
BLOCK_BYTES = 16 << 20
#: Signatures that a task knows to be given out already.
SEEN = 200_000
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 32, TOKENS, dtype=np.uint64) | 1).astype(np.uint32)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a slice of lower-case text that have words, their grams end to end, and where each row's begin."""
    w = C.words(buf, offs)
    count = np.diff(w.first)
    rows = np.flatnonzero(count)
    if not len(rows):
        return rows, np.zeros(0, np.uint64), rows
    h = C.span_hashes(buf, w.start, w.end)
    g = C.gram_hashes(h, GRAM)
    whole = g[w.doc[: len(g)] == w.doc[GRAM - 1 :]] if len(g) else g
    size = np.maximum(count[rows] - GRAM + 1, 1)
    first = np.r_[0, np.cumsum(size)[:-1]]
    short = count[rows] < GRAM
    x = np.empty(size.sum(), np.uint64)
    is_short = np.zeros(len(x), bool)
    is_short[first[short]] = True
    x[~is_short] = whole
    for at, r in zip(first[short], rows[short]):
        x[at] = C.mix(h[w.first[r] : w.first[r + 1]] * np.arange(3, 3 + 2 * count[r], 2, dtype=np.uint64)).sum()
    return rows, x, first


def signatures(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a slice of lower-case text that have words, and their minwise tokens."""
    rows, x, first = grams(buf, offs)
    sig = np.empty((len(rows), TOKENS), np.uint32)
    if len(rows):
        x32 = (C.mix(x) >> np.uint64(32)).astype(np.uint32)
        for j in range(TOKENS):
            sig[:, j] = np.minimum.reduceat((x32 ^ _XOR[j]) * _MUL[j], first)
    return rows, sig


def trees_for(similar: float, recall: float = RECALL) -> int:
    """Trees after which a pair of that similarity has met in a node with probability ``recall``, whatever the nodes' sizes."""
    meet = 1.0
    for _ in range(LEVELS):
        meet = 1 - (1 - similar * meet) ** BRANCH
    return 1 if meet >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))


def _names(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of tokens."""
    return C.mix(C.mix(sig.astype(np.uint64) + (np.arange(1, TOKENS + 1, dtype=np.uint64) << np.uint64(32))).sum(axis=1)).view(np.int64)


def _bytes(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column that is null where they aren't ``there``."""
    own = np.ascontiguousarray(rows[there])
    raw = pa.Array.from_buffers(pa.binary(rows.shape[1]), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
    return raw.take(pa.array(np.cumsum(there) - 1, mask=~there))


def _sign(batches):
    """Tokens are given, as their low bytes and the others, the first time a task meets them."""
    seen: set[int] = set()
    for batch in batches:
        for s in C.slices(batch):
            rows, sig = signatures(s.buf, s.offs)
            if len(rows):
                take, g = s.rows.take(pa.array(rows)), _names(sig)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.fromiter((x not in seen and not seen.add(x) for x in g.tolist()), bool, len(g))
                parts = np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), TOKENS, 4)
                low, high = _bytes(parts[:, :, 0], fresh), _bytes(parts[:, :, 1:].reshape(len(sig), -1), fresh)
                yield pa.record_batch([take.column("_k"), take.column("_j"), take.column("doc_id"), pa.array(g), pa.array(np.diff(s.offs)[rows]), low, high], ["_k", "_j", "doc_id", "g", "size", "low", "high"])


def _sets(batches):
    """``g, blocks, grams``: the distinct grams of each row, once in a task for each ``g``."""
    seen: set[int] = set()
    for batch in batches:
        fresh = [x not in seen and not seen.add(x) for x in batch.column("g").to_pylist()]
        for s in C.slices(batch.filter(pa.array(fresh, pa.bool_()))):
            rows, x, first = grams(s.buf, s.offs)
            ends = np.r_[first, len(x)].astype(np.int64)
            parts = [np.unique(x[a:b]).view(np.int64) for a, b in zip(ends, ends[1:])]
            if parts:
                take = s.rows.take(pa.array(rows))
                yield pa.record_batch([take.column("g"), take.column("blocks"), C.list_column(np.concatenate(parts), np.array([len(p) for p in parts]), pa.int64())], ["g", "blocks", "grams"])


def _alike(similar: float):
    """Of the pairs ``u, v`` of a block those that have the similarity by the sets of that block."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = {}
        for g, grams in ((c.column("g"), c.column("grams")) for c in sets.to_batches()):
            ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)  # in whose order they are sorted
            of.update((x, flat[a:b]) for x, a, b in zip(g.to_pylist(), ends, ends[1:]))
        good = np.zeros(pairs.num_rows, bool)
        for i, (u, v) in enumerate(zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist())):
            a, b = sorted((of[u], of[v]), key=len)
            both = int(np.count_nonzero(b[np.searchsorted(b, a).clip(max=len(b) - 1)] == a))
            good[i] = both >= similar * (len(a) + len(b) - both)
        return pairs.select(["u", "v"]).filter(pa.array(good))

    return run


def _matrix(col: pa.Array, kind) -> np.ndarray:
    _, o, d = col.buffers()
    o = np.frombuffer(o, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(d, np.uint8)[o[0] : o[-1]].view(kind).reshape(len(col), -1)


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    parts = np.empty((batch.num_rows, TOKENS, 4), np.uint8)
    parts[:, :, 0] = _matrix(batch.column("low"), np.uint8)
    parts[:, :, 1:] = _matrix(batch.column("high"), np.uint8).reshape(-1, TOKENS, 3)
    return parts.view(np.uint32)[:, :, 0]


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """For each row, the BRANCH children (path hashes) of its node that it goes to."""
    out = np.empty((len(node), BRANCH), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BRANCH):
            pick = C.mix(node + np.uint64(0x9E3779B97F4A7C15) * np.uint64(b + 1))
            at = (pick % np.uint64(TOKENS // BRANCH)).astype(np.int64) + b * (TOKENS // BRANCH)
            out[:, b] = C.mix(node ^ C.mix(sig[np.arange(len(sig)), at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))))
    return out


def _roots(trees: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _tokens(batch)
            g = batch.column("g").to_numpy()
            for t in range(trees):
                kids = _children(np.full(len(sig), C.mix(np.array([t + 1], np.uint64))[0]), sig)
                yield pa.record_batch([pa.array(kids.ravel().view(np.int64)), pa.array(np.repeat(g, BRANCH))], ["node", "g"])

    return run


def _branch(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        kids = _children(batch.column("node").to_numpy().view(np.uint64), _tokens(batch))
        yield pa.record_batch([pa.array(kids.ravel().view(np.int64)), pa.array(np.repeat(batch.column("g").to_numpy(), BRANCH))], ["node", "g"])


def _bounds(similar: float) -> tuple[int, int]:
    """Agreements from which a pair is proposed, and from which it is a link."""
    mean, deviation = similar * TOKENS, (TOKENS * similar * (1 - similar)) ** 0.5
    return max(1, int(np.ceil(mean - DOUBT * deviation))), min(TOKENS, int(np.ceil(mean + SURE * deviation)))


def group_edges(g: np.ndarray, sk: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Edges that connect whatever an exhaustive comparison of these members connects."""
    return _grouped(g, sk, need)[0]


def _grouped(g: np.ndarray, sk: np.ndarray, need: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    comp, out = np.full(len(g), -1), []

    def link(i: int, js: np.ndarray) -> None:
        for c in np.unique(comp[js]):
            if c >= 0 and c != comp[i]:
                out.append((int(g[i]), int(g[js[comp[js] == c][0]])))
                comp[comp == c] = comp[i]
        fresh = js[comp[js] < 0]
        out.extend((int(g[i]), int(g[j])) for j in fresh)
        comp[fresh] = comp[i]

    for i in range(len(g)):  # each member outside every group so far starts one
        if comp[i] < 0:
            comp[i] = i
            link(i, np.flatnonzero((np.count_nonzero(sk == sk[i], axis=1) >= need) & (comp != i)))
    for own in _others(comp):  # pairs across groups, whose names may change on the way
        for i in own:
            other = np.flatnonzero(comp != comp[i])
            hit = other[np.count_nonzero(sk[other] == sk[i], axis=1) >= need]
            if len(hit):
                link(i, hit)
    return out, comp


def _others(comp: np.ndarray) -> list[np.ndarray]:
    """The members of each group but the largest."""
    names, sizes = np.unique(comp, return_counts=True)
    return [np.flatnonzero(comp == c) for c in names[np.argsort(sizes)][:-1]]


def _doubtful(g: np.ndarray, sk: np.ndarray, comp: np.ndarray, low: int) -> list[tuple[int, int]]:
    """Pairs across groups that are proposed only."""
    out = []
    for own in _others(comp):
        for i in own:
            other = np.flatnonzero(comp != comp[i])
            out.extend((int(g[i]), int(g[j])) for j in other[np.count_nonzero(sk[other] == sk[i], axis=1) >= low])
    return out


def _roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges, and the least of the component of each, all in this task."""
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b, top = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = new[new]
        if (new == top).all():
            return names, names[top]
        top = new


def _compare(low: int, high: int):
    def whole(node, g, sk):
        if not len(node):
            return
        new = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[new, len(node)])
        links, doubts = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for a, n in zip(new[size > SMALL], size[size > SMALL]):
            edges, comp = _grouped(g[a : a + n], sk[a : a + n], high)
            links.append(np.array(edges, np.int64).reshape(-1, 2))
            doubts.append(np.array(_doubtful(g[a : a + n], sk[a : a + n], comp, low), np.int64).reshape(-1, 2))
        rows = np.flatnonzero(np.repeat(size <= SMALL, size))
        last = np.repeat(new + size, size)
        for d in range(1, SMALL):
            rows = rows[rows + d < last[rows]]
            if not len(rows):
                break
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                agree = np.count_nonzero(sk[part] == sk[part + d], axis=1)
                for of, hit in ((links, part[agree >= high]), (doubts, part[(agree >= low) & (agree < high)])):
                    of.append(np.stack((g[hit], g[hit + d]), 1))
        links, doubts = np.concatenate(links), np.concatenate(doubts)
        names, top = _roots_of(links[:, 0], links[:, 1])
        if len(doubts):  # those that links join already need no decision
            ends = [np.searchsorted(names, doubts[:, c]).clip(0, max(len(names) - 1, 0)) for c in (0, 1)]
            root = [np.where(names[e] == doubts[:, c], top[e], doubts[:, c]) if len(names) else doubts[:, c] for c, e in enumerate(ends)]
            doubts = np.unique(np.sort(doubts[root[0] != root[1]], axis=1), axis=0)
        apart = names != top  # a star joins what the links join
        u, v = np.r_[top[apart], doubts[:, 0]], np.r_[names[apart], doubts[:, 1]]
        if len(u):
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) < apart.sum())], ["u", "v", "sure"])

    def run(batches):  # sorted by node; a node may go on in the next batch
        node, g, sk = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS), np.uint8)
        held: list = []
        for batch in batches:
            n, x, y = batch.column("node").to_numpy(), batch.column("g").to_numpy(), _matrix(batch.column("sketch"), np.uint8)
            if not len(n):
                continue
            if held and n[-1] == held[0][0][0] and n[0] == n[-1]:
                held.append((n, x, y))
                continue
            held.append((n, x, y))
            node, g, sk = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(node == node[-1], True)) if len(node) else 0
            yield from whole(node[:cut], g[:cut], sk[:cut])
            held = [(node[cut:], g[cut:], sk[cut:])]
        if held:
            yield from whole(*(np.concatenate(c) for c in zip(*held)))

    return run


def components(edges: DataFrame) -> DataFrame:
    """``g, c``: the least member of the connected component of each vertex of ``u, v``.

    Alternates large-star and small-star steps until the edges stay the same.
    """
    edges = C.materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = F.min("v").over(Window.partitionBy("u"))
        large = both.select("u", "v", F.least("u", least).alias("m")).where("v > u").select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("a"), F.col("u").alias("b")).where("a > b")
        low = down.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        small = low.select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v")).where("u <> v").distinct()
        edges = C.materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    pairs = edges.groupBy(F.col("v").alias("g")).agg(F.min("u").alias("c"))
    return pairs.union(edges.select(F.col("u").alias("g"), F.col("u").alias("c")).distinct())


def _decided(doubts: DataFrame, signed: DataFrame, lower: DataFrame, similar: float) -> DataFrame:
    """Of the proposed pairs ``u, v`` those whose sets of grams have the similarity.

    Documents that proposals connect are cut into slots of about ``BLOCK_BYTES``, and a set goes once to each
    pair of slots in which its document has proposals, instead of once to each proposal.
    """
    parts = max(int(doubts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ends = doubts.select("u").union(doubts.select("v")).groupBy(F.col("u").alias("g")).agg(F.count("*").alias("n"))
    ends = signed.select("_k", "g", "size").join(ends, "g").groupBy("g").agg(F.min("_k").alias("_k"), (4 * F.max("size") + 16 * F.max("n")).alias("bytes"))  # a gram takes two bytes of text or more
    ends = C.materialize(ends.join(components(doubts), "g"))
    slots = ends.groupBy("c").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("long").alias("slots"))
    ends = C.materialize(ends.join(slots, "c").select("g", "_k", "c", F.pmod(F.xxhash64("g"), "slots").alias("s")))
    pairs = doubts.join(ends.select(F.col("g").alias("u"), F.col("s").alias("su"), "c"), "u").join(ends.select(F.col("g").alias("v"), F.col("s").alias("sv")), "v")
    pairs = C.materialize(pairs.select("u", "v", F.xxhash64("c", F.least("su", "sv"), F.greatest("su", "sv")).alias("block")))
    blocks = pairs.select(F.col("u").alias("g"), "block").union(pairs.select("v", "block")).groupBy("g").agg(F.collect_set("block").alias("blocks"))
    wanted = C.materialize(ends.select("_k", "g").join(blocks, "g"))
    few = wanted.agg(F.sum(F.size("blocks") + 1)).first()[0] or 0
    texts = lower.select("_k", "text").join(F.broadcast(wanted) if few <= 2 * BROADCAST_ROWS else wanted.hint("merge"), "_k")
    sets = texts.mapInArrow(_sets, "g long, blocks array<long>, grams array<long>").select("g", F.explode("blocks").alias("block"), "grams")
    sets = sets.repartition(parts, "block").groupBy("block", "g").agg(F.first("grams").alias("grams"))  # equal rows share a key
    return pairs.groupBy("block").cogroup(sets.groupBy("block")).applyInArrow(_alike(similar), "u long, v long")


def _groups(docs: DataFrame, similar: float, trees: int | None) -> DataFrame:
    """``_k, _j, doc_id, keep`` (the struct of the one that stays) for members of groups of two or more documents."""
    spark = C.prepare(docs.sparkSession)
    lower = C.keyed(docs).withColumns({"_j": C.second("doc_id", "text"), "text": F.lower("text")})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # in buckets of g, so that neither the joins nor the aggregate below write the tokens again
    signed = C.bucketed(lower.mapInArrow(_sign, "_k long, _j long, doc_id long, g long, size long, low binary, high binary"), parts, "g", unique=False)
    reps = signed.where("low is not null").groupBy("g").agg(F.first("low").alias("low"), F.first("high").alias("high"))

    def sized(rows):
        n = F.count("*").over(Window.partitionBy("node"))
        return C.materialize(rows.select("node", "g", n.alias("n")).where("n > 1"))

    at = sized(reps.mapInArrow(_roots(trees or trees_for(similar)), "node long, g long"))
    leaves = at.where(F.col("n") <= SMALL)
    for level in range(LEVELS):
        big = at.where(F.col("n") > SMALL)
        if big.isEmpty():
            break
        if level == LEVELS - 1:
            leaves = leaves.union(big)
            break
        at = sized(big.join(reps, "g").select("node", "g", "low", "high").mapInArrow(_branch, "node long, g long"))
        leaves = leaves.union(at.where(F.col("n") <= SMALL))
    sketch = reps.select("g", F.col("low").alias("sketch"))
    met = leaves.select("node", "g").join(sketch, "g").repartition(parts, "node").sortWithinPartitions("node")
    edges = C.materialize(met.mapInArrow(_compare(*_bounds(similar)), "u long, v long, sure boolean"))
    doubts = C.materialize(edges.where("not sure").select("u", "v").distinct())
    comp = components(edges.where("sure").select("u", "v").union(_decided(doubts, signed, lower, similar)))
    owned = signed.select("_k", "_j", "doc_id", "g").distinct().join(comp, "g", "left").select("_k", "_j", "doc_id", F.coalesce("c", "g").alias("c"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "_j")
    keep = owned.groupBy("c").agg(F.min(order).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return owned.join(keep, "c").select("_k", "_j", "doc_id", "keep")


def _gone(docs: DataFrame, similar: float, trees: int | None) -> DataFrame:
    return _groups(docs, similar, trees).where("_k <> keep._k or _j <> keep._j")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, trees: int | None = None) -> DataFrame:
    """``doc_id, keep_id``: each document that goes, and the one of its group that stays."""
    return _gone(docs, similar, trees).select("doc_id", F.col("keep.doc_id").alias("keep_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR, trees: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates; of equal rows one stays."""
    gone = C.materialize(_gone(docs, similar, trees).select("_k", "_j"))
    plain, restore = C.numbered_keyed(docs)
    plain = plain.withColumn("_j", C.second("_id", "_text"))
    return restore(plain.join(gone, ["_k", "_j"], "left_anti").dropDuplicates(["_k", "_j"]))
