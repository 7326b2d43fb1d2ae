"""Suffix-array dedup: passages of ``LEAST`` words or more that occur again.

Word n-grams of the corpus are found equal through suffix arrays with common
prefixes, built by external induced sorting (``induced``). The corpus is cut
into shards such that every two equal passages meet in one shard:

1. Winnowing: each 50-word gram chooses one of its 25-word grams, the least
   hash. Equal grams choose equal ones, so a gram whose choice was made at one
   place of the corpus only is left out. This drops no repeat.
2. Each 50-word gram that is left goes with its minimizer (the least hash of its
   12-word grams), which depends on nothing but the gram; overlapping grams of one
   minimizer travel as one window. Equal windows are one from here on, with the least
   and the greatest of their places, however often they occur; the places stay where
   they are. Minimizers fall into as many shards as the counted words ask for.
3. A shard sorts the suffixes of its windows. Neighbours with a common prefix of
   50 words are a class of equal grams. What a window has of first and later
   occurrences is joined back to its places.

A shard's windows go to a file as they come. Where they are more than ``IN_MEMORY``
words, all that grows with them (text, suffixes, prefixes, queues, flags) is in files
of the executor's local folder, mapped and walked in blocks; what stays in memory is
a few numbers a window and the distinct words.

A document is (doc_id, text): rows equal in both count as one. The first
occurrence of a gram is the one with the least (doc_id, key, word); null ids
come last. A word is *repeated* if a gram with another occurrence covers it, and
a *duplicate* if such a gram that isn't the first occurrence covers it.

Words are compared in lower case, by 64-bit hashes in step 1 and 32-bit ones in
step 3. Defined results: null, empty and short texts have no spans; texts of any
length are read whole; texts of one repeated word have spans that overlap themselves;
an empty table gives no rows; extra columns don't matter; ``least`` is 250 at most,
which is checked.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .induced import MOST, Store, suffix_array

LEAST, CHOSEN, MINI = 50, 25, 12
#: Words of distinct windows that a shard should have, and those that its suffix sorting keeps in memory.
SHARD, IN_MEMORY = 1 << 21, 1 << 22
#: Words that a pass over a shard handles at once.
BLOCK = 1 << 18


def _winnow(least: int):
    k = least // 2
    w = least - k + 1

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                x = C.words(s.buf, s.offs)
                if len(x.start) < least:
                    continue
                g = C.gram_hashes(C.span_hashes(s.buf, x.start, x.end), k)
                at = C.sliding_argmin(g, w)
                ok = x.doc[: len(at)] == x.doc[least - 1 :]
                at = np.unique(at[ok])
                if len(at):
                    doc = x.doc[at]
                    keys = s.rows.column("_k").to_numpy()[doc]
                    yield pa.record_batch([pa.array(g[at].view(np.int64)), pa.array(keys), pa.array((at - x.first[doc]).astype(np.int32))], ["h", "_k", "at"])

    return run


def _again(batches):
    """From rows sorted by h, those whose h another row has."""
    held, given = None, False  # the last row so far, and whether it was passed on
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(3)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        h, k, at = rows
        same = h[1:] == h[:-1]
        good = np.r_[False, same] | np.r_[same, False]
        out = good.copy()
        out[0] &= not given
        if out.any():
            yield pa.record_batch([pa.array(k[out]), pa.array(at[out])], ["_k", "at"])
        held, given = [x[-1:] for x in rows], bool(good[-1])


def _merge(start: np.ndarray, end: np.ndarray, owner: np.ndarray):
    """Unions of intervals sorted by (owner, start); touching ones join."""
    if not len(start):
        return start, end, owner
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * big)
    new = np.flatnonzero(np.r_[True, (start + owner * big)[1:] > reach[:-1]])
    return start[new], np.maximum.reduceat(end, new), owner[new]


def _windows(least: int):
    """From lower-case text and its repeated grams ``at``: windows of word hashes, by minimizer."""
    k, mini_size = least // 2, min(MINI, least // 2)

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                x = C.words(s.buf, s.offs)
                if len(x.start) < least:
                    continue
                h = C.span_hashes(s.buf, x.start, x.end)
                chosen = C.sliding_argmin(C.gram_hashes(h, k), least - k + 1)
                lists = s.rows.column("ats")
                flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                hit = np.zeros(len(h), bool)
                hit[np.repeat(x.first[:-1], size) + flat] = True
                # a gram whose own chosen gram occurs once can't occur twice
                ok = hit[chosen] & (x.doc[: len(chosen)] == x.doc[least - 1 :])
                grams = np.flatnonzero(ok)
                if not len(grams):
                    continue
                symbols = (h >> np.uint64(32)).astype(np.uint32)
                hashes = C.gram_hashes(symbols.astype(np.uint64), mini_size)
                mini = hashes[C.sliding_argmin(hashes, least - mini_size + 1)[grams]]
                # neighbours of one minimizer and document travel together
                new = np.flatnonzero(np.r_[True, (mini[1:] != mini[:-1]) | (np.diff(grams) > 1) | (x.doc[grams[1:]] != x.doc[grams[:-1]])])
                start, end = grams[new], grams[np.r_[new[1:], len(grams)] - 1] + least
                size = end - start
                flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
                doc = x.doc[start]
                raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size * 4)].astype(np.int64)), pa.py_buffer(symbols[flat])])
                rows = s.rows.select(["_k", "doc_id"]).take(pa.array(doc))
                cols = [pa.array(mini[new].view(np.int64)), rows.column(0), rows.column(1), pa.array((start - x.first[doc]).astype(np.int32)), raw.cast(pa.binary())]
                yield pa.record_batch(cols, ["mini", "_k", "doc_id", "at", "words"])

    return run


class Windows:
    """The distinct windows of a shard: their words in a file, as they come, and a few numbers of each."""

    def __init__(self, folder: str | None):
        self.path = os.path.join(folder or tempfile.gettempdir(), f"windows-{uuid.uuid4().hex}")
        self.file, self.parts, self.sizes = open(self.path, "wb"), [], []

    def add(self, mini, none, doc_id, key, at, several, words: pa.Array) -> None:
        """``none, doc_id, key, at``: the least place of each; ``several``: whether there are more."""
        _, o, d = words.buffers()
        o = np.frombuffer(o, np.int32)[words.offset : words.offset + len(words) + 1]
        self.file.write(memoryview(d)[o[0] : o[-1]])
        self.parts.append((mini, none, doc_id, key, at, several))
        self.sizes.append(np.diff(o) // 4)

    def done(self):
        self.file.close()
        self.size = np.concatenate(self.sizes).astype(np.int64)
        return [np.concatenate(c) for c in zip(*self.parts)]

    def symbols(self) -> np.ndarray:
        return np.memmap(self.path, np.uint32, "r")

    def close(self) -> None:
        self.file.close()
        os.unlink(self.path)


def repeats(held: Windows, least: int, spill: str | None = None, in_memory: int = IN_MEMORY):
    """Blocks of ``window, start, end, lead``: the words of each distinct window that repeats cover.

    With ``lead``, grams whose first occurrence is at the window's least place; else, those that occur before it.
    """
    if least > MOST:
        raise ValueError(f"least may be {MOST} at most")
    mini, none, doc_id, key, at, several = held.done()
    size, m = held.size, len(held.size)
    n = int(size.sum())
    store = Store(spill, in_memory)
    try:
        flat = held.symbols() if store.external(n) else np.array(held.symbols())
        known = np.zeros(0, np.uint32)
        for lo in range(0, n, BLOCK):
            known = np.union1d(known, flat[lo : lo + BLOCK])
        # each window has an end of its own, in no order, as ends that rise through the text would be induced one by one;
        # where window w begins in the text, w ends lie before
        own_end = np.random.default_rng(m).permutation(m) + 1
        ends = np.cumsum(size + 1) - 1
        text, flags = store.empty(n + m + 1, np.int32), store.empty(n + m + 1, np.uint8)
        text[n + m] = flags[n + m] = 0
        first = ends - size
        for a, b in _shares(size, BLOCK):  # windows a to b - 1; flag 1: a gram that this window stands for
            lo, hi = int(first[a]), int(ends[b - 1]) + 1
            x = flat[lo - a : hi - b]
            row = np.repeat(np.arange(a, b), size[a:b])
            to = np.arange(len(x)) + (row - a)
            part, own = np.empty(hi - lo, np.int32), np.zeros(hi - lo, np.uint8)
            part[to] = np.searchsorted(known, x) + 1 + m
            part[ends[a:b] - lo] = own_end[a:b]
            if len(x) >= least:
                hashes = C.gram_hashes(x.astype(np.uint64), min(MINI, least // 2))
                least_of = hashes[C.sliding_argmin(hashes, least - min(MINI, least // 2) + 1)]
                inside = row[: len(least_of)] == row[least - 1 :]
                own[to[: len(least_of)][inside & (least_of == mini.view(np.uint64)[row[: len(least_of)]])]] = 1
            text[lo:hi], flags[lo:hi] = part, own
        del known, flat, own_end
        # windows by the order of their least places
        o = np.lexsort((key, doc_id, none))
        change = np.r_[False, (key[o][1:] != key[o][:-1]) | (doc_id[o][1:] != doc_id[o][:-1]) | (none[o][1:] != none[o][:-1])]
        rank = np.empty(m, np.int64)
        rank[o] = np.cumsum(change)
        del o, change
        found = suffix_array(text, least, spill, in_memory, store)
        _mark(found, flags, ends, first, rank, at, several, least)
        for a, b in _shares(size, BLOCK):
            lo, hi = int(first[a]), int(ends[b - 1]) + 1
            f = np.asarray(flags[lo:hi])
            for lead, bit in ((True, 2), (False, 4)):
                k = np.flatnonzero(f & bit) + lo
                if len(k):
                    w = np.searchsorted(ends, k)
                    start, end, own = _merge(k - first[w], k - first[w] + least, w)
                    yield own, start, end, np.full(len(own), lead)
    finally:
        store.close()


def _shares(size: np.ndarray, block: int):
    """Cuts windows into ranges of about ``block`` words."""
    total, a = np.r_[0, np.cumsum(size)], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + block, "right")) - 1)
        yield a, b
        a = b


def _mark(found, flags: np.ndarray, ends, first, rank, at, several, least: int) -> None:
    """Sets flag 2 at the first occurrence of each class of equal grams, and 4 at the others, walking the suffixes in order."""
    n = len(found.order)
    open_ = None  # the first occurrence so far of the class that the last block ended in: (rank, place, text position)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        where, same = np.asarray(found.order[lo:hi]).astype(np.int64), np.asarray(found.lcp[lo:hi]) >= least
        cls = np.cumsum(~same)  # 0: goes on from the block before
        mine = np.flatnonzero(flags[where] & 1)
        where, cls_ = where[mine], cls[mine]
        w = np.searchsorted(ends, where)
        r, place = rank[w], at[w] + where - first[w]
        o = np.lexsort((place, r, cls_))
        where, cls_, r, place, w = where[o], cls_[o], r[o], place[o], w[o]
        lead = np.r_[True, cls_[1:] != cls_[:-1]] if len(o) else np.zeros(0, bool)
        value = np.where(lead, 2, 4).astype(np.uint8)
        head = np.flatnonzero(lead)
        count = np.diff(np.r_[head, len(o)])
        alone = head[(count == 1) & ~several[w[head]]]
        value[alone] = 0
        if len(o) and cls_[0] == 0 and open_:  # the class of the block before goes on
            before = (r[0], place[0]) > open_[:2]
            flags[open_[2]] = flags[open_[2]] & 1 | (2 if before else 4)
            value[0] = 4 if before else 2
            open_ = open_ if before else (r[0], place[0], where[0])
        flags[where] = flags[where] & 1 | value
        if cls[-1] > 0:
            open_ = None
        if open_ is None and len(o) and cls_[-1] == cls[-1]:
            k = head[-1]
            open_ = (r[k], place[k], where[k])


def _local_folder() -> str | None:
    """The folder that Spark gave this executor for spills of its tasks, which it removes itself."""
    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
    return dirs[os.getpid() % len(dirs)] if dirs else None


_FOUND = {"wid": "binary", "lead": "boolean", "start": "int", "end": "int", "first_k": "long", "first_at": "int"}


def _sort_shards(least: int):
    def one(held: Windows, wids: list, folder: str | None):
        wid = pa.concat_arrays(wids)
        key, at = np.concatenate([p[3] for p in held.parts]), np.concatenate([p[4] for p in held.parts])
        for w, start, end, lead in repeats(held, least, folder):
            cols = [wid.take(pa.array(w)), pa.array(lead), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(key[w]), pa.array(at[w].astype(np.int32))]
            yield pa.record_batch(cols, [*_FOUND])

    def run(batches):  # sorted by shard
        # local files, which no other task reads; a folder of their own where Spark gives none
        own = None if _local_folder() else tempfile.mkdtemp(prefix="shard-")
        folder = _local_folder() or own
        held, wids, shard = None, [], None
        try:
            for batch in batches:
                s = batch.column("shard").to_numpy()
                for a, b in zip(c := np.flatnonzero(np.r_[len(s) > 0, s[1:] != s[:-1]]), np.r_[c[1:], len(s)]):
                    if s[a] != shard and held:
                        yield from one(held, wids, folder)
                        held.close()
                        held, wids = None, []
                    shard, part = s[a], batch.slice(a, b - a)
                    held = held or Windows(folder)
                    of = lambda name: part.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                    held.add(of("mini"), of("none"), part.column("doc_id").fill_null(0).to_numpy(), of("_k"), of("at").astype(np.int64), of("several"), part.column("words"))
                    wids.append(part.column("wid"))
            if held:
                yield from one(held, wids, folder)
        finally:
            if held:
                held.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return run


def _unite(batches):
    """From rows sorted by (_k, duplicate, start): unions of spans."""
    held = None
    for batch in batches:
        k, d, s, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        ids = batch.column("doc_id")
        if not len(k):
            continue
        own = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        start, end, owner = _merge(s.astype(np.int64), e.astype(np.int64), own)
        at = np.searchsorted(own, owner)
        t = pa.table([pa.array(k[at]), pa.array(d[at]), pa.array(start), pa.array(end), ids.take(pa.array(at))], ["_k", "duplicate", "start", "end", "doc_id"])
        rows = t.to_pylist() if held else None
        if held:
            first = rows[0]
            if (first["_k"], first["duplicate"]) == (held["_k"], held["duplicate"]) and first["start"] <= held["end"]:
                j = 0
                while j < len(rows) and (rows[j]["_k"], rows[j]["duplicate"]) == (held["_k"], held["duplicate"]) and rows[j]["start"] <= held["end"]:
                    held["end"] = max(held["end"], rows[j]["end"])
                    j += 1
                if j == len(rows):
                    continue
                t = t.slice(j)
            yield pa.RecordBatch.from_pylist([held], _SPAN)
        held = t.slice(t.num_rows - 1).to_pylist()[0]
        t = t.slice(0, t.num_rows - 1).cast(_SPAN)
        yield from t.to_batches()
    if held:
        yield pa.RecordBatch.from_pylist([held], _SPAN)


_SPAN = pa.schema([("_k", pa.int64()), ("duplicate", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("doc_id", pa.int64())])
_SPAN_DDL = "_k long, duplicate boolean, start int, end int, doc_id long"


def spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``_k, duplicate, start, end, doc_id``: disjoint word spans for each document and flag."""
    if not 2 <= least <= MOST:
        raise ValueError(f"least must be from 2 to {MOST}")
    spark = C.prepare(docs.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lower = C.keyed(docs).withColumn("text", F.lower("text"))
    chosen = lower.mapInArrow(_winnow(least), "h long, _k long, at int")
    hits = chosen.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_again, "_k long, at int")
    per_doc = hits.groupBy("_k").agg(F.collect_list("at").alias("ats"))
    made = lower.join(per_doc, "_k").mapInArrow(_windows(least), "mini long, _k long, doc_id long, at int, words binary")
    # a window is known by 128 bits of its words
    windows = C.materialize(made.withColumn("wid", F.unhex(F.md5("words"))))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "at")
    one = C.materialize(windows.groupBy("wid").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.first("mini").alias("mini"), F.first("words").alias("words")))
    words = one.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-words // (4 * SHARD)))
    sharded = one.select(F.pmod(F.xxhash64("mini"), F.lit(shards)).alias("shard"), "wid", "mini", "least.*", (~F.col("least").eqNullSafe(F.col("most"))).alias("several"), "words")
    found = sharded.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(least), ", ".join(f"`{c}` {t}" for c, t in _FOUND.items()))
    # back to all places of a window; its least one has the first occurrences
    at_first = F.col("lead") & (F.col("_k") == F.col("first_k")) & (F.col("at") == F.col("first_at"))
    placed = windows.select("wid", "_k", "doc_id", "at").join(found, "wid")
    flagged = placed.select("_k", (~at_first).alias("duplicate"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "doc_id")
    sorted_ = flagged.repartition(parts, "_k").sortWithinPartitions("_k", "duplicate", "start", "end")
    return sorted_.mapInArrow(_unite, _SPAN_DDL)


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, start_word, end_word, duplicate``: what repeats; end is exclusive.

    With ``duplicate`` false, words of first occurrences; with true, words that ``cut_repeats`` removes.
    """
    return spans(docs, least).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "duplicate")


def cut_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without duplicate words; documents of which no word is left go.

    The bytes from the first word of a span to the start of the word after it are
    cut (at the end of a text, all of the rest); their n_chars, where there, is set anew.
    Documents without duplicate words stay as they are, even without any word.
    """
    C.prepare(docs.sparkSession)
    found = C.materialize(spans(docs, least).where("duplicate").groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")))
    plain, restore = C.numbered_keyed(docs)
    at = f"c{docs.columns.index('text')}"
    chars = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for s in C.slices(batch, at):
                x = C.words(s.buf, s.offs)
                texts = s.rows.column(at).to_pylist()
                counts = s.rows.column(chars).to_pylist() if chars else None
                gone = np.zeros(len(texts), bool)
                for i, cuts in enumerate(s.rows.column("_spans").to_pylist()):
                    if not cuts:
                        continue
                    raw, f, n, done, keep = texts[i].encode(), x.first[i], x.first[i + 1] - x.first[i], 0, []
                    left = n - sum(c["end"] - c["start"] for c in cuts)
                    begin = x.start[f : f + n] - s.offs[i]
                    for c in cuts:
                        keep.append(raw[done : begin[c["start"]]])
                        done = begin[c["end"]] if c["end"] < n else len(raw)
                    keep.append(raw[done:])
                    texts[i], gone[i] = b"".join(keep).decode(), left == 0
                    if chars:
                        counts[i] = len(texts[i])
                rows = s.rows
                for name, new in ((at, texts), (chars, counts)):
                    if name:
                        j = rows.schema.get_field_index(name)
                        rows = rows.set_column(j, rows.schema.field(j), pa.array(new, rows.schema.field(j).type))
                yield rows.filter(pa.array(~gone))

    joined = plain.join(found, "_k", "left").drop("_id", "_text")
    return restore(joined.mapInArrow(run, joined.schema))
