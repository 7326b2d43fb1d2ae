"""Packing: first-fit decreasing with a tournament tree of bin capacities.

Documents fall at random (a seeded hash of the row and its place) into groups of
about ``GROUP``, equal rows like any others; the groups are independent, so they are
packed in parallel and a group's size doesn't grow with the corpus. In a group, documents go from the longest to the shortest
into the first bin with room. The tree holds the largest room below each node,
so a bin is found in as many steps as the tree has levels.

A document longer than a bin is cut into pieces of a whole bin each, in bins of
their own, and a rest that is packed like the others.

Defined results: null and empty texts have 0 tokens and go into the first bin;
texts of any length are counted whole; ties go by (doc_id, hash of the text), null
ids last; equal rows are packed each for itself, in groups of their own luck; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import counts as T
from . import pieces as P

#: Tokens in a bin; documents in a group on average; seed of the groups.
CAPACITY, GROUP, SEED = 8192, 4096, 20240607


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given; no size is above ``capacity``."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - room[at])
        room[at] -= n
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def _pack_group(ids: pa.Array, size: np.ndarray, group: int, capacity: int) -> pa.RecordBatch:
    whole, rest = size // capacity, size % capacity
    whole = np.where((rest == 0) & (whole > 0), whole - 1, whole)
    rest = size - whole * capacity
    order = np.argsort(-rest, kind="stable")  # rows come sorted, so ties keep their order
    bins, offsets = first_fit(rest[order].tolist(), capacity)
    used = max(bins, default=-1) + 1
    full = np.repeat(np.arange(len(size)), whole)
    piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    row = np.r_[order, full]
    return pa.record_batch([
        pa.array(np.full(len(row), group)), pa.array(np.r_[np.array(bins, np.int64), used + np.arange(len(full))]), pa.array(np.r_[np.array(offsets, np.int64), np.zeros(len(full), np.int64)]),
        ids.take(pa.array(row)), pa.array(np.r_[whole[order] * capacity, piece * capacity]), pa.array(np.r_[rest[order], np.full(len(full), capacity)]),
    ], ["group_id", "bin", "bin_offset", "doc_id", "doc_offset", "n_tokens"])


def _grouped(capacity: int):
    def run(batches):  # sorted by group
        held: list[pa.RecordBatch] = []

        def out():
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc_id"].combine_chunks() if rows["doc_id"].num_chunks != 1 else rows["doc_id"].chunk(0)
            return _pack_group(ids, rows["size"].to_numpy(), rows["group_id"][0].as_py(), capacity)

        for batch in batches:
            g = batch.column("group_id").to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
                if a == b:
                    continue
                if held and held[-1].column("group_id")[0].as_py() != g[a]:
                    yield out()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, path: str = P.MODEL, seed: int = SEED) -> DataFrame:
    """``group_id, bin, bin_offset, doc_id, doc_offset, n_tokens``: where each document, or piece of one, lies."""
    spark = C.prepare(docs.sparkSession)
    count = T.counter(*T.vocabulary(path))

    def sizes(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for s in C.slices(batch):
                no = pa.array(np.arange(at, at + s.rows.num_rows))
                at += s.rows.num_rows
                yield pa.record_batch([s.rows.column("_k"), s.rows.column("doc_id"), no, pa.array(count(T.slice_texts(s)))], ["_k", "doc_id", "no", "size"])

    # written before it is shuffled, so that a row keeps its place, and with it its group, when tasks run again
    measured = C.materialize(C.keyed(docs).mapInArrow(sizes, "_k long, doc_id long, no long, size long"))
    groups = max(1, -(-measured.count() // group))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    of_group = measured.withColumn("group_id", F.pmod(F.xxhash64("_k", "no", F.lit(seed)), F.lit(groups))).drop("no")
    order = (F.col("group_id"), F.col("doc_id").asc_nulls_last(), F.col("_k"))
    return (
        of_group.repartition(min(parts, groups), "group_id").sortWithinPartitions(*order)
        .mapInArrow(_grouped(capacity), "group_id long, bin long, bin_offset long, doc_id long, doc_offset long, n_tokens long")
    )
