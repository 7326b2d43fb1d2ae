"""Greedy chunks of ordered documents, and where they lie in a file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written

MAX_DOCS, MAX_BYTES = 256, 2 << 20
#: Documents that are folded as one, and blocks whose summaries are composed as one.
BLOCK, GROUP = 1 << 16, 1 << 10
HEADER_BYTES, CHUNK_BYTES, SIZE_BYTES = 9, 10, 4


def _greedy(max_docs: int, max_bytes: int):
    def run(batches):  # sorted by (shard, order); a shard is within one partition
        shard, chunk, docs, total = None, 0, 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, (s, n) in enumerate(zip(batch.column("_shard").to_pylist(), batch.column("_bytes").to_pylist())):
                if s != shard:
                    shard, chunk, docs, total = s, 0, 0, 0
                out[i] = chunk
                docs, total = docs + 1, total + (n or 0)
                if docs >= max_docs or total >= max_bytes:
                    chunk, docs, total = chunk + 1, 0, 0
            yield batch.append_column("chunk_id", pa.array(out))

    return run


def chunk_plan(docs: DataFrame, order: str = "doc_idx", size: str = "encoded_bytes", shard: str | None = None, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``docs`` with ``chunk_id``: a chunk closes at ``max_docs`` documents or ``max_bytes`` bytes.

    With a shard column, chunks are counted within each shard, and a shard is the
    unit of parallel work. Without one, ``order`` must count 0, 1, 2, ..., and blocks
    of it are folded in parallel: where a chunk may start among the first
    ``max_docs`` documents of a block decides where one starts in the next, so a
    block is summed up by ``max_docs`` numbers; the summaries of ``group`` blocks are
    composed into one, these are chained, and each group is then unrolled for itself.
    """
    if shard is None:
        return _blocked_plan(docs, order, size, max_docs, max_bytes, max(block, max_docs), group)
    ready = docs.withColumns({"_shard": F.col(shard).cast("string"), "_bytes": F.col(size).cast("long")})
    ready = ready.repartition(F.col("_shard")).sortWithinPartitions("_shard", order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema) + ", chunk_id bigint"
    return ready.mapInArrow(_greedy(max_docs, max_bytes), kinds).drop("_shard", "_bytes")


def _ends(sizes: np.ndarray, max_docs: int, max_bytes: int) -> np.ndarray:
    """For each document where the chunk after one that starts there begins."""
    total = np.r_[0, np.cumsum(sizes)]
    by_bytes = np.searchsorted(total, total[:-1] + max_bytes, "left")
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(by_bytes, at + 1), at + max_docs)


def _by_block(f):
    """Calls ``f`` with the columns of each block; rows come sorted by (_block, position)."""

    def run(batches):
        held: list = []
        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(b)]):
                if lo == hi:
                    continue
                if held and held[-1].column(0)[0].as_py() != b[lo]:
                    yield f(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield f(pa.Table.from_batches(held))

    return run


def _blocked_plan(docs: DataFrame, order: str, size: str, max_docs: int, max_bytes: int, block: int, group: int) -> DataFrame:
    at = F.col(order).cast("long")
    b = F.floor(at / block).cast("long")
    # the first documents of a block are also seen by the one before, whose last chunk may reach them
    blocks = F.when((b > 0) & (at - b * block < max_docs), F.array(b - 1, b)).otherwise(F.array(b))
    seen = docs.select(F.explode(blocks).alias("_block"), at.alias("_at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_bytes"))
    seen = seen.repartition(F.col("_block")).sortWithinPartitions("_block", "_at")

    def summary(t: pa.Table) -> pa.RecordBatch:
        no, n = t["_block"][0].as_py(), t.num_rows
        ends = _ends(t["_bytes"].to_numpy(), max_docs, max_bytes)
        inside = min(n, block)
        # backwards: where the first chunk start beyond the block is, and how many chunks come before it
        out, count = np.zeros(inside, np.int64), np.zeros(inside, np.int64)
        for i in range(inside - 1, -1, -1):
            e = ends[i]
            out[i], count[i] = (out[e], count[e] + 1) if e < inside else (e - inside, 1)
        k = min(max_docs, inside)
        return pa.record_batch([pa.array([no]), pa.array([out[:k].tolist()]), pa.array([count[:k].tolist()])], ["_block", "out", "count"])

    def compose(t: pa.Table) -> pa.RecordBatch:
        enter, total = np.arange(max_docs), np.zeros(max_docs, np.int64)
        for out, count in zip(t["out"], t["count"]):
            o, n = out.values.to_numpy(), count.values.to_numpy()
            inside, at = enter < len(o), np.minimum(enter, len(o) - 1)  # a last block may be shorter than the chunk that reaches it
            enter, total = np.where(inside, o[at], enter - len(o)), total + np.where(inside, n[at], 0)
        return pa.record_batch([t["_group"].combine_chunks()[:1], pa.array([enter.tolist()]), pa.array([total.tolist()])], ["_group", "out", "count"])

    def follow(rows, enter: int, chunk: int):
        for no, out, count in rows:
            yield no, enter, chunk
            if enter < len(out):
                enter, chunk = out[enter].as_py(), chunk + count[enter].as_py()
            else:
                enter -= len(out)

    def chain(batches):
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), *((v.values for v in batch.column(i)) for i in (1, 2))))
        found = list(follow(rows, 0, 0))  # a row for each group
        if found:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["_group", "_enter", "_chunk"])

    def unroll(t: pa.Table) -> pa.RecordBatch:
        rows = zip(t["_block"].to_pylist(), (v.values for v in t["out"]), (v.values for v in t["count"]))
        found = follow(rows, t["_enter"][0].as_py(), t["_chunk"][0].as_py())
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["_block", "_enter", "_chunk"])

    def assign(t: pa.Table) -> pa.RecordBatch:
        n, enter, chunk = t.num_rows, t["_enter"][0].as_py(), t["_chunk"][0].as_py()
        at, ends = t["_at"].to_numpy(), _ends(t["_bytes"].to_numpy(), max_docs, max_bytes)
        start = np.zeros(n + 1, np.int64)
        i = enter
        while i < n:
            start[i] = 1
            i = ends[i]
        ids = np.cumsum(start[:n]) + chunk - 1
        inside = at < (t["_block"][0].as_py() + 1) * block
        return pa.record_batch([pa.array(at[inside]), pa.array(ids[inside])], ["_at", "chunk_id"])

    sums = seen.mapInArrow(_by_block(summary), "_block bigint, out array<bigint>, count array<bigint>")
    sums = written(sums.select(F.floor(F.col("_block") / group).cast("long").alias("_group"), "_block", "out", "count"))
    by_group = lambda df: df.repartition(F.col("_group")).sortWithinPartitions("_group", "_block")
    groups = by_group(sums).mapInArrow(_by_block(compose), "_group bigint, out array<bigint>, count array<bigint>")
    heads = groups.repartition(1).sortWithinPartitions("_group").mapInArrow(chain, "_group bigint, _enter bigint, _chunk bigint")
    met = by_group(sums.join(heads, "_group").select("_group", "_block", "out", "count", "_enter", "_chunk"))
    chained = met.mapInArrow(_by_block(unroll), "_block bigint, _enter bigint, _chunk bigint")
    entered = seen.join(chained, "_block").select("_block", "_at", "_bytes", "_enter", "_chunk").repartition(F.col("_block")).sortWithinPartitions("_block", "_at")
    ids = entered.mapInArrow(_by_block(assign), "_at bigint, chunk_id bigint")
    return docs.withColumn("_at", at).join(ids, "_at").drop("_at")


def chunk_index(planned: DataFrame, size: str = "encoded_bytes", shard: str | None = None) -> DataFrame:
    """A row for each chunk: documents, bytes, and its offset were the blobs stored as they are."""
    by = [shard] if shard else []
    c = planned.groupBy(*by, "chunk_id").agg(F.count("*").alias("doc_count"), F.sum(size).cast("long").alias("encoded_bytes"))
    stored = F.lit(CHUNK_BYTES) + F.lit(SIZE_BYTES) * F.col("doc_count") + F.col("encoded_bytes")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("file_offset", (F.lit(HEADER_BYTES) + F.coalesce(F.sum(stored).over(before), F.lit(0))).cast("long"))
