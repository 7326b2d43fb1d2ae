"""Session helpers and vectorised text kernels shared by the operators.

Every kernel works on the UTF-8 bytes of a whole Arrow batch at once. A *word*
is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes; the number
of words of a text doesn't depend on its case.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows in an Arrow batch and bytes of text that a numpy kernel sees at once.
ARROW_ROWS, SLICE_BYTES = 2000, 2 << 20
_made: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests, one machine), a folder of this process
    stands in for it; it goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="leafmill-"))
            atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
        base = "file://" + _made[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, parts: int, *cols: str, unique: bool = True) -> DataFrame:
    """As ``materialize``, a row for each value of ``cols`` (all rows unless ``unique``), in ``parts`` buckets, so that a join on them doesn't shuffle the rows again."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df = df.repartition(parts, *cols)
    (df.dropDuplicates([*cols]) if unique else df).write.option("path", scratch(spark)).bucketBy(parts, *cols).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved here; the name isn't needed from now on, and the files of an outside table stay
    spark.sql(f"drop table {name}")
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``_k, doc_id, text``: the key stands for (doc_id, text); equal rows share it.

    Where rows would be lost if two keys met, ``second`` gives the other half of a key of 128 bits.
    """
    return docs.select(F.xxhash64("doc_id", "text").alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def second(doc_id, text):
    return F.xxhash64(F.lit(1), text, doc_id)


def numbered(docs: DataFrame):
    """``docs`` with its columns renamed c0, c1, ..., so that no name clashes with ours; and the way back."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), lambda df: df.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def numbered_keyed(docs: DataFrame):
    """As ``numbered``, with the key ``_k`` of ``keyed`` and the copies ``_id`` and ``_text``."""
    plain, restore = numbered(docs)
    i, t = docs.columns.index("doc_id"), docs.columns.index("text")
    return plain.withColumns({"_k": F.xxhash64(f"c{i}", f"c{t}"), "_id": F.col(f"c{i}").cast("long"), "_text": F.col(f"c{t}")}), restore


class Slice(NamedTuple):
    rows: pa.RecordBatch
    buf: np.ndarray
    offs: np.ndarray


def _flat(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and its row offsets."""
    col = _flat(col)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES):
    """Cuts a batch between rows into pieces of at most ``limit`` bytes of text."""
    buf, offs = text_bytes(batch.column(batch.schema.get_field_index(col)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Slice(batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_B = 0x9E3779B97F4A7C15 | 1
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    if len(_tables[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, b in enumerate((_B, pow(_B, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _tables[k] = np.cumprod(x, dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the buffer."""
    p, inv = powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=pre[1:])
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # for each row, and one past the last, the first of its words


def words(buf: np.ndarray, offs: np.ndarray) -> Words:
    m = WORD[buf]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    cut = offs[(offs > 0) & (offs < len(m))]
    before[cut] = False
    after[cut - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return Words(start, end, np.searchsorted(offs, start, "right") - 1, np.searchsorted(start, offs))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, for each start from 0 to len(h) - k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(h) + 1)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=pre[1:])
    return mix((pre[k:] - pre[:n]) * inv[:n])


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window [i, i + w) the index of its minimum, the rightmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        span += step
    return at[:n]


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def list_column(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type=kind))
