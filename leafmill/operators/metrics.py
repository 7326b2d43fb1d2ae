"""Sizes, baselines, fidelity and summaries."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.vocabulary import DEFAULT, Vocabulary


#: Bytes of records that are packed as one block, and how.
BLOCK = 4 << 20
_PACKING = ("zstd", 9)


def _packed(docs: DataFrame, column: str, order: str) -> DataFrame:
    """``part, seq, size, data``: the rows joined in order within ranges, in compressed blocks; null counts as nothing."""
    limit = BLOCK

    def pack(batches):
        codec, held, size, seq = pa.Codec(*_PACKING), [], 0, 0

        def block():
            data = b"".join(held)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([codec.compress(data, asbytes=True)], pa.binary())], ["part", "seq", "size", "data"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
            for v in batch.column(0):
                if v.is_valid:
                    held.append(v.as_buffer().to_pybytes())
                    size += len(held[-1])
                    if size >= limit:
                        yield block()
                        held, size, seq = [], 0, seq + 1
        if size:
            yield block()

    ranged = docs.select(column, order).repartitionByRange(order).sortWithinPartitions(order)
    return ranged.select(column, F.spark_partition_id().alias("_part")).mapInArrow(pack, "part int, seq bigint, size bigint, data binary")


def solid_size(docs: DataFrame, column: str, order: str, level: int = 9) -> DataFrame:
    """One row ``solid_bytes``: one gzip stream over all rows in order, which one task must make.

    Rows are sorted in ranges and reach that task as compressed blocks.
    """

    def run(batches):
        c, codec = zlib.compressobj(level, zlib.DEFLATED, 31), pa.Codec(*_PACKING)
        total = 0
        for batch in batches:
            for size, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += len(c.compress(codec.decompress(data.as_buffer(), size)))
        yield pa.record_batch([pa.array([total + len(c.flush())], pa.int64())], ["solid_bytes"])

    blocks = _packed(docs, column, order).repartition(1).sortWithinPartitions("part", "seq")
    return blocks.select("size", "data").mapInArrow(run, "solid_bytes bigint")


def writer_stats(docs: DataFrame, html: str = "html", encoded: str = "encoded") -> DataFrame:
    """One row: documents, bytes of HTML, bytes encoded."""
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum(F.octet_length(encoded)), F.lit(0)).alias("encoded_bytes"))


def compression_report(pages: DataFrame, html: str = "html", vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row of totals over all pages: raw, gzip for each page, encoded, encoded and zstd for each page."""
    sized = pages.select(F.octet_length(html).cast("long").alias("raw"), H.gzip_size(F.col(html)).alias("gz"), H.encode_html(F.col(html), vocabulary).alias("e"))
    sized = sized.select("raw", "gz", F.octet_length("e").cast("long").alias("enc"), F.octet_length(H.zstd_compress(F.col("e"))).cast("long").alias("zs"))
    return sized.agg(F.count("*").alias("docs"), *(F.sum(a).alias(b) for a, b in (("raw", "raw_bytes"), ("gz", "gzip_bytes"), ("enc", "encoded_bytes"), ("zs", "zstd_bytes"))))


def baseline_report(pages: DataFrame, html: str = "html", dictionary: bytes | None = None) -> DataFrame:
    """One row: bytes of all pages by zlib, gzip and zstd, each page for itself, and with a dictionary where there is one."""
    ways = {"zlib_bytes": H.zlib_compress(F.col("b")), "zstd_bytes": H.zstd_compress(F.col("b"))}
    if dictionary:
        ways["zstd_dictionary_bytes"] = H.zstd_compress(F.col("b"), 19, dictionary)
    sized = pages.select(F.encode(html, "UTF-8").alias("b")).select(F.octet_length("b").cast("long").alias("raw_bytes"), H.gzip_size(F.col("b")).alias("gzip_bytes"), *(F.octet_length(c).cast("long").alias(n) for n, c in ways.items()))
    return sized.agg(F.count("*").alias("docs"), *(F.sum(n).alias(n) for n in sized.columns))


def observed_encoding(pages: DataFrame, html: str = "html", name: str = "encoding") -> tuple[DataFrame, Observation]:
    """``pages`` with ``encoded``; the observation tells pages, encoded ones and failures once an action has run."""
    seen, e = Observation(name), F.col("encoded")
    out = pages.withColumn("encoded", H.encode_html(html))
    return out.observe(seen, F.count("*").alias("pages"), F.count(e).alias("encoded"), F.count_if(e.isNull() & F.col(html).isNotNull()).alias("failed")), seen


def gzip_member_size(data: bytes, level: int = 9) -> int:
    return len(gzip.compress(data, level, mtime=0))


def train_dictionary(encoded: DataFrame, column: str = "encoded", size: int = 112 << 10, samples: int = 2000, seed: int = 7) -> bytes:
    """A zstd dictionary from a bounded sample of encoded documents, chosen by a seeded hash."""
    import zstandard

    rows = encoded.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column, F.lit(seed))).limit(samples)
    return zstandard.train_dictionary(size, [bytes(r[0]) for r in rows.collect()]).as_bytes()  # at most ``samples`` rows


def segment_summary(segments: DataFrame, ours: str = "archive_bytes", theirs: str = "baseline_bytes", ok: str = "ok") -> DataFrame:
    """One row: totals, least and largest saving, root mean square about the pooled saving, whether all went well."""
    s = segments.withColumn("_saving", 1 - F.col(ours) / F.col(theirs))
    pooled = s.agg((1 - F.sum(ours) / F.sum(theirs)).alias("_pooled"))
    return s.crossJoin(F.broadcast(pooled)).agg(
        F.count("*").alias("segments"), F.sum(ours).alias("archive_bytes"), F.sum(theirs).alias("baseline_bytes"), F.first("_pooled").alias("pooled_saving"),
        F.min("_saving").alias("least_saving"), F.max("_saving").alias("largest_saving"), F.sqrt(F.avg(F.pow(F.col("_saving") - F.col("_pooled"), 2))).alias("deviation"), F.every(ok).alias("all_ok"),
    )


def scenario_summary(scenarios: DataFrame) -> DataFrame:
    """One row over ``archive_bytes, baseline_bytes``: totals and how often the archive is smaller."""
    return scenarios.agg(F.count("*").alias("scenarios"), F.sum("archive_bytes").alias("archive_bytes"), F.sum("baseline_bytes").alias("baseline_bytes"), F.count_if(F.col("archive_bytes") < F.col("baseline_bytes")).alias("wins"))



def roundtrip(pages: DataFrame, key: str, html: str = "html", vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """``key, tags_equal, words_equal``: the page and what comes back have the same tags and the same words in order."""
    back = pages.select(key, html, H.decode_html(H.encode_html(F.col(html), vocabulary), vocabulary).alias("back"))
    sides = []
    for name in (html, "back"):
        nodes = H.html_nodes(back, key, html=name)
        words = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin(3, 7), F.struct("seq", "payload")))), lambda x: x["payload"]))
        tags = F.array_sort(F.collect_list(F.when(F.col("op").isin(1, 6), F.struct("seq", "tag"))))
        clean = F.trim(F.regexp_replace(words, r"(?U)\s+", " "))
        sides.append(nodes.groupBy(key).agg(F.transform(tags, lambda x: x["tag"]).alias(f"tags_{name}"), clean.alias(f"words_{name}")))
    a, b = sides
    return a.join(b, key, "full").select(key, F.coalesce(F.col(f"tags_{html}") == F.col("tags_back"), F.lit(False)).alias("tags_equal"), F.coalesce(F.col(f"words_{html}") == F.col("words_back"), F.lit(False)).alias("words_equal"))


def sample_fidelity(originals: DataFrame, decoded: DataFrame, key: str = "doc_idx", html: str = "html", samples: int = 5, seed: int = 7) -> DataFrame:
    """One row: counts equal, and ``samples`` random documents come back with half their length or more."""
    counts = originals.agg(F.count("*").alias("a")).crossJoin(decoded.agg(F.count("*").alias("b")))
    picked = originals.select(key, F.octet_length(html).alias("n")).orderBy(F.xxhash64(key, F.lit(seed))).limit(samples)
    long = picked.join(decoded.select(key, F.octet_length(html).alias("m")), key, "left").agg(F.coalesce(F.every(F.coalesce("m", F.lit(0)) >= 0.5 * F.col("n")), F.lit(True)).alias("lengths_ok"))
    return counts.crossJoin(long).select((F.col("a") == F.col("b")).alias("counts_equal"), "lengths_ok")
