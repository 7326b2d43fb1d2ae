"""Documents that keep coming: streams of pages into archives, and session streams."""

from __future__ import annotations

import json
import struct
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions import html as H
from ..functions.vocabulary import DEFAULT, Vocabulary
from ..sources.archive import batches_of, register
from ..sources.files import read_all


def stream_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """New Parquet files of pages in a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def append_to_archive(pages: DataFrame, path: str, checkpoint: str, html: str = "html", order: str = "page_id", vocabulary: Vocabulary = DEFAULT, failed=None, **options):
    """Starts a query that appends the pages of each micro-batch to an archive as new shards.

    The archive's manifest keeps the number of the batch with its shards and is moved
    into place in one rename, so a batch that runs again after a failure isn't doubled.
    ``failed``, where given, is called with the batch's number and how many of its pages can't be encoded and are left out.
    """

    def append(batch: DataFrame, number: int) -> None:
        if number in batches_of(path) or batch.isEmpty():
            return
        register(batch.sparkSession)
        seen = Observation()
        encoded = batch.withColumn("encoded", H.encode_html(F.col(html), vocabulary))
        ranged = encoded.repartitionByRange(order).sortWithinPartitions(order)
        counted = ranged.observe(seen, F.count_if(F.col("encoded").isNull() & F.col(html).isNotNull()).alias("failed"))
        counted.where("encoded is not null").select("encoded").write.format("leaves").mode("append").options(**options, batch=number).save(path)
        if failed:
            failed(number, seen.get["failed"])

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def tag_counts(pages: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Opening tags in windows of event time; what is later than ``late`` is dropped."""
    nodes = H.html_nodes(pages.withWatermark(time, late), time).where("op in (1, 6)")
    return nodes.groupBy(F.window(time, window), "tag").count()


def frames(data: bytes) -> list[bytes]:
    """Documents of a reply: each after its length as u32."""
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("the reply breaks off")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _ask(address: str, key: str | None = None, post: bool = False, timeout: float = 30):
    """The reply's bytes and headers."""
    headers = {"X-Api-Key": key} if key else {}
    if post:
        headers["Content-Type"] = "application/json"
    request = urllib.request.Request(address, data=b"{}" if post else None, headers=headers, method="POST" if post else "GET")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read(), r.headers


def open_session(base: str, corpus: str, key: str | None = None) -> tuple[str, int]:
    """The id of a new session over a corpus, and how many documents that has."""
    said = json.loads(_ask(f"{base.rstrip('/')}/corpus/{corpus}/receipt/open", key, post=True)[0])
    return said["session_id"], int(said["total"])


def pull(base: str, corpus: str, session: str, offset: int, batch: int, key: str | None = None) -> tuple[list[bytes], int, bool]:
    """Documents from an offset of a session, the next offset, and whether that was all."""
    data, headers = _ask(f"{base.rstrip('/')}/corpus/{corpus}/receipt/pull?session={session}&offset={offset}&n={batch}", key, timeout=120)
    return frames(data), int(headers.get("X-Next-Offset", offset + batch)), headers.get("X-Done") == "1"


def finalize(base: str, corpus: str, session: str, key: str | None = None) -> dict:
    """Ends a session: the server's commitment to exactly the documents that it gave."""
    return json.loads(_ask(f"{base.rstrip('/')}/corpus/{corpus}/receipt/finalize?session={session}", key, post=True)[0])


def session_documents(base: str, corpus: str, key: str | None = None, limit: int = 0, batch: int = 256):
    """Yields the documents of a new session, all or the first ``limit``, and last ``("commitment", what the server commits to)``."""
    session, total = open_session(base, corpus, key)
    n, at = min(total, limit) if limit else total, 0
    while at < n:
        docs, after, over = pull(base, corpus, session, at, min(batch, n - at), key)
        yield from docs
        if after <= at and not over:
            raise OSError("the session doesn't go on")
        at = after
        if over:
            break
    yield "commitment", finalize(base, corpus, session, key)


def fetch_commitment(base: str, corpus: str | None = None) -> tuple[dict, bytes | None]:
    """The published commitment of a corpus (``base`` alone is its folder), and its time proof where there is one."""
    folder = base.rstrip("/") + (f"/corpus/{corpus}" if corpus else "")
    commitment = json.loads(read_all(f"{folder}/commitment.json"))
    try:
        return commitment, read_all(f"{folder}/commitment.ots")
    except (FileNotFoundError, urllib.error.HTTPError):
        return commitment, None


class _SessionReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.o = options

    def initialOffset(self):
        return {"offset": 0}

    def read(self, start):
        at = start["offset"]
        left = int(self.o["total"]) - at if "total" in self.o else None
        if left is not None and left <= 0:
            return iter(()), start
        docs, _, _ = pull(self.o["base"], self.o["corpus"], self.o["session"], at, min(int(self.o.get("batch", 256)), left or 1 << 31), self.o.get("key"))
        return iter([(at + i, d) for i, d in enumerate(docs)]), {"offset": at + len(docs)}

    def readBetweenOffsets(self, start, end):
        at = start["offset"]
        while at < end["offset"]:
            docs, _, _ = pull(self.o["base"], self.o["corpus"], self.o["session"], at, min(int(self.o.get("batch", 256)), end["offset"] - at), self.o.get("key"))
            yield from ((at + i, d) for i, d in enumerate(docs))
            if not docs:
                raise OSError("the session doesn't go on")
            at += len(docs)


class SessionSource(DataSource):
    """``spark.readStream.format("leaf-session")`` with options base, corpus, session (see ``open_session``), batch, key and total."""

    @classmethod
    def name(cls):
        return "leaf-session"

    def schema(self):
        return "doc_idx bigint, encoded binary"

    def simpleStreamReader(self, schema):
        return _SessionReader(dict(self.options))
