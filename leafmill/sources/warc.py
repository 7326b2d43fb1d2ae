"""WARC files as a data source, and the transforms between records and documents.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(path)   # file, record_no, warc_headers, raw_header, payload
    records.write.format("warc").save(path)  # from a binary column record; option compress (default true)

A file is one partition, because gzip can't be split. Record headers have lower-case names.
"""

from __future__ import annotations

import gzip
import io
import urllib.request
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import html as H
from ..functions import text as T
from ..functions.vocabulary import DEFAULT, Vocabulary
from .files import exists, is_url, join, listed, move, names, open_input, open_output, remove

SUFFIXES = (".warc", ".warc.gz")
MARK = "WARC-Leaf-Version"
ENCODED_TYPE = "application/x-leaf-html"
#: Bytes of payloads that make a batch.
BATCH = 4 << 20
_SCHEMA = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("warc_headers", pa.map_(pa.string(), pa.string())), ("raw_header", pa.binary()), ("payload", pa.binary())])


def _open(path: str):
    raw = urllib.request.urlopen(path) if is_url(path) else open_input(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if path.endswith(".gz") else raw


def records(handle):
    """Yields raw header, headers and payload of each record; a bad length counts as 0."""
    while line := handle.readline():
        if not line.startswith(b"WARC/1."):
            continue
        raw, headers = [line], {}
        while (line := handle.readline()) and line.strip(b"\r\n"):
            raw.append(line)
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        try:
            n = max(0, int(headers.get("content-length", "0")))
        except ValueError:
            n = 0
        payload = handle.read(n)
        handle.read(4)
        yield b"".join(raw), headers, payload


@dataclass
class _File(InputPartition):
    path: str

    def __post_init__(self):
        super().__init__(self.path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in listed(self.path, SUFFIXES)] or [_File("")]

    def read(self, part: _File):
        if not part.path:
            return
        held, size = [], 0
        with _open(part.path) as f:
            for i, (raw, headers, payload) in enumerate(records(f)):
                held.append((part.path, i, list(headers.items()), raw, payload))
                size += len(raw) + len(payload)
                if size >= BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    count: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite):
        self.folder, self.overwrite = options["path"], overwrite
        self.aside = join(self.folder, "_temporary")
        self.packed = options.get("compress", "true").lower() == "true"
        self.column = schema.fieldNames().index("record")

    def write(self, batches):
        from pyspark import TaskContext

        name, count = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", 0
        with open_output(join(self.aside, name)) as f:
            for batch in batches:
                for data in batch.column(self.column).drop_null().to_pylist():
                    f.write(gzip.compress(data, mtime=0) if self.packed else data)
                    count += 1
        return _Written(name, count)

    def commit(self, messages):
        if self.overwrite:
            for n in names(self.folder):
                if n.endswith(SUFFIXES):
                    remove(join(self.folder, n))
        for m in messages:
            source = join(self.aside, m.name)
            move(source, join(self.folder, m.name)) if m.count else remove(source)

    def abort(self, messages):
        for m in messages:
            if m and exists(p := join(self.aside, m.name)):
                remove(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return "file string, record_no bigint, warc_headers map<string,string>, raw_header binary, payload binary"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def write_warc(records: DataFrame, path: str, compress: bool = True, mode: str = "overwrite") -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.select("record").write.format("warc").mode(mode).option("compress", str(compress).lower()).save(path)


# HTTP responses within payloads


def split_response(payload) -> Column:
    """``status, headers, body``: up to the first empty line; without one all is body. Of equal names the last counts."""
    p = F.col(payload) if isinstance(payload, str) else payload
    text = F.decode(p, "ISO-8859-1")  # a character a byte
    crlf, lf = F.instr(text, "\r\n\r\n"), F.instr(text, F.lit("\n\n"))
    at = F.when(crlf > 0, crlf).when(lf > 0, lf).otherwise(0)
    gap = F.when(crlf > 0, 4).otherwise(2)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")
    lines = F.split(head, "\r?\n")
    pairs = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda line: F.instr(line, ":") > 0), T.header_pair)
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["name"])), lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda x: x["name"] == n), -1)["value"])))
    body = F.when(at > 0, F.substring(p, at + gap, F.octet_length(p))).otherwise(p)
    return F.struct(F.when(at > 0, lines[0]).alias("status"), F.when(at > 0, last).otherwise(F.create_map().cast("map<string,string>")).alias("headers"), body.alias("body"))


def says_html(content_type) -> Column:
    """Whether a type is given and says text/html, in lower case; what the crawl benchmarks count."""
    return F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html"))


def is_html_response(warc_type, content_type, body) -> Column:
    """A response with a body that says text/html, or says nothing and, blanks aside, begins with ``<!`` or ``<h`` in either case."""
    nothing = F.coalesce(content_type, F.lit("")) == ""
    sniffed = F.when(nothing, F.decode(body, "ISO-8859-1").rlike(r"\A[ \t\n\r\f\x0B]*<[!hH]")).otherwise(F.lit(False))
    return F.coalesce((F.lower(warc_type) == "response") & (F.octet_length(body) > 0) & (says_html(content_type) | sniffed), F.lit(False))


def record_flags(warc: DataFrame) -> DataFrame:
    """Records with ``is_response``, ``is_html`` (its type says HTML or encoded HTML) and ``is_encoded`` (it has the mark)."""
    r = warc.withColumn("_type", F.coalesce(split_response("payload")["headers"]["content-type"], F.lit("")))
    response = F.coalesce(F.lower(F.col("warc_headers")["warc-type"]) == "response", F.lit(False))
    html = response & (F.octet_length("payload") > 0) & (says_html(F.col("_type")) | F.contains("_type", F.lit(ENCODED_TYPE)))
    return r.withColumns({"is_response": response, "is_html": html, "is_encoded": F.col("warc_headers")[MARK.lower()].isNotNull()}).drop("_type")


def html_responses(warc: DataFrame) -> DataFrame:
    """``file, record_no, url, body`` of the HTML responses among records."""
    r = warc.withColumn("_http", split_response("payload"))
    good = is_html_response(F.col("warc_headers")["warc-type"], F.col("_http.headers")["content-type"], F.col("_http.body"))
    return r.where(good).select("file", "record_no", F.coalesce(F.col("warc_headers")["warc-target-uri"], F.lit("")).alias("url"), F.col("_http.body").alias("body"))


def build_record(url, html, date, number) -> Column:
    """A response record of a page, as bytes; ``number`` goes into its id."""
    body = F.encode(html, "UTF-8")
    http = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "UTF-8"), body)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Record-ID: <urn:uuid:leaf-"),
        F.lpad(number.cast("string"), 8, "0"), F.lit(">\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), http, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def documents_to_records(docs: DataFrame, date: str) -> DataFrame:
    """``doc_idx, record`` of documents ``doc_idx, html``, under made-up addresses."""
    url = F.concat(F.lit("<urn:leaf:"), F.col("doc_idx").cast("string"), F.lit(">"))
    return docs.select("doc_idx", build_record(url, F.col("html"), F.lit(date), F.col("doc_idx")).alias("record"))


def rebuild_record(raw_header, status, body, encoded: bool) -> Column:
    """A record with a new body: record headers stay but for length and mark, of the response the status line."""
    kind = ENCODED_TYPE if encoded else "text/html; charset=utf-8"
    http = F.concat(F.encode(F.concat(status, F.lit(f"\r\nContent-Type: {kind}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "ISO-8859-1"), body)
    lines = F.filter(F.split(F.decode(raw_header, "ISO-8859-1"), "\r?\n"), lambda x: (x != "") & ~F.lower(x).startswith("content-length:") & ~F.lower(x).startswith(MARK.lower() + ":"))
    mark = f"{MARK}: 2\r\n" if encoded else ""
    head = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n" + mark + "Content-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "ISO-8859-1"), http, F.encode(F.lit("\r\n\r\n"), "ISO-8859-1"))


def _through(warc: DataFrame) -> Column:
    return F.concat(F.col("raw_header"), F.encode(F.lit("\r\n"), "UTF-8"), F.col("payload"), F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def encode_records(warc: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """``file, record_no, record, done``: HTML bodies encoded; other records, and what can't be encoded, pass through."""
    r = record_flags(warc).withColumn("_http", split_response("payload"))
    wanted = F.col("is_html") & ~F.col("is_encoded") & (F.octet_length("_http.body") > 0)
    r = r.withColumn("_new", H.encode_html(F.when(wanted, F.col("_http.body")), vocabulary))
    done = F.col("_new").isNotNull()
    return r.select("file", "record_no", F.when(done, rebuild_record(F.col("raw_header"), F.col("_http.status"), F.col("_new"), True)).otherwise(_through(r)).alias("record"), done.alias("done"))


def decode_records(warc: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """``file, record_no, record, done``: marked responses decoded, others as they are."""
    r = warc.withColumn("_http", split_response("payload"))
    marked = (F.lower(F.col("warc_headers")["warc-type"]) == "response") & F.col("warc_headers")[MARK.lower()].isNotNull()
    r = r.withColumn("_new", F.encode(H.decode_html(F.when(marked, F.col("_http.body")), vocabulary), "UTF-8"))
    done = F.col("_new").isNotNull()
    return r.select("file", "record_no", F.when(done, rebuild_record(F.col("raw_header"), F.col("_http.status"), F.col("_new"), False)).otherwise(_through(r)).alias("record"), done.alias("done"))


def record_counts(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if("done").alias("changed"), F.count_if(~F.col("done")).alias("passed_through"))
