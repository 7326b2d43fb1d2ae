"""Registered queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import catalog, chunks, merkle, metrics, select
from ..sources import archive, warc
from ..sources.folders import with_index
from . import oracles as S
from .shared import scratch, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DATE = "2026-01-01T00:00:00Z"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.html_nodes(_pages(spark, d), "page_id")


def _text_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text documents of an archive, numbered by doc_id."""
    return with_index(_documents(spark, d).select("doc_id", T.text_size("text").alias("encoded_bytes"), F.octet_length("text").cast("long").alias("raw_bytes")), "doc_id")


# text


@_query(S.PAGE_TEXT)
def page_text(spark, d):
    return _pages(spark, d).select("page_id", H.extract_text("html").alias("text"))


@_query(S.STRIP_TAGS)
def strip_tags(spark, d):
    return _pages(spark, d).select("page_id", T.strip_tags("html").alias("text"))


@_query(S.TIDY_TEXT)
def tidy_documents(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2(T.tidy("text"), 256).alias("text_sha256"))


@_query(S.CONVERSATION_TEXT)
def conversation_text(spark, d):
    """Short texts through the text mode of the codec and back."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", H.decode_text(T.encode_text("text")).alias("text"))


@_query(S.TEXT_ENCODED)
def text_encoded(spark, d):
    e = _documents(spark, d).select("doc_id", T.encode_text("text").alias("e"))
    return e.select("doc_id", F.octet_length("e").cast("long").alias("encoded_bytes"), F.sha2("e", 256).alias("encoded_sha256"))


@_query(S.TITLES_NORM)
def title_norm(spark, d):
    return _titles(spark, d).select("page_id", T.norm_title("name").alias("norm"))


# nodes


@_query(S.TAG_HISTOGRAM)
def tag_histogram(spark, d):
    return _nodes(spark, d).where("op in (1, 6)").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@_query(S.ATTR_HISTOGRAM)
def attr_histogram(spark, d):
    names = _nodes(spark, d).select("tag", F.explode("attrs.name").alias("name"))
    return names.groupBy("tag", "name").agg(F.count("*").alias("n"))


@_query(S.CLASS_TOKENS)
def class_tokens(spark, d):
    a = _nodes(spark, d).select(F.explode("attrs").alias("a")).where("a.name = 'class' and a.value is not null")
    return a.select(F.explode(F.filter(F.split("a.value", r"\s+"), lambda x: x != "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@_query(S.LINKS)
def link_extract(spark, d):
    a = _nodes(spark, d).where("tag = 'a' and op = 1").select("page_id", F.explode("attrs").alias("a")).where("a.name = 'href'")
    return a.groupBy("page_id", F.col("a.value").alias("href")).agg(F.count("*").alias("n"))


@_query(S.COMMENTS)
def comments(spark, d):
    return _nodes(spark, d).where("op = 5").groupBy("page_id", "payload").agg(F.count("*").alias("n"))


@_query(S.OPEN_CLOSE)
def node_counts(spark, d):
    n = _nodes(spark, d)
    return n.groupBy("page_id").agg(*(F.count_if(F.col("op") == k).alias(f"n_{name}") for k, name in ((1, "open"), (2, "close"), (4, "doctype"), (5, "comment"), (6, "selfclose"), (7, "raw"))))


@_query(S.NODE_DEPTH)
def node_depth(spark, d):
    """The depth of every opening node: what opened before it and hasn't closed, never below 0."""
    step = F.when(F.col("op") == 1, 1).when(F.col("op") == 2, -1).otherwise(0)
    up_to = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = _nodes(spark, d).withColumn("_sum", F.sum(step).over(up_to))
    n = n.withColumn("_low", F.least(F.min("_sum").over(up_to), F.lit(0)))
    return n.where("op in (1, 6)").groupBy("tag").agg(F.max(F.col("_sum") - F.col("_low")).cast("long").alias("deepest"), F.count("*").alias("n"))


@_query(S.VOCABULARY_HITS)
def vocabulary_hits(spark, d):
    tags = V.vocabulary_table(spark).where("kind = 'tag'").select(F.col("token").alias("tag"), "id")
    used = _nodes(spark, d).where("op in (1, 6)").groupBy("tag").agg(F.count("*").alias("n"))
    return used.join(tags, "tag", "left").select("tag", "n", F.col("id").isNotNull().alias("known"))


@_query(S.HTML_ROUNDTRIP)
def html_roundtrip(spark, d):
    return metrics.roundtrip(_pages(spark, d), "page_id")


@_query()
def encoded_html(spark, d):
    e = _pages(spark, d).select("page_id", F.octet_length("html").cast("long").alias("raw_bytes"), H.recode_html("html").alias("e"))
    return e.select("page_id", "raw_bytes", "e.encoded_bytes", F.sha2("e.decoded", 256).alias("decoded_sha256"))


@_query(S.DECODED_TEXT)
def decoded_text(spark, d):
    """Readable text straight from encoded pages."""
    return _pages(spark, d).select("page_id", H.decode_text(H.encode_html("html")).alias("text"))


# integrity


@_query(S.DOC_SHA256)
def doc_sha256(spark, d):
    return _pages(spark, d).select("page_id", merkle.doc_hash("html").alias("doc_sha256"))


@_query(S.MERKLE_LEAVES)
def merkle_leaves(spark, d):
    return _pages(spark, d).select("page_id", F.lower(F.hex(merkle.leaf_hash(merkle.doc_hash("html")))).alias("leaf"))


@_query(S.merkle_root("documents", "doc_id", "text"))
def merkle_root(spark, d):
    docs = with_index(_documents(spark, d).select("doc_id", merkle.doc_hash("text").alias("doc_sha256")), "doc_id", name="pos")
    return merkle.merkle_root(written(docs))


@_query(S.VERIFY_ROOT)
def merkle_verify(spark, d):
    """A commitment held against the documents it was made of, and against them with one changed."""
    pages = _pages(spark, d)
    first = pages.agg(F.min("page_id").alias("_first"))
    changed = pages.crossJoin(F.broadcast(first)).withColumn("html", F.when(F.col("page_id") == F.col("_first"), F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    hashed = lambda p: written(with_index(p.select("page_id", merkle.doc_hash("html").alias("doc_sha256")), "page_id", name="pos"))
    docs = hashed(pages)
    commitment = written(merkle.merkle_root(docs))
    cases = [merkle.verify_root(commitment, x).select(F.lit(name).alias("case"), "*") for name, x in (("intact", docs), ("tampered", hashed(changed)))]
    return cases[0].union(cases[1])


# chunks and archives


@_query(S.CHUNK_PLAN)
def chunk_plan(spark, d):
    return chunks.chunk_plan(_text_docs(spark, d)).select("doc_id", "doc_idx", "chunk_id")


@_query(S.CHUNK_PLAN_BYTES)
def chunk_plan_bytes(spark, d):
    """Chunks that close at 32 KiB or 64 documents, so that both rules fire."""
    return chunks.chunk_plan(_text_docs(spark, d), max_docs=64, max_bytes=1 << 15).select("doc_id", "doc_idx", "chunk_id")


@_query(S.CHUNK_INDEX)
def chunk_index(spark, d):
    return chunks.chunk_index(chunks.chunk_plan(_text_docs(spark, d)))


@_query(S.SHARD_CHUNKS)
def shard_chunks(spark, d):
    """A source is a shard."""
    docs = _documents(spark, d).select("doc_id", "source", T.text_size("text").alias("encoded_bytes"))
    return chunks.chunk_index(chunks.chunk_plan(docs, "doc_id", shard="source"), shard="source")


@_query(S.WRITER_STATS)
def writer_stats(spark, d):
    return metrics.writer_stats(_documents(spark, d).select("text", T.encode_text("text").alias("encoded")), "text")


@_query(S.ARCHIVE_TEXT)
def archive_roundtrip(spark, d):
    """All documents written to an archive as texts and read again."""
    docs = with_index(_documents(spark, d).select("doc_id", T.encode_text("text").alias("encoded")), "doc_id")
    path = scratch(spark)
    archive.write_archive(docs, path, level=3)
    return archive.read_archive(spark, path).select("doc_idx", F.sha2(H.decode_text("encoded"), 256).alias("text_sha256"))


@_query(S.ARCHIVE_GET)
def archive_get(spark, d):
    """One document by its index, from the one chunk that holds it."""
    docs = with_index(_documents(spark, d).select("doc_id", T.encode_text("text").alias("encoded")), "doc_id")
    path = scratch(spark)
    archive.write_archive(docs, path, level=3)
    return archive.read_archive(spark, path).where("doc_idx = 137").select("doc_idx", H.decode_text("encoded").alias("text"))


@_query(S.ARCHIVE_INFO)
def archive_info(spark, d):
    """Counts of an archive of pages, from the indexes of its files alone."""
    pages = _pages(spark, d).select("page_id", T.encode_text("html").alias("encoded"))
    path = scratch(spark)
    archive.write_single(pages, path, "page_id", level=3, maxBytes=1 << 40)
    i = archive.archive_info(spark, path)
    outside = F.col("file_bytes") - F.col("chunk_bytes")  # header, index and footer
    return i.select("docs", "chunks", "encoded_bytes", outside.alias("outside_bytes"), (F.col("chunk_bytes") < F.col("encoded_bytes")).alias("smaller"))


@_query(S.GET_BY_TITLE)
def get_by_title(spark, d):
    """Documents of an archive by their titles, in lower case and with a trailing mark."""
    pages = with_index(_pages(spark, d).select("page_id", T.encode_text("html").alias("encoded")), "page_id")
    path = scratch(spark)
    archive.write_archive(pages, path, level=3)
    titles = with_index(_titles(spark, d).select("page_id", "name", "shard"), "page_id", name="idx").withColumn("line_no", F.col("idx"))
    found = catalog.lookup_titles(titles, titles.select(F.concat(F.lower("name"), F.lit("; ")).alias("query")))
    docs = archive.read_archive(spark, path).select(F.col("doc_idx").alias("idx"), F.sha2(H.decode_text("encoded"), 256).alias("text_sha256"))
    return found.join(docs, "idx").select("query", "idx", "text_sha256")


@_query()
def compression_report(spark, d):
    return metrics.compression_report(_pages(spark, d))


@_query()
def solid_gzip(spark, d):
    number = F.col("page_id")
    records = _pages(spark, d).select("page_id", warc.build_record(F.col("url"), F.col("html"), F.lit(DATE), number).alias("record"))
    return metrics.solid_size(records, "record", "page_id")


@_query(S.SEGMENTS)
def segment_summary(spark, d):
    s = _documents(spark, d).groupBy("source").agg(F.sum(T.text_size("text")).alias("archive_bytes"), F.sum(F.octet_length("text") + 64).alias("baseline_bytes"), F.lit(True).alias("ok"))
    r = metrics.segment_summary(s)
    return r.select("segments", "archive_bytes", "baseline_bytes", *(F.round(c, 9).alias(c) for c in ("pooled_saving", "least_saving", "largest_saving", "deviation")), "all_ok")


@_query(S.SCENARIOS)
def scenario_summary(spark, d):
    s = _documents(spark, d).groupBy("lang").agg(F.sum(T.text_size("text")).alias("archive_bytes"), F.sum(F.col("n_chars") + 16).alias("baseline_bytes"))
    return metrics.scenario_summary(s)


# selection


@_query(S.LOCATE)
def locate_docs(spark, d):
    docs = _text_docs(spark, d)
    ranges = select.spans(chunks.chunk_index(chunks.chunk_plan(docs)), "chunk_id")
    return select.locate(docs.select("doc_id", "doc_idx"), ranges).select("doc_id", "doc_idx", "chunk_id", "within")


@_query(S.SLICE)
def slice_docs(spark, d):
    return select.slice_docs(_text_docs(spark, d), -100, 20, -7).select("doc_idx", "doc_id")


@_query(S.RESOLVE)
def resolve_index(spark, d):
    """Every document's shard (its source) and place there, from a global index over the shards in name order."""
    docs = with_index(_documents(spark, d).select("source", "doc_id"), "source", "doc_id", name="idx")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    corpus = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: x["n"]).alias("shard_docs")).select(F.lit("all").alias("name"), "shard_docs")
    return catalog.resolve_indexes(docs.select(F.lit("all").alias("name"), "idx", "doc_id"), corpus).select("doc_id", "idx", "shard", "within")


def _titles(spark, d) -> DataFrame:
    t = _pages(spark, d).select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("name"))
    return t.select("page_id", F.col("page_id").alias("line_no"), "name", F.lit(0).alias("shard"), F.col("page_id").alias("idx"))


@_query(S.TITLE_INDEX)
def title_index(spark, d):
    return _titles(spark, d).select("page_id", "name")


@_query(S.TITLE_SEARCH)
def title_search(spark, d):
    return catalog.search_titles(_titles(spark, d), " THE;").select("line_no", "name", "shard", "idx")


@_query(S.TITLE_LOOKUP)
def title_lookup(spark, d):
    """Each title, in lower case and with a trailing mark, leads to the first page whose title matches."""
    t = _titles(spark, d)
    wanted = t.select(F.concat(F.lower("name"), F.lit("; ")).alias("query"))
    return catalog.lookup_titles(t, wanted).select("query", "match_class", "line_no")


# WARC


def _records(spark, d) -> DataFrame:
    return _pages(spark, d).select("page_id", warc.build_record(F.col("url"), F.col("html"), F.lit(DATE), F.col("page_id")).alias("record"))


@_query(S.WARC_RECORDS)
def warc_records(spark, d):
    return _records(spark, d).select("page_id", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


@_query(S.WARC_READ)
def warc_read(spark, d):
    """All pages written as gzip WARC, read again, and filtered for HTML responses."""
    path = scratch(spark)
    warc.write_warc(_records(spark, d), path)
    return warc.html_responses(warc.read_warc(spark, path)).select("url", F.sha2("body", 256).alias("body_sha256"))


@_query(S.WARC_RECODE)
def warc_encode_decode(spark, d):
    """HTML bodies encoded in place, then decoded; with a hash of the letters of each result's text."""
    path = scratch(spark)
    warc.write_warc(_records(spark, d), path)
    once, twice = scratch(spark), scratch(spark)
    warc.write_warc(warc.encode_records(warc.read_warc(spark, path)), once)
    warc.write_warc(warc.decode_records(warc.read_warc(spark, once)), twice)
    text = H.extract_text(F.decode("body", "UTF-8"))
    return warc.html_responses(warc.read_warc(spark, twice)).select("url", F.sha2(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", ""), 256).alias("letters_sha256"))


@_query(S.HTML_RESPONSES)
def html_response_filter(spark, d):
    """The three filters of HTML responses on payloads of eight kinds: types given, absent, empty, in capitals, other, and encoded; a request."""
    kind = (F.col("page_id") % 8).alias("kind")
    nl = "\r\n"
    head = F.element_at(F.array(*(F.lit(f"HTTP/1.1 200 OK{nl}{h}{nl}") for h in (
        f"Content-Type: text/html; charset=utf-8{nl}", f"X-A: 1{nl}", f"Content-Type: {nl}", f"X-A: 1{nl}", f"Content-Type: application/json{nl}", f"Content-Type: TEXT/HTML{nl}",
        f"Content-Type: {warc.ENCODED_TYPE}{nl}", f"Content-Type: text/html{nl}",
    ))), (F.col("kind") + 1).cast("int"))
    body = F.when(F.col("kind") == 3, F.concat(F.repeat(F.lit(" \n"), 300), F.upper("html"))).otherwise(F.col("html"))
    r = _pages(spark, d).select("page_id", "html", kind).withColumn("payload", F.encode(F.concat(head, body), "UTF-8"))
    warc_type = F.when(F.col("kind") == 7, "request").otherwise("response")
    flagged = warc.record_flags(r.withColumn("warc_headers", F.create_map(F.lit("warc-type"), warc_type)))
    http = warc.split_response("payload")
    stated = F.col("is_response") & warc.says_html(http["headers"]["content-type"])
    kept = warc.is_html_response(F.col("warc_headers")["warc-type"], http["headers"]["content-type"], http["body"])
    return flagged.select("page_id", "kind", kept.alias("kept"), stated.alias("stated"), F.col("is_html").alias("in_place"))


@_query(S.HEADERS)
def http_headers(spark, d):
    """Header maps of responses whose header lines repeat: the last counts."""
    payload = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type : text/plain\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\ncontent-type:  text/html; charset=utf-8 \r\n\r\n"), F.col("html")), "UTF-8")
    p = _pages(spark, d).select("page_id", warc.split_response(payload).alias("r"))
    return p.select("page_id", F.col("r.status").alias("status"), F.col("r.headers")["content-type"].alias("content_type"), F.col("r.headers")["x-page"].alias("x_page"), F.octet_length("r.body").cast("long").alias("body_bytes"))
