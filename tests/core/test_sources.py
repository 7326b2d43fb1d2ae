import gzip
import hashlib
import http.server
import json
import os
import random
import re
import struct
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill import cli
from leafmill.functions import codec
from leafmill.functions import html as H
from leafmill.operators import catalog, chunks, merkle, metrics, select
from leafmill.sources import archive, files, folders, warc
from leafmill.sources.files import Ranges
from leafmill.streaming import ingest

C = codec.Codec()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, C.encode(f"<html><title>T{i}</title><p>page {i} é</p></html>")) for i in range(600)]
    return spark.createDataFrame(rows, "doc_idx bigint, encoded binary").cache()


@pytest.fixture(scope="module")
def kept(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    archive.write_archive(docs, path, shards=2, level=3)
    return path


def test_archive_round_trip_in_order(spark, docs, kept):
    got = archive.read_archive(spark, kept).orderBy("doc_idx").collect()
    assert [(r.doc_idx, bytes(r.encoded)) for r in got] == [(r.doc_idx, bytes(r.encoded)) for r in docs.orderBy("doc_idx").collect()]
    index = archive.archive_chunks(spark, kept).collect()
    assert sum(r.doc_count for r in index) == 600 and max(r.doc_count for r in index) == 256
    row = archive.archive_info(spark, kept).first()
    assert (row.docs, row.chunks) == (600, len(index)) and row.encoded_bytes == sum(r.encoded_bytes for r in index)


@pytest.mark.parametrize("wanted", ["doc_idx = 299", "doc_idx in (0, 599)", "doc_idx >= 590 and doc_idx < 593", "doc_idx = 600"])
def test_filters_leave_chunks_unread(spark, kept, wanted):
    df = archive.read_archive(spark, kept).where(wanted)
    assert df.rdd.getNumPartitions() <= 2
    assert sorted(r.doc_idx for r in df.collect()) == sorted(r.id for r in spark.range(600).where(wanted.replace("doc_idx", "id")).collect())


@pytest.mark.parametrize("mounted,embed", [(True, False), (True, True), (False, False)])
def test_a_single_shard_is_made_by_several_tasks(spark, docs, tmp_path, monkeypatch, mounted, embed):
    """Byte for byte the file that one task writes, of runs that are a task each."""
    options = {"level": 3, "maxBytes": 1 << 40}
    if embed:
        (tmp_path / "d").write_bytes(b"<p>page </p>" * 50)
        options |= {"dictionaryPath": str(tmp_path / "d"), "embedDictionary": "true"}
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    archive.write_archive(docs, one, shards=1, **options)
    monkeypatch.setattr(archive, "is_local", lambda path: mounted)
    written, joined = [], archive.join_shards
    monkeypatch.setattr(archive, "join_shards", lambda s, source, *a: (written.extend(archive.manifest_of(source)), joined(s, source, *a)))
    with_null = docs.union(spark.createDataFrame([(10**6, None)], docs.schema))
    archive.write_single(with_null, many, "doc_idx", partition_bytes=1000, **options)
    assert [s["docs"] for s in written] == [256, 256, 88]
    data = []
    for path in (one, many):
        (shard,) = archive.shards_of(path)
        data.append(files.read_all(shard))
    assert data[0] == data[1] and sorted(os.listdir(many))[0] == archive.MANIFEST and len(os.listdir(many)) == 2
    assert archive.read_archive(spark, many).count() == 600
    archive.write_single(docs.where("doc_idx < 0"), many, "doc_idx")
    assert archive.read_archive(spark, many).count() == 0 and len(os.listdir(many)) == 2


def test_appending_shards(spark, docs, tmp_path):
    path = str(tmp_path / "a")
    archive.write_archive(docs.where("doc_idx < 10"), path, level=3, shards=1)
    archive.write_archive(docs.where("doc_idx >= 10 and doc_idx < 15"), path, level=3, shards=1, mode="append")
    assert archive.read_archive(spark, path).count() == 15
    archive.write_archive(docs.where("doc_idx < 3"), path, level=3, mode="overwrite")
    assert archive.read_archive(spark, path).count() == 3 and len([n for n in os.listdir(path) if n.endswith(archive.SUFFIX)]) <= 3


def test_chunks_close_at_bytes_or_documents(tmp_path):
    f = archive.ArchiveFile(str(tmp_path / "x"), codec="zlib", max_docs=4, max_bytes=10)
    for n in (3, 3, 3, 3, 11, 1, 9, 1):
        f.append(b"x" * n)
    f.close()
    assert [r[1:] for r in f.index] == [(4, 12), (1, 11), (2, 10), (1, 1)]
    with Ranges(str(tmp_path / "x")) as r:
        rows, *_ = archive.read_index(r)
        assert [len(d) for o, n, b in rows for d in archive.read_chunk(r, o, n, b, None)] == [3, 3, 3, 3, 11, 1, 9, 1]


def test_broken_archives(spark, tmp_path):
    f = archive.ArchiveFile(good := str(tmp_path / "good.leaves"), level=3)
    for i in range(5):
        f.append(b"document %d" % i)
    f.close()
    data = open(good, "rb").read()
    for name, bad, said in (
        ("magic", b"NOPE" + data[4:], "bad magic"), ("version", data[:4] + b"\x09" + data[5:], "version 9"), ("short", data[:-5], "index|breaks off"),
        ("index", data[:-16] + struct.pack(">QQ", 1, 3), "index"), ("tiny", b"LEAF", "breaks off"),
    ):
        path = str(tmp_path / f"{name}.leaves")
        open(path, "wb").write(bad)
        with Ranges(path) as r, pytest.raises(archive.ArchiveError, match=said):
            archive.read_index(r)
    torn = bytearray(data)
    torn[12] ^= 1  # the chunk's own count of bytes
    path = str(tmp_path / "torn.leaves")
    open(path, "wb").write(torn)
    with pytest.raises(Exception, match="differ"):
        archive.read_archive(spark, path).collect()
    assert archive.read_archive(spark, path, mode="PERMISSIVE").count() == 0


@pytest.mark.parametrize("embed", [False, True])
def test_dictionaries(spark, docs, tmp_path, embed):
    made = metrics.train_dictionary(docs, size=4096)
    where = str(tmp_path / "dict")
    open(where, "wb").write(made)
    path = str(tmp_path / "a")
    archive.write_archive(docs, path, shards=1, level=3, dictionaryPath=where, embedDictionary=str(embed).lower())
    if embed:
        assert archive.read_archive(spark, path).count() == 600
    else:
        with pytest.raises(Exception, match="dictionary"):
            archive.read_archive(spark, path).collect()
        assert archive.read_archive(spark, path, dictionaryPath=where).count() == 600
        os.replace(where, os.path.join(path, archive.DICTIONARY_FILE))
        assert archive.read_archive(spark, path).count() == 600


class _Handler(http.server.BaseHTTPRequestHandler):
    files: dict = {}
    failures = 0

    def do_GET(self):
        if type(self).failures:
            type(self).failures -= 1
            self.send_error(503)
            return
        data = self.files.get(self.path.partition("?")[0])
        if data is None:
            self.send_error(404)
            return
        m = re.match(r"bytes=(\d*)-(\d*)", self.headers.get("Range", ""))
        if m:
            a = int(m[1]) if m[1] else max(0, len(data) - int(m[2]))
            b = int(m[2]) + 1 if m[1] and m[2] else len(data)
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
            data = data[a:b]
        else:
            self.send_response(200)
            if "pull" in self.path:
                self.send_header("X-Next-Offset", "2")
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self):
        self.rfile.read(int(self.headers.get("Content-Length", 0)))
        self.do_GET()

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_remote_archives_by_ranges(spark, kept, server):
    shard = archive.shards_of(kept)[0]
    _Handler.files = {"/a.leaves": open(shard, "rb").read()}
    _Handler.failures = 1
    with Ranges(f"{server}/a.leaves", pause=0.01) as r:
        assert r.size() == os.path.getsize(shard) and r.read(0, 4) == archive.MAGIC
    want = archive.read_archive(spark, shard).count()
    assert archive.read_archive(spark, f"{server}/a.leaves").count() == want


def test_info_of_an_address(spark, kept, server):
    shard = archive.shards_of(kept)[0]
    _Handler.files = {"/a.leaves": open(shard, "rb").read()}
    far, near = (archive.archive_info(spark, p).first() for p in (f"{server}/a.leaves", shard))
    assert far == near and far.file_bytes == os.path.getsize(shard) and far.chunk_bytes == far.file_bytes - 9 - 16 - 14 * far.chunks


@pytest.mark.parametrize("size", ["1", "3000", "100000000"])
def test_partitions_are_runs_of_chunks(spark, docs, tmp_path, size):
    path = str(tmp_path)
    archive.write_archive(docs, path, shards=2, level=3, maxDocs=50)
    df = archive.read_archive(spark, path, partitionBytes=size)
    chunks_ = archive.archive_chunks(spark, path).count()
    assert df.rdd.getNumPartitions() == {"1": chunks_, "100000000": 2}.get(size, df.rdd.getNumPartitions()) <= chunks_
    assert [r.doc_idx for r in df.orderBy("doc_idx").collect()] == list(range(600))
    assert [r.doc_idx for r in df.where("doc_idx in (7, 420)").orderBy("doc_idx").collect()] == [7, 420]
    os.unlink(os.path.join(path, archive.MANIFEST))
    assert archive.read_archive(spark, path, partitionBytes=size).count() == 600


def test_files_by_way_of_file_systems(tmp_path):
    place = f"file://{tmp_path}/a/b.bin"
    files.replace(place, b"one")
    assert files.read_all(place) == b"one" and files.exists(place) and files.names(f"file://{tmp_path}/a") == ["b.bin"]
    files.move(place, files.join(f"file://{tmp_path}", "c.bin"))
    assert files.names(str(tmp_path)) == ["c.bin"] and not files.exists(place) and files.names(f"{tmp_path}/none") == []
    files.remove(f"{tmp_path}/c.bin")
    assert not files.exists(f"{tmp_path}/c.bin")


def test_sessions(server):
    framed = b"".join(struct.pack(">I", len(d)) + d for d in (b"one", b""))
    _Handler.files = {"/corpus/c/receipt/open": b'{"session_id": "s", "total": 2}', "/corpus/c/receipt/pull": framed, "/corpus/c/receipt/finalize": b'{"doc_count": 2}', "/corpus/c/commitment.json": b'{"ts": 1}'}
    assert ingest.pull(server, "c", "s", 0, 256) == ([b"one", b""], 2, False)
    for limit in (0, 2):
        assert list(ingest.session_documents(server, "c", limit=limit)) == [b"one", b"", ("commitment", {"doc_count": 2})]
    assert ingest.fetch_commitment(server, "c") == ({"ts": 1}, None)
    with pytest.raises(ValueError):
        ingest.frames(b"\0\0\0\5abc")


def test_documents_of_a_corpus(spark, docs, tmp_path, capsys):
    base = str(tmp_path / "base")
    archive.write_archive(docs, base, shards=2, level=3)
    shards = [os.path.basename(s) for s in archive.shards_of(base)]
    counts = [archive.read_archive(spark, os.path.join(base, s)).count() for s in shards]
    with gzip.open(os.path.join(base, "t.tsv.gz"), "wt") as f:
        f.writelines(f"T{i}\t{int(i >= counts[0])}\t{i - counts[0] * (i >= counts[0])}\n" for i in range(600))
    registry = {"c": {"base": base, "shards": shards, "shard_docs": counts, "titles": "t.tsv.gz"}}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    ask = lambda ref: catalog.resolve(spark, registry, "c", ref, str(tmp_path / "kept"))
    assert ask("t599/") == (os.path.join(base, shards[1]), 599 - counts[0]) and ask(str(counts[0])) == (os.path.join(base, shards[1]), 0)
    with pytest.raises(IndexError):
        ask("none")
    run = lambda *a: cli.main(["get", "c", *a, "--text", "--registry", str(tmp_path / "r.json"), "--kept", str(tmp_path / "kept")], spark)
    assert run("T7") == 0 and "page 7 " in capsys.readouterr().out
    assert run("none") == 1


def test_folders(spark, tmp_path):
    for name in ("b.html", "a/z.html", "a/x.HTML", "a/n.txt"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"<p>" + name.encode())
    got = folders.read_folder(spark, str(tmp_path)).orderBy("doc_idx").collect()
    assert [(r.doc_idx, bytes(r.content)) for r in got] == [(0, b"<p>a/z.html"), (1, b"<p>b.html")]
    with pytest.raises(FileNotFoundError):
        folders.read_folder(spark, str(tmp_path), "*.none")


def test_with_index_counts_without_gaps(spark):
    df = spark.createDataFrame([(random.Random(i).randint(0, 99), i) for i in range(500)], "a int, b int").repartition(7)
    got = folders.with_index(df, "a", "b").orderBy("doc_idx").collect()
    assert [r.doc_idx for r in got] == list(range(500)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


# WARC


def _record(kind, url, payload, nl=b"\r\n", length=None):
    return nl.join((b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Target-URI: " + url, b"Content-Length: " + (str(len(payload)).encode() if length is None else length), b"")) + nl + payload + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    page = b"<html><p class='a  b'>hi</p></html>"
    http_ = b"HTTP/1.1 200 OK\r\nX: 1\r\nContent-Type: text/html\r\nx: 2\r\n\r\n"
    raw = [
        _record(b"response", b"http://a/", http_ + page), _record(b"request", b"http://a/", b"GET /"), _record(b"response", b"http://b/", b"HTTP/1.1 200 OK\n\n <!doctype html>"),
        _record(b"response", b"http://c/", b"HTTP/1.1 200 OK\r\nContent-Type: TEXT/HTML\r\n\r\n<p>"), _record(b"Response", b"http://d/", http_, b"\r\n"), _record(b"response", b"http://e/", b"<h1>", b"\n"),
        _record(b"response", b"http://f/", b"", length=b"x"),
        _record(b"response", b"http://g/", b"HTTP/1.1 200 OK\r\nContent-Type: \r\n\r\n" + b" " * 600 + b"<HTML>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    for name in ("a.warc", "b.warc.gz"):
        df = warc.read_warc(spark, str(tmp_path / name))
        assert df.count() == 8
        assert sorted((r.url, bytes(r.body)) for r in warc.html_responses(df).collect()) == [("http://a/", page), ("http://b/", b" <!doctype html>"), ("http://e/", b"<h1>"), ("http://g/", b" " * 600 + b"<HTML>")]
        h = df.where("record_no = 0").select(warc.split_response("payload").alias("r")).first().r
        assert (h.status, h.headers) == ("HTTP/1.1 200 OK", {"x": "2", "content-type": "text/html"})
    once = warc.encode_records(df)
    assert tuple(warc.record_counts(once).first()) == (1, 7)
    warc.write_warc(once, str(tmp_path / "once"))
    back = warc.decode_records(warc.read_warc(spark, str(tmp_path / "once")))
    assert tuple(warc.record_counts(back).first()) == (1, 7)
    warc.write_warc(back, str(tmp_path / "twice"), compress=False)
    bodies = {r.url: bytes(r.body).decode() for r in warc.html_responses(warc.read_warc(spark, str(tmp_path / "twice"))).collect()}
    assert bodies["http://a/"] == C.decode(C.encode(page)) and bodies["http://e/"] == "<h1>"


# selection, chunks, Merkle, catalogue, metrics


@pytest.mark.parametrize("s", [(None, None, None), (3, 9, 2), (-5, None, None), (None, None, -1), (8, 2, -3), (2, 2, 1), (-100, 100, 7), (None, -4, None)])
def test_slices(spark, s):
    got = [r.doc_idx for r in select.slice_docs(spark.range(12).withColumnRenamed("id", "doc_idx"), *s).collect()]
    assert got == list(range(12))[slice(*s)]


def test_get(spark):
    df = spark.range(5).withColumnRenamed("id", "doc_idx")
    assert select.get(df, -1).first()[0] == 4
    for i in (5, -6):
        with pytest.raises(IndexError):
            select.get(df, i)
    with pytest.raises(ValueError):
        select.slice_docs(df, step=0)


def test_locate(spark):
    counts = spark.createDataFrame([(0, 3), (1, 0), (2, 70_000), (3, 2)], "chunk_id int, doc_count long")
    got = select.locate(spark.createDataFrame([(i,) for i in (-1, 0, 2, 3, 70_002, 70_003, 70_005)], "doc_idx long"), select.spans(counts, "chunk_id"))
    assert sorted((r.doc_idx, r.chunk_id, r.within) for r in got.collect()) == [(0, 0, 0), (2, 0, 2), (3, 2, 0), (70_002, 2, 69_999), (70_003, 3, 0)]


@pytest.mark.parametrize("n,docs_,bytes_,block", [(300, 7, 100, 20), (65, 256, 10**9, 256), (0, 5, 10, 10), (41, 7, 100, 20)])
def test_chunk_plan_is_a_greedy_fold(spark, n, docs_, bytes_, block):
    sizes = [random.Random(i).randint(0, 80) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_idx long, encoded_bytes long")
    expected, chunk, d, b = [], 0, 0, 0
    for x in sizes:
        expected.append(chunk)
        d, b = d + 1, b + x
        if d >= docs_ or b >= bytes_:
            chunk, d, b = chunk + 1, 0, 0
    assert [r.chunk_id for r in chunks.chunk_plan(df, max_docs=docs_, max_bytes=bytes_, block=block).orderBy("doc_idx").collect()] == expected
    if n:
        assert [r.chunk_id for r in chunks.chunk_plan(df, max_docs=docs_, max_bytes=bytes_, block=block, group=3).orderBy("doc_idx").collect()] == expected
    one = chunks.chunk_plan(df.withColumn("s", F.lit("x")), shard="s", max_docs=docs_, max_bytes=bytes_)
    assert [r.chunk_id for r in one.orderBy("doc_idx").collect()] == expected


def _root(hashes):
    if not hashes:
        return hashlib.sha256(b"").hexdigest()
    nodes = [hashlib.sha256(b"\0" + bytes.fromhex(h)).digest() for h in hashes]
    while nodes[1:]:
        right = nodes[1::2] + nodes[-1:] * (len(nodes) & 1)
        nodes = [hashlib.sha256(b"\1" + x + y).digest() for x, y in zip(nodes[::2], right)]
    return nodes[0].hex()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1025])
def test_merkle_roots(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame(list(enumerate(hashes)), "pos long, doc_sha256 string")
    root = merkle.merkle_root(df)
    assert tuple(root.first()) == (n, _root(hashes))
    if n == 3:
        assert merkle.verify_root(root, df).first().match and not merkle.verify_root(root, df.where("pos < 2")).first().match


def test_bundles(tmp_path):
    path = str(tmp_path / "b.zip")
    merkle.write_bundle(path, {"corpus": "c", "doc_count": 1, "merkle_root_hex": "00", "ts": 1, "extra": 2}, b"x")
    got = merkle.verify_bundle(path)
    assert got["verdict"] in ("SKIPPED", "FAIL") and got["digest_match"] is None
    assert merkle.canonical_json(got["commitment"]) == b'{"corpus":"c","doc_count":1,"merkle_root_hex":"00","ts":1}'


def test_receipts(tmp_path):
    path = str(tmp_path / "r.json")
    assert merkle.save_receipt({"b": 1, "a": 2}, path) == (path, None) and json.load(open(path)) == {"a": 2, "b": 1}
    assert merkle.save_receipt({"ots_receipt_b64": "AAE="}, path)[1] == str(tmp_path / "r.ots") and (tmp_path / "r.ots").read_bytes() == b"\0\1"


def test_catalogue(spark, tmp_path):
    lines = "Alpha\t0\t3\nalpha\t0\t4\na\tb\t1\t5\nBeta;\t0\t6\nbeta\t0\t7\nbroken\n"
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write(lines)
    t = catalog.read_titles(spark, str(tmp_path / "t.tsv.gz")).cache()
    assert [tuple(r)[1:] for r in t.orderBy("line_no").collect()] == [("Alpha", 0, 3), ("alpha", 0, 4), ("a\tb", 1, 5), ("Beta;", 0, 6), ("beta", 0, 7)]
    assert [r.idx for r in catalog.search_titles(t, " ALPHA/ ", 1).collect()] == [3]
    wanted = spark.createDataFrame([("alpha",), ("ALPHA",), ("BETA.",), ("beta",), ("none",)], "query string")
    assert {r.query: (r.match_class, r.idx) for r in catalog.lookup_titles(t, wanted).collect()} == {"alpha": (0, 4), "ALPHA": (1, 3), "BETA.": (2, 6), "beta": (0, 7)}
    registry = {"x": {"base": "http://h/", "shards": ["a", "b"], "shard_docs": [2, 3]}, "y": {"shards": ["c"]}}
    c = catalog.corpora(spark, registry)
    ask = spark.createDataFrame([("x", 0), ("x", 4), ("x", 5), ("x", -1), ("y", 9)], "name string, idx long")
    assert sorted(map(tuple, catalog.resolve_indexes(ask, c).collect())) == [("x", -1, 0, -1), ("x", 0, 0, 0), ("x", 4, 1, 2), ("y", 9, 0, 9)]
    assert catalog.resolve_sources("x", registry) == ["http://h/a", "http://h/b"]
    with pytest.raises(KeyError):
        catalog.resolve_sources("z", registry)


def test_registry_cache(tmp_path):
    source, cache = tmp_path / "r.json", str(tmp_path / "c.json")
    source.write_text('{"a": {}}')
    assert catalog.load_registry(str(source), cache) == {"a": {}}
    source.write_text('{"b": {}}')
    assert catalog.load_registry(str(source), cache) == {"a": {}}
    os.utime(cache, (time.time() - 4000,) * 2)
    source.unlink()
    assert catalog.load_registry(str(source), cache) == {"a": {}}


def test_solid_size_reads_packed_blocks(spark, monkeypatch):
    """Exactly one gzip stream in order, of records that reach its task in packed blocks, not in rows."""
    monkeypatch.setattr(metrics, "BLOCK", 5000)
    r = random.Random(3)
    rows = [(i, None if i % 50 == 7 else "".join(r.choice("abcd é<>") for _ in range(r.randrange(900)))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(7)
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    want = sum(len(c.compress(v.encode())) for _, v in rows if v) + len(c.flush())
    for df, column in ((pages, "html"), (pages.withColumn("html", F.encode("html", "UTF-8")), "html")):
        assert [tuple(x) for x in metrics.solid_size(df, column, "page_id").collect()] == [(want,)]
    packed = metrics._packed(pages, "html", "page_id").collect()
    assert len(packed) < 100 and sum(x.size for x in packed) == sum(len(v.encode()) for _, v in rows if v)
    assert sum(len(x.data) for x in packed) < 0.6 * sum(x.size for x in packed)


def test_metrics(spark):
    pages = spark.createDataFrame([(i, f"<p class='a b'>text {i}<br>more</p>" * 3) for i in range(20)], "doc_idx long, html string")
    r = metrics.compression_report(pages).first()
    assert r.docs == 20 and r.raw_bytes == 2010
    assert metrics.roundtrip(pages, "doc_idx").where("tags_equal and words_equal").count() == 20
    assert tuple(metrics.sample_fidelity(pages, pages).first()) == (True, True)
    assert tuple(metrics.sample_fidelity(pages, pages.where("doc_idx < 19")).first())[0] is False
    assert metrics.baseline_report(pages, dictionary=b"<p class='a b'>text <br>more</p>" * 9).first().docs == 20
    out, seen = metrics.observed_encoding(pages.union(spark.createDataFrame([(20, None), (21, "<p " + " ".join(f"a{i}" for i in range(300)) + ">")], "doc_idx long, html string")))
    assert out.count() == 22 and seen.get == {"pages": 22, "encoded": 20, "failed": 1}
    whole = b"".join(f"<p class='a b'>text {i}<br>more</p>".encode() * 3 for i in range(20))
    assert abs(metrics.solid_size(pages, "html", "doc_idx").first()[0] - len(gzip.compress(whole, 9))) < 30
    s = metrics.segment_summary(spark.createDataFrame([(50, 100, True), (90, 100, True)], "archive_bytes long, baseline_bytes long, ok boolean")).first()
    assert s.pooled_saving == pytest.approx(0.3) and s.deviation == pytest.approx(0.2) and s.all_ok


# streams and commands


def test_stream_into_an_archive(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(10 * k + i, "u", f"<p>{10 * k + i}</p>") for i in range(3)], "page_id long, url string, html string").write.mode("append").parquet(source)
        ingest.append_to_archive(ingest.stream_pages(spark, source), target, str(tmp_path / "check"), level=1).trigger(availableNow=True).start().awaitTermination()
    got = archive.read_archive(spark, target).orderBy("doc_idx").select(H.decode_text("encoded")).collect()
    assert [r[0] for r in got] == ["0", "1", "2", "10", "11", "12"]
    assert archive.batches_of(target) == {0, 1}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.html").write_text(f"<html><p>page {i}</p></html>")
    p = lambda name: str(tmp_path / name)
    run = lambda *a: cli.main(list(a), spark)
    assert run("pack", p("in"), p("a")) == 0 and run("unpack", p("a"), p("files"), "--text") == 0
    assert (tmp_path / "files" / "doc_000002.txt").read_text() == "page 2"
    assert run("get", p("a"), "-1", "--text") == 0 and "page 2" in capsys.readouterr().out
    assert run("stream", p("a"), "--text", "--limit", "2") == 0 and capsys.readouterr().out == "page 0\npage 1\n"
    assert run("to-warc", p("a"), p("w")) == 0 and run("from-warc", p("w"), p("b")) == 0 and run("info", p("b")) == 0
    assert "|3 " in capsys.readouterr().out
    assert run("get", p("a"), "7") == 1 and run("pack", p("nothing"), p("z")) == 1 if os.path.isdir(p("nothing")) else True
