"""Archives: documents in compressed chunks, with an index at the end of the file.

``magic (4) | version u8 | dictionary size u32 | dictionary | chunks | index | footer``;
a chunk is ``documents u16 | encoded bytes u32 | compressed bytes u32 | sizes u32... | blob``,
an index row ``offset u64 | documents u16 | encoded bytes u32``, the footer
``chunks u64 | index offset u64``; numbers are big-endian.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("leaves").load(path)                          # doc_idx, shard, chunk_id, encoded
    spark.read.format("leaves").option("view", "chunks").load(path) # the index alone

Options: ``view``, ``dictionaryPath`` (without it an embedded dictionary, or one that
``find_dictionary`` finds), ``mode`` (FAILFAST, or PERMISSIVE to leave
corrupt chunks out), ``magic``; for writing also ``level``, ``embedDictionary``,
``codec`` (zstd or zlib), ``maxDocs`` and ``maxBytes``. A filter on ``doc_idx``
that is pushed down leaves whole shards and chunks unread.

A partition is a run of chunks of one shard, of about ``partitionBytes`` encoded bytes
(64 MiB). Where the folder has a manifest, planning reads nothing else: tasks read
the indexes of their shards.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .files import Ranges, drop_folder, exists, folder_of, is_folder, is_local, is_url, join, listed, local, move, names, open_output, read_all, remove, replace
from .folders import with_index

MAGIC, VERSION, SUFFIX = b"LEAF", 2, ".leaves"
MAX_DOCS, MAX_BYTES = 256, 2 << 20
_HEAD, _CHUNK, _INDEX, _FOOT = struct.Struct(">4sBI"), struct.Struct(">HII"), struct.Struct(">QHI"), struct.Struct(">QQ")
MANIFEST = "_manifest.json"
PARTITION_BYTES = 64 << 20
_DOCUMENTS = pa.schema([("doc_idx", pa.int64()), ("shard", pa.string()), ("chunk_id", pa.int32()), ("encoded", pa.binary())])
_CHUNKS = pa.schema([("shard", pa.string()), ("chunk_id", pa.int32()), ("file_offset", pa.int64()), ("doc_count", pa.int32()), ("encoded_bytes", pa.int64())])
DICTIONARY_FILE, DICTIONARY_VARIABLE = "leaves.dict", "LEAFMILL_DICTIONARY"
_ZSTD = b"\x28\xb5\x2f\xfd"


class ArchiveError(ValueError):
    """Not an archive, one of another version, or a broken one."""


class DictionaryRequired(ArchiveError):
    """A chunk was compressed with a dictionary that isn't at hand."""


@dataclass
class Run(InputPartition):
    """The ``part``-th of ``parts`` runs of a shard's chunks; its first document in the whole archive."""

    shard: str
    first_doc: int
    part: int
    parts: int

    def __post_init__(self):
        super().__init__((self.shard, self.part))


def compress(data: bytes, codec: str, level: int, dictionary: bytes | None) -> bytes:
    if codec == "zlib":
        return zlib.compress(data, min(level, 9))
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress(data)


def decompress(blob: bytes, size: int, dictionary: bytes | None) -> bytes:
    if blob[:4] != _ZSTD:
        return zlib.decompress(blob)
    import zstandard

    if zstandard.get_frame_parameters(blob).dict_id and not dictionary:
        raise DictionaryRequired("the archive was written with a dictionary; give its place as dictionaryPath")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return d.decompress(blob, max_output_size=size)


def read_index(r: Ranges, magic: bytes = MAGIC) -> tuple[list[tuple[int, int, int]], int, int, int]:
    """Index rows, size of the embedded dictionary, where the index starts, and the size of the file."""
    size = r.size()
    if size < _HEAD.size + _FOOT.size:
        raise ArchiveError(f"{r.path}: bad magic" if r.read(0, min(4, size)) != magic else f"{r.path}: the file breaks off")
    said, version, dict_size = _HEAD.unpack(r.read(0, _HEAD.size))
    if said != magic:
        raise ArchiveError(f"{r.path}: bad magic {said!r}")
    if version != VERSION:
        raise ArchiveError(f"{r.path}: version {version}, not {VERSION}")
    count, at = _FOOT.unpack(r.read(size - _FOOT.size, _FOOT.size))
    if at + count * _INDEX.size + _FOOT.size != size or at < _HEAD.size + dict_size:
        raise ArchiveError(f"{r.path}: the index doesn't fit the file")
    rows = list(_INDEX.iter_unpack(r.read(at, count * _INDEX.size)))
    if any(not _HEAD.size + dict_size <= o < at for o, _, _ in rows):
        raise ArchiveError(f"{r.path}: a chunk lies outside the file")
    return rows, dict_size, at, size


def read_chunk(r: Ranges, offset: int, doc_count: int, encoded_bytes: int, dictionary: bytes | None) -> list[bytes]:
    docs, total, packed = _CHUNK.unpack(r.read(offset, _CHUNK.size))
    if (docs, total) != (doc_count, encoded_bytes):
        raise ArchiveError(f"{r.path}: chunk at {offset} and its index row differ")
    sizes = struct.unpack(f">{docs}I", r.read(offset + _CHUNK.size, 4 * docs))
    if sum(sizes) != total:
        raise ArchiveError(f"{r.path}: sizes of the chunk at {offset} don't add up")
    data = decompress(r.read(offset + _CHUNK.size + 4 * docs, packed), total, dictionary)
    if len(data) != total:
        raise ArchiveError(f"{r.path}: chunk at {offset} has {len(data)} bytes, not {total}")
    out, at = [], 0
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


class ArchiveFile:
    """Writes one archive."""

    def __init__(self, path: str, dictionary: bytes | None = None, embed: bool = False, codec: str = "zstd", level: int | None = None, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, magic: bytes = MAGIC):
        self.file, self.dictionary, self.codec = open_output(path), dictionary, codec
        self.level = level if level is not None else 22 if dictionary else 19
        self.max_docs, self.max_bytes = max_docs, max_bytes
        inside = dictionary if embed and dictionary else b""
        self.file.write(_HEAD.pack(magic, VERSION, len(inside)) + inside)
        self.held: list[bytes] = []
        self.bytes, self.index, self.docs, self.encoded = 0, [], 0, 0

    def append(self, encoded: bytes) -> None:
        """Closes a chunk once it has ``max_docs`` documents or ``max_bytes`` bytes."""
        self.held.append(encoded)
        self.bytes += len(encoded)
        if len(self.held) >= self.max_docs or self.bytes >= self.max_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        blob = compress(b"".join(self.held), self.codec, self.level, self.dictionary)
        self.index.append((self.file.tell(), len(self.held), self.bytes))
        self.file.write(_CHUNK.pack(len(self.held), self.bytes, len(blob)) + struct.pack(f">{len(self.held)}I", *map(len, self.held)) + blob)
        self.docs, self.encoded = self.docs + len(self.held), self.encoded + self.bytes
        self.held, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        at = self.file.tell()
        self.file.write(b"".join(_INDEX.pack(*row) for row in self.index) + _FOOT.pack(len(self.index), at))
        self.file.close()


def _dictionary(options) -> bytes | None:
    path = options.get("dictionarypath")
    if not path:
        return None
    with Ranges(path) as r:
        return r.read(0, r.size())


def find_dictionary(path: str, given: str | None = None) -> str | None:
    """The dictionary's file: the one given, that of the environment, one beside the archive, or one in this folder."""
    beside = path if not is_url(path) and is_folder(path) else folder_of(path)
    for place in (given, os.environ.get(DICTIONARY_VARIABLE), join(beside, DICTIONARY_FILE) if beside else None, DICTIONARY_FILE):
        if place and (place == given or (not is_url(place) and exists(place))):
            return os.path.abspath(local(place)) if "://" not in place or place.startswith("file:") else place
    return None


def manifest_of(path: str) -> list[dict] | None:
    """The shards of a folder as its manifest has them: name, documents, chunks, encoded bytes."""
    place = join(path, MANIFEST)
    if is_url(path) or not exists(place):
        return None
    return json.loads(read_all(place))["shards"]


def shards_of(path: str) -> list[str]:
    """The shards of a folder in the order of its manifest, else in path order."""
    known = manifest_of(path)
    return listed(path, (SUFFIX,)) if known is None else [join(path, s["shard"]) for s in known]


class _Reader(DataSourceReader):
    def __init__(self, options, chosen: bool):
        self.options, self.chosen = options, chosen
        self.low, self.high, self.wanted = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("doc_idx",) and self.options.get("view", "documents") == "documents":
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(f.value if self.high is None else self.high, f.value)
                elif isinstance(f, In):
                    self.wanted = sorted(v for v in f.value if v is not None)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark filters the rows of the chunks that are left

    def _wants(self, first: int, docs: int) -> bool:
        last = first + docs - 1
        if last < self.low or (self.high is not None and first > self.high):
            return False
        if self.wanted is None:
            return True
        k = bisect.bisect_left(self.wanted, first)
        return k < len(self.wanted) and self.wanted[k] <= last

    def _sizes(self, path: str, magic: bytes):
        """Path, documents, encoded bytes and chunks of each shard."""
        known = manifest_of(path)
        if known is not None and all("docs" in s for s in known):
            yield from ((join(path, s["shard"]), s["docs"], s["encoded_bytes"], s["chunks"]) for s in known)
            return
        for shard in shards_of(path):
            with Ranges(shard) as r:
                rows, *_ = read_index(r, magic)
            yield shard, sum(n for _, n, _ in rows), sum(b for _, _, b in rows), len(rows)

    def _magic(self) -> bytes:
        return self.options.get("magic", MAGIC.decode()).encode("latin-1")

    def partitions(self):
        path = self.options.get("path") or json.loads(self.options.get("paths", "[]"))
        limit = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out, doc = [], 0
        for p in [path] if isinstance(path, str) else path:
            for shard, docs, total, chunks in self._sizes(p, self._magic()):
                if docs and self._wants(doc, docs):
                    parts = max(1, min(chunks, -(-total // limit)))
                    out += [Run(shard, doc, k, parts) for k in range(parts)]
                doc += docs
        return out or [Run("", 0, 0, 1)]

    def read(self, part: Run):
        if not part.shard:
            return
        with Ranges(part.shard) as r:
            rows, size, *_ = read_index(r, self._magic())
            lo, hi = part.part * len(rows) // part.parts, (part.part + 1) * len(rows) // part.parts
            if self.options.get("view", "documents") == "chunks":
                cols = [[part.shard] * (hi - lo), range(lo, hi), *zip(*rows[lo:hi])]
                if lo < hi:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _CHUNKS)], schema=_CHUNKS)
                return
            given = _dictionary(self.options) if self.chosen or not size else None
            given = given or r.read(_HEAD.size, size) or None
            first = part.first_doc + sum(n for _, n, _ in rows[:lo])
            for i, (offset, docs, total) in enumerate(rows[lo:hi], lo):
                if self._wants(first, docs):
                    try:
                        found = read_chunk(r, offset, docs, total, given)
                    except DictionaryRequired:
                        raise
                    except Exception:
                        if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                            raise
                        found = []
                    if found:
                        cols = [range(first, first + docs), [part.shard] * docs, [i] * docs, found]
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _DOCUMENTS)], schema=_DOCUMENTS)
                first += docs


@dataclass
class _Written(WriterCommitMessage):
    name: str
    order: int
    docs: int
    chunks: int
    encoded_bytes: int


class _Writer(DataSourceArrowWriter):
    """Shards are written aside and moved on commit; option ``batch``: a number that the manifest keeps, see ``batches_of``."""

    def __init__(self, options, schema, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.folder, self.column = options["path"], schema.fieldNames().index("encoded")
        self.aside = join(self.folder, "_temporary")

    def write(self, batches):
        from pyspark import TaskContext

        o, order = self.options, TaskContext.get().partitionId()
        name = f"part-{order:06d}-{uuid.uuid4().hex}{SUFFIX}"
        f = ArchiveFile(
            join(self.aside, name), _dictionary(o), o.get("embeddictionary", "false").lower() == "true", o.get("codec", "zstd"),
            int(o["level"]) if "level" in o else None, int(o.get("maxdocs", MAX_DOCS)), int(o.get("maxbytes", MAX_BYTES)), o.get("magic", MAGIC.decode()).encode("latin-1"),
        )
        for batch in batches:
            for encoded in batch.column(self.column).drop_null().to_pylist():
                f.append(encoded)
        f.close()
        return _Written(name, order, f.docs, len(f.index), f.encoded)

    def commit(self, messages):
        old = [] if self.overwrite else manifest_of(self.folder) or []
        new = []
        for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.order):
            move(join(self.aside, m.name), join(self.folder, m.name))
            new.append({"shard": m.name, "docs": m.docs, "chunks": m.chunks, "encoded_bytes": m.encoded_bytes} | ({"batch": int(self.options["batch"])} if "batch" in self.options else {}))
        replace(join(self.folder, MANIFEST), json.dumps({"shards": old + new}).encode())
        self._clear({s["shard"] for s in old + new})

    def abort(self, messages):
        for m in messages:
            if m and exists(p := join(self.aside, m.name)):
                remove(p)

    def _clear(self, keep: set[str]) -> None:
        for folder in (self.folder, self.aside):
            for n in names(folder):
                if n.endswith(SUFFIX) and (n not in keep or folder != self.folder) and (self.overwrite or folder != self.folder):
                    remove(join(folder, n))


def batches_of(path: str) -> set[int]:
    """Numbers of the micro-batches whose shards are in the archive; kept with the shards, in one rename."""
    return {s["batch"] for s in manifest_of(path) or [] if "batch" in s}


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "leaves"

    def schema(self):
        if self.options.get("view", "documents") == "chunks":
            return "shard string, chunk_id int, file_offset bigint, doc_count int, encoded_bytes bigint"
        return "doc_idx bigint, shard string, chunk_id int, encoded binary"

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema):
        options = self._plain()
        place = find_dictionary(options.get("path", ""), options.get("dictionarypath"))
        return _Reader(options | ({"dictionarypath": place} if place else {}), "dictionarypath" in options)

    def writer(self, schema, overwrite):
        return _Writer(self._plain(), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("leaves").options(**options).load(path)


def archive_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_archive(spark, path, view="chunks", **options)


def write_archive(docs: DataFrame, path: str, order: str = "doc_idx", shards: int | None = None, mode: str = "overwrite", **options) -> None:
    """Writes the column ``encoded`` in ascending ``order``: each shard holds a range of it."""
    register(docs.sparkSession)
    ranged = docs.repartitionByRange(shards, order) if shards else docs.repartitionByRange(order)
    ranged.sortWithinPartitions(order).select("encoded").write.format("leaves").mode(mode).options(**options).save(path)


def write_single(docs: DataFrame, path: str, order: str, partition_bytes: int = PARTITION_BYTES, **options) -> None:
    """Writes the column ``encoded`` in ascending ``order`` to a folder of one shard, which no single task makes.

    Runs of about ``partition_bytes`` that begin at a multiple of ``maxDocs`` documents are
    written by a task each, and joined. Where ``maxBytes`` closes chunks earlier, the last
    chunk of a run may be short.
    """
    spark = docs.sparkSession
    register(spark)
    numbered = with_index(docs.where("encoded is not null").select(order, "encoded"), order, name="_at")
    count, total = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("encoded")), F.lit(0))).first()
    chunk = int(options.get("maxDocs", MAX_DOCS))
    run = chunk * max(1, int(partition_bytes * count // (max(total, 1) * chunk)))
    aside = join(path, f"_parts-{uuid.uuid4().hex}")
    parts = numbered.repartitionById(max(1, -(-count // run)), F.floor(F.col("_at") / run).cast("int")).sortWithinPartitions("_at")
    parts.select("encoded").write.format("leaves").mode("overwrite").options(**options).save(aside)
    join_shards(spark, aside, path, options.get("magic", MAGIC.decode()).encode("latin-1"))
    drop_folder(aside)


#: Bytes that are copied at a time.
_COPY = 8 << 20


def _blocks(r: Ranges, lo: int, hi: int):
    for at in range(lo, hi, _COPY):
        yield r.read(at, min(_COPY, hi - at))


def _moved_index(r: Ranges, magic: bytes, by: int) -> bytes:
    return b"".join(_INDEX.pack(o + by, n, b) for o, n, b in read_index(r, magic)[0])


def join_shards(spark: SparkSession, source: str, target: str, magic: bytes = MAGIC) -> None:
    """The shards of a folder as one shard, the only one of ``target``.

    On a file system of this machine or one that is mounted, a task for each shard copies its
    chunks and its index to their places; elsewhere, where files can only be written in
    order, one task copies them block by block. A shard may have no documents; the
    dictionary of the first is kept.
    """
    known, head = manifest_of(source), _HEAD.size

    def measure(batches):
        for batch in batches:
            rows = []
            for shard in batch.column(0).to_pylist():
                with Ranges(shard) as r:
                    _, inside, at, _ = read_index(r, magic)
                rows.append((shard, head + inside, at))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["shard", "first", "last"])

    shards = [join(source, s["shard"]) for s in known]
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(max(1, len(rows)))
    found = {r.shard: r for r in table([(s,) for s in shards], "shard string").mapInArrow(measure, "shard string, first bigint, last bigint").collect()}  # a row for each shard
    place = found[shards[0]].first if shards else head
    chunks, bodies = sum(s["chunks"] for s in known), sum(found[s].last - found[s].first for s in shards)
    index, start, plan = place + bodies, place, []
    for s, k in zip(shards, known):
        plan.append((s, found[s].first, found[s].last, start, index))
        start, index = start + found[s].last - found[s].first, index + k["chunks"] * _INDEX.size
    foot = _FOOT.pack(chunks, place + bodies)
    name = f"part-000000-{uuid.uuid4().hex}{SUFFIX}"
    made, seekable = join(target, name + ".new"), is_local(target)

    def copy(rows) -> None:
        for shard, first, last, start, index in rows:
            with Ranges(shard) as source, open(local(made), "r+b") as f:
                f.seek(start)
                f.writelines(_blocks(source, first, last))
                f.seek(index)
                f.write(_moved_index(source, magic, start - first))

    def copy_all(_) -> None:
        with open_output(made) as f:
            for shard, first, last, *_ in plan:
                with Ranges(shard) as source:
                    if f.tell() == 0:
                        f.write(source.read(0, place))
                    for block in _blocks(source, first, last):
                        f.write(block)
            for shard, first, _, start, _ in plan:
                with Ranges(shard) as source:
                    f.write(_moved_index(source, magic, start - first))
            f.write(foot)

    if plan and not seekable:
        spark.sparkContext.parallelize([0], 1).foreachPartition(copy_all)
    else:
        with open_output(made) as f:
            if plan:
                with Ranges(shards[0]) as r:
                    f.write(r.read(0, place))
                f.seek(index)
            else:
                f.write(_HEAD.pack(magic, VERSION, 0))
            f.write(foot)
        if plan:
            table(plan, "shard string, first bigint, last bigint, start bigint, index bigint").foreachPartition(copy)
    move(made, join(target, name))
    totals = {k: sum(s[k] for s in known) for k in ("docs", "chunks", "encoded_bytes")}
    replace(join(target, MANIFEST), json.dumps({"shards": [{"shard": name} | totals]}).encode())
    for n in names(target):
        if n.endswith(SUFFIX) and n != name:
            remove(join(target, n))


def archive_info(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row: documents, chunks, bytes of the files and of their chunks alone, encoded bytes, ratio of the files to these, per cent saved by the chunks.

    For files, folders and addresses; each shard's index is read by a task.
    """
    magic = options.get("magic", MAGIC.decode()).encode("latin-1")

    def measure(batches):
        for batch in batches:
            rows = []
            for shard in batch.column(0).to_pylist():
                with Ranges(shard) as r:
                    index, _, at, size = read_index(r, magic)
                rows.append((sum(n for _, n, _ in index), len(index), size, at - index[0][0] if index else 0, sum(b for _, _, b in index)))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], _COUNTS)

    shards = shards_of(path)
    each = spark.createDataFrame([(s,) for s in shards], "shard string").repartition(max(1, len(shards) // 16))
    counted = each.mapInArrow(measure, ", ".join(f"{c} bigint" for c in _COUNTS))
    total = F.sum("encoded_bytes")
    return counted.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS), (F.sum("file_bytes") / total).alias("ratio"),
        F.round(100 * (1 - F.sum("chunk_bytes") / F.greatest(total, F.lit(1))), 2).alias("saved_percent"),
    )


_COUNTS = ["docs", "chunks", "file_bytes", "chunk_bytes", "encoded_bytes"]
