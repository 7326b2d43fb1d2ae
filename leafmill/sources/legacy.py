"""Older forms: single encoded documents with a string table of their own, and whole-folder packs.

A single document is ``magic (4) | version u8 | table | structure | content``, each
part after its size (u32) and deflated. Its table holds all names and values of the
document, the most frequent first, ties by first use; it is a vocabulary of its own.
A pack is ``magic (4) | version u8 | directory | structure | content``: a directory
of names and stream lengths, and one structure and one content stream for all.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.html import _lenient, _mapped
from ..functions.vocabulary import DEFAULT, Vocabulary
from .files import local

SINGLE, PACK, FORM = b"LEA1", b"LEAP", 5


def _part(data: bytes) -> bytes:
    packed = zlib.compress(data, 9)
    return struct.pack(">I", len(packed)) + packed


def _parts(blob: bytes, magic: bytes, count: int) -> list[bytes]:
    if blob[:4] != magic or blob[4:5] != bytes((FORM,)):
        raise codec.CorruptDocument("bad magic or version")
    out, at = [], 5
    for _ in range(count):
        if at + 4 > len(blob):
            raise codec.CorruptDocument("the document breaks off")
        (n,) = struct.unpack_from(">I", blob, at)
        try:
            out.append(zlib.decompress(blob[at + 4 : at + 4 + n]))
        except zlib.error as e:
            raise codec.CorruptDocument(str(e)) from e
        at += 4 + n
    return out


def _streams(blob: bytes) -> tuple[bytes, bytes]:
    (n,) = struct.unpack_from(">I", blob)
    return blob[4 : 4 + n], blob[4 + n :]


def string_table(nodes: list[tuple], base: Vocabulary = DEFAULT) -> list[str]:
    """Strings of a document outside the vocabulary, by falling frequency, then first use."""
    seen: Counter = Counter()
    known = set(base.strings)
    for _, tag, attrs, _ in nodes:
        names = [] if tag is None or tag in base.tags else [tag]
        for name, value in attrs:
            names += [] if name.lower() in base.attrs else [name.lower()]
            names += (value or "").split() if name.lower() == "class" else [value]
        seen.update(n for n in names if n and n not in known)
    return [s for s, _ in seen.most_common((1 << 16) - len(base.strings))]


def encode_single(html, base: Vocabulary = DEFAULT) -> bytes:
    nodes = codec.parse(html)
    table = string_table(nodes, base)
    c = codec.Codec(Vocabulary.of(base.tags, base.attrs, (*base.strings, *table)))
    return SINGLE + bytes((FORM,)) + _part(json.dumps(table, ensure_ascii=False).encode("utf-8", "replace")) + b"".join(map(_part, _streams(c.encode_nodes(nodes))))


def decode_single(blob: bytes, base: Vocabulary = DEFAULT) -> str:
    table, shape, content = _parts(bytes(blob), SINGLE, 3)
    c = codec.Codec(Vocabulary.of(base.tags, base.attrs, (*base.strings, *json.loads(table))))
    return c.decode(struct.pack(">I", len(shape)) + shape + content, strict=True)


def encode_single_column(html, base: Vocabulary = DEFAULT, strict: bool = False) -> Column:
    return _mapped(_lenient(lambda v: encode_single(v, base), strict), "binary")(html)


def decode_single_column(blob, base: Vocabulary = DEFAULT, strict: bool = False) -> Column:
    return _mapped(_lenient(lambda v: decode_single(v, base), strict), "string")(blob)


def write_pack(files: DataFrame, path: str, base: Vocabulary = DEFAULT) -> None:
    """One pack of ``path, content`` rows, in path order. It is a single file, so one writer makes it."""
    c = codec.Codec(base)
    encode = _mapped(_lenient(c.encode, False), "binary")
    entries, shapes, contents = [], [], []
    for row in files.select("path", encode("content").alias("e")).where("e is not null").orderBy("path").toLocalIterator():
        shape, content = _streams(bytes(row.e))
        entries.append((row.path, len(shape), len(content)))
        shapes.append(shape)
        contents.append(content)
    with open(local(path) + ".new", "wb") as f:
        f.write(PACK + bytes((FORM,)) + _part(json.dumps(entries).encode()) + _part(b"".join(shapes)) + _part(b"".join(contents)))
    os.replace(local(path) + ".new", local(path))


def read_pack(spark, path: str, base: Vocabulary = DEFAULT) -> DataFrame:
    """``path, encoded`` of a pack, which one task must inflate."""

    def rows(batch):
        for blob in batch:
            directory, shapes, contents = _parts(bytes(blob), PACK, 3)
            s = c = 0
            out = []
            for name, n, m in json.loads(directory):
                out.append({"path": name, "encoded": struct.pack(">I", n) + shapes[s : s + n] + contents[c : c + m]})
                s, c = s + n, c + m
            yield out

    def inflate(col: pd.Series) -> pd.Series:
        return pd.Series(list(rows(col)))

    found = F.pandas_udf(inflate, "array<struct<path:string,encoded:binary>>")
    return spark.read.format("binaryFile").load(path).select(F.inline(found("content")))
