"""Arrow functions over columns of pages, and the table of their nodes.

Where a page can't be encoded (an element with more than 255 attributes), or a
blob is corrupt, the result is null, unless ``strict`` is set.
"""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codec
from . import text as T
from .vocabulary import DEFAULT, Vocabulary

NODE_DDL = "seq int, op tinyint, tag string, attrs array<struct<name:string,value:string>>, payload string"
_NODE_NAMES = ("seq", "op", "tag", "attrs", "payload")
#: Pages whose nodes make a batch, and values that are Python objects at a time.
PAGES = 256
_ARROW = {
    "string": pa.string(), "binary": pa.binary(), "long": pa.int64(),
    "struct<encoded_bytes:bigint,decoded:string>": pa.struct([("encoded_bytes", pa.int64()), ("decoded", pa.string())]),
}


def _mapped(f, kind: str):
    """An Arrow UDF that applies ``f`` to what isn't null, slice by slice, so that a batch isn't held as objects."""
    to = _ARROW[kind]

    def run(col: pa.Array) -> pa.Array:
        done = [pa.array((None if v is None else f(v) for v in col.slice(at, PAGES).to_pylist()), to) for at in range(0, len(col), PAGES)]
        return pa.concat_arrays(done) if done else pa.array([], to)

    return F.arrow_udf(run, kind)


def _lenient(f, strict: bool):
    def run(v):
        try:
            return f(v)
        except ValueError:
            if strict:
                raise
            return None

    return run


def extract_text(html, repair: bool = False, tokenizer: str = "plain") -> Column:
    """Readable text of HTML; for tokenizers see ``codec.parser``."""
    return _mapped(lambda v: codec.nodes_text(codec.parser(tokenizer)(v), repair), "string")(html)


def encode_html(html, vocabulary: Vocabulary = DEFAULT, strict: bool = False, tokenizer: str = "plain") -> Column:
    c = codec.Codec(vocabulary, tokenizer)
    return _mapped(_lenient(c.encode, strict), "binary")(html)


def decode_html(encoded, vocabulary: Vocabulary = DEFAULT, strict: bool = False) -> Column:
    c = codec.Codec(vocabulary)
    return _mapped(_lenient(lambda v: c.decode(v, strict), strict), "string")(encoded)


def recode_html(html, vocabulary: Vocabulary = DEFAULT, strict: bool = False) -> Column:
    """``encoded_bytes, decoded``: the size of an encoded page and what comes back; the page is encoded once and only the size returned."""
    c = codec.Codec(vocabulary)
    encode, decode = _lenient(c.encode, strict), _lenient(lambda v: c.decode(v, strict), strict)

    def run(v):
        e = encode(v)
        return None if e is None else {"encoded_bytes": len(e), "decoded": decode(e)}

    return _mapped(run, "struct<encoded_bytes:bigint,decoded:string>")(html)


def decode_text(encoded, vocabulary: Vocabulary = DEFAULT, strict: bool = False) -> Column:
    """Readable text of an encoded page or text, without making HTML of it."""
    c = codec.Codec(vocabulary)
    return _mapped(_lenient(lambda v: c.text(v, strict), strict), "string")(encoded)


def gzip_size(data, level: int = 9) -> Column:
    return _mapped(lambda v: len(gzip.compress(v if isinstance(v, bytes) else v.encode("utf-8", "replace"), level, mtime=0)), "long")(data)


def gzip_member(data) -> Column:
    """One gzip member, the same for the same bytes."""
    return _mapped(lambda v: gzip.compress(v, mtime=0), "binary")(data)


def zlib_compress(data, level: int = 9) -> Column:
    return _mapped(lambda v: zlib.compress(v, level), "binary")(data)


def zlib_decompress(data) -> Column:
    return _mapped(zlib.decompress, "binary")(data)


def zstd_compress(data, level: int = 19, dictionary: bytes | None = None) -> Column:
    def run(col: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return pd.Series([None if v is None else c.compress(v) for v in col], dtype=object)

    return F.pandas_udf(run, "binary")(data)


def zstd_decompress(data, dictionary: bytes | None = None) -> Column:
    def run(col: pd.Series) -> pd.Series:
        import zstandard

        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return pd.Series([None if v is None else d.decompressobj().decompress(v) for v in col], dtype=object)

    return F.pandas_udf(run, "binary")(data)


_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _node_arrays(pages: pa.Array, tokenizer: str) -> tuple[np.ndarray, list[pa.Array]]:
    """For each node the number of its page; and the columns of ``NODE_DDL``."""
    parse = codec.parser(tokenizer)
    rows, seq, ops, tags, payloads, ends, names, values = [], [], [], [], [], [0], [], []
    for i, v in enumerate(pages.to_pylist()):
        found = parse(v) if v is not None else []
        rows.append(len(found))
        seq.append(np.arange(len(found), dtype=np.int32))
        for op, tag, attrs, payload in found:
            ops.append(op)
            tags.append(tag)
            payloads.append(payload)
            for name, value in attrs:
                names.append(name)
                values.append(value)
            ends.append(len(names))
    attrs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"]))
    cols = [pa.array(np.concatenate(seq) if seq else [], pa.int32()), pa.array(ops, pa.int8()), pa.array(tags, pa.string()), attrs.cast(_ATTRS), pa.array(payloads, pa.string())]
    return np.repeat(np.arange(len(rows)), rows), cols


def html_nodes(pages: DataFrame, *keys: str, html: str = "html", tokenizer: str = "plain") -> DataFrame:
    """``keys, seq, op, tag, attrs, payload``: a row for each node of each page."""
    kept = pages.select(*keys, F.col(html).alias("_html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                row, cols = _node_arrays(part.column(part.num_columns - 1), tokenizer)
                mine = part.select(list(range(len(keys)))).take(pa.array(row))
                yield pa.record_batch([*mine.columns, *cols], [*keys, *_NODE_NAMES])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_html")
    return kept.mapInArrow(run, f"{ddl}, {NODE_DDL}")


def extract_cascade(html, *extractors) -> Column:
    """The text that the first of the functions gives that neither fails nor gives None; at last tags are stripped."""
    tried = [_mapped(_lenient_to_any(f), "string")(html) for f in extractors]
    return F.coalesce(*tried, T.strip_tags(html))


def _lenient_to_any(f):
    def run(v):
        try:
            return f(v)
        except Exception:  # whatever a foreign extractor raises, the next one is tried
            return None

    return run


def register(spark) -> None:
    """The functions under their names for SQL, with the default vocabulary."""
    c = codec.Codec()
    for name, f, kind in (
        ("extract_text", lambda v: codec.nodes_text(codec.parse(v)), "string"), ("encode_html", _lenient(c.encode, False), "binary"),
        ("decode_html", _lenient(c.decode, False), "string"), ("decode_text", _lenient(c.text, False), "string"),
    ):
        spark.udf.register(name, _mapped(f, kind))

    @F.udtf(returnType=NODE_DDL)
    class HtmlNodes:
        def eval(self, html: str):
            for i, (op, tag, attrs, payload) in enumerate(codec.parse(html) if html is not None else []):
                yield i, op, tag, [{"name": k, "value": v} for k, v in attrs], payload

    spark.udtf.register("html_nodes", HtmlNodes)
