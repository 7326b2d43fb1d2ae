"""Commands: ``python -m leafmill.cli COMMAND ...`` or by spark-submit."""

from __future__ import annotations

import argparse
import json
import os
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("leafmill").getOrCreate()


def pack(spark, a) -> None:
    from .sources import archive, folders

    _write(archive, folders.read_folder(spark, a.source), "content", a)


def _write(archive, docs, html: str, a) -> None:
    """Encodes and writes; tells how many pages can't be encoded and are left out."""
    from pyspark.sql import functions as F

    from .operators import metrics

    encoded, seen = metrics.observed_encoding(docs, html)
    archive.write_archive(encoded.where(F.col("encoded").isNotNull()), a.target, **_options(a))
    if seen.get["failed"]:
        print(f"{seen.get['failed']} pages can't be encoded and are left out", file=sys.stderr)


def unpack(spark, a) -> None:
    from .functions import html as H
    from .sources import archive, folders

    docs = archive.read_archive(spark, a.source, **_options(a))
    text = H.decode_text("encoded") if a.text else H.decode_html("encoded")
    folders.write_files(docs.select("doc_idx", text.alias("html")), a.target, suffix=".txt" if a.text else ".html")


def info(spark, a) -> None:
    from .sources import archive

    archive.archive_info(spark, a.source, **_options(a)).show(truncate=False)


def get(spark, a) -> None:
    """A document by its place, or of a corpus of the registry by place or title."""
    from .functions import html as H
    from .operators import catalog, select
    from .sources import archive
    from .sources.files import exists, is_url

    source, ref = a.source, a.index
    if not is_url(source) and not exists(source):
        source, ref = catalog.resolve(spark, catalog.load_registry(_registry(a)), source, ref, a.kept)
    docs = archive.read_archive(spark, source, **_options(a))
    count = archive.archive_chunks(spark, source).agg({"doc_count": "sum"}).first()[0] or 0
    row = select.get(docs, int(ref), count).select((H.decode_text("encoded") if a.text else H.decode_html("encoded")).alias("t")).first()
    print(row.t)


def _registry(a) -> str:
    if not a.registry:
        raise ValueError(f"{a.source} isn't there; for a corpus give --registry")
    return a.registry


def stream(spark, a) -> None:
    from .functions import html as H
    from .operators import select
    from .sources import archive

    docs = archive.read_archive(spark, a.source, **_options(a)).orderBy("doc_idx")
    docs = select.first(docs, a.limit) if a.limit else docs
    for row in docs.select((H.decode_text("encoded") if a.text else H.decode_html("encoded")).alias("t")).toLocalIterator():
        print(row.t)


def search(spark, a) -> None:
    from .operators import catalog

    for r in catalog.search_titles(catalog.read_titles(spark, a.source), a.query, a.limit or 25).toLocalIterator():
        print(r.name, r.shard, r.idx, sep="\t")


def corpora(spark, a) -> None:
    from .operators import catalog

    catalog.corpora(spark, catalog.load_registry(a.source)).show(truncate=False)


def from_warc(spark, a) -> None:
    from .sources import archive, folders, warc

    pages = warc.html_responses(warc.read_warc(spark, a.source))
    if pages.isEmpty():
        raise ValueError(f"no HTML responses in {a.source}")
    _write(archive, folders.with_index(pages, "file", "record_no"), "body", a)


def to_warc(spark, a) -> None:
    from datetime import UTC, datetime

    from .functions import html as H
    from .sources import archive, warc

    docs = archive.read_archive(spark, a.source, **_options(a)).select("doc_idx", H.decode_html("encoded").alias("html"))
    warc.write_warc(warc.documents_to_records(docs, datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")), a.target)


def warc_encode(spark, a) -> None:
    from .sources import warc

    warc.write_warc(warc.encode_records(warc.read_warc(spark, a.source)), a.target)


def warc_decode(spark, a) -> None:
    from .sources import warc

    warc.write_warc(warc.decode_records(warc.read_warc(spark, a.source)), a.target)


def train(spark, a) -> None:
    from .functions import html as H
    from .operators import metrics
    from .sources import folders

    made = metrics.train_dictionary(folders.read_folder(spark, a.source).select(H.encode_html("content").alias("encoded")), size=a.size)
    with open(a.target, "wb") as f:
        f.write(made)


def bench(spark, a) -> None:
    from .operators import metrics
    from .sources import folders

    metrics.compression_report(folders.read_folder(spark, a.source), "content").show(truncate=False)


def verify_receipt(spark, a) -> None:
    from .operators import merkle

    print(json.dumps(merkle.verify_bundle(a.source), indent=1))


def _options(a) -> dict:
    return {"dictionaryPath": a.dictionary} if getattr(a, "dictionary", None) else {}


COMMANDS = {
    "pack": pack, "unpack": unpack, "info": info, "get": get, "stream": stream, "search": search, "corpora": corpora, "from-warc": from_warc, "to-warc": to_warc,
    "warc-encode": warc_encode, "warc-decode": warc_decode, "train": train, "bench": bench, "verify-receipt": verify_receipt,
}
_TWO = {"pack", "unpack", "from-warc", "to-warc", "warc-encode", "warc-decode", "train"}


def main(args: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("source")
        if name in _TWO:
            p.add_argument("target")
        if name == "get":
            p.add_argument("index")
            p.add_argument("--registry")
            p.add_argument("--kept", default=os.path.expanduser("~/.cache/leafmill"))
        if name == "search":
            p.add_argument("query")
        p.add_argument("--text", action="store_true")
        p.add_argument("--limit", type=int, default=0)
        p.add_argument("--size", type=int, default=1 << 20)
        p.add_argument("--dictionary")
    a = parser.parse_args(args)
    try:
        COMMANDS[a.command](spark or _session(), a)
    except BrokenPipeError:
        return 0
    except KeyboardInterrupt:
        return 130
    except (OSError, ValueError, LookupError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
