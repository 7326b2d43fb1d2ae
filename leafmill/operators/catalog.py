"""Named corpora, their titles, and how a name leads to a document.

A corpus is a row ``name, base, shards, shard_docs, titles, title, docs, snapshot,
license``; a title list has lines ``name <tab> shard <tab> index``.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..sources.files import exists, is_url, join, read_all, replace
from ..sources.folders import with_index

CORPUS_DDL = "name string, base string, shards array<string>, shard_docs array<bigint>, titles string, title string, docs bigint, snapshot string, license string"
KEPT_SECONDS = 3600
#: Indexes in a cell of the join of indexes with shards, as a power of two.
CELL = 16


def load_registry(address: str, cache: str | None = None) -> dict:
    """The registry; a copy in ``cache`` serves for an hour, and beyond where fetching fails."""
    if cache and os.path.exists(cache) and time.time() - os.path.getmtime(cache) < KEPT_SECONDS:
        address, cache = cache, None
    try:
        data = read_all(address)
    except OSError:
        if not cache or not os.path.exists(cache):
            raise
        return json.loads(read_all(cache))
    if cache:
        replace(cache, data)
    return json.loads(data)


def corpora(spark: SparkSession, registry: dict) -> DataFrame:
    rows = [tuple([name, *(c.get(k) for k in ("base", "shards", "shard_docs", "titles", "title", "docs", "snapshot", "license"))]) for name, c in sorted(registry.items())]
    return spark.createDataFrame(rows, CORPUS_DDL)


def parse_titles(lines: DataFrame) -> DataFrame:
    """``line_no, name, shard, idx`` of ``line_no, value``; the last two tabs divide, lines without them go."""
    parts = F.split("value", "\t")
    n = F.size(parts)
    return lines.where(n >= 3).select("line_no", F.array_join(F.slice(parts, F.lit(1), n - 2), "\t").alias("name"), F.try_element_at(parts, n - 1).try_cast("int").alias("shard"), F.try_element_at(parts, n).try_cast("bigint").alias("idx"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """A title file, plain or gzip, numbered in the order of its lines, which are read one by one and in parallel splits where it is plain."""
    at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}  # which ascends within a split
    lines = spark.read.text(path).select("value", *(c.alias(n) for n, c in at.items())).where("value <> ''")
    numbered = with_index(lines.withColumn("value", F.regexp_replace("value", "\r$", "")), *at, name="line_no")
    return parse_titles(numbered)


def fetch_titles(registry: dict, corpus: str, folder: str) -> str:
    """The place of a corpus's title file: fetched once into ``folder``, and kept without end."""
    entry = registry[corpus]
    kept = join(folder, f"titles-{corpus}.tsv.gz")
    if not exists(kept):
        replace(kept, read_all(f"{entry['base'].rstrip('/')}/{entry['titles']}"))
    return kept


def resolve(spark: SparkSession, registry: dict, corpus: str, ref: str, folder: str) -> tuple[str, int]:
    """The shard's address and the place in it of a document of a corpus, given by a global index or by its title."""
    if corpus not in registry:
        raise KeyError(f"{corpus} is no corpus of the registry")
    shards = resolve_sources(corpus, registry)
    if re.fullmatch(r"-?\d+", ref.strip()):
        wanted = spark.createDataFrame([(corpus, int(ref))], "name string, idx long")
        row = resolve_indexes(wanted, corpora(spark, {corpus: registry[corpus]})).select("shard", F.col("within").alias("idx")).first()
    else:
        titles = read_titles(spark, fetch_titles(registry, corpus, folder))
        row = lookup_titles(titles, spark.createDataFrame([(ref.strip(),)], "query string")).select("shard", "idx").first()
    if row is None:
        raise IndexError(f"{corpus} has no document {ref}")
    return shards[row.shard], row.idx


def search_titles(titles: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """The first ``limit`` titles, in the order of the list, that contain the query."""
    return titles.where(F.contains(F.lower("name"), norm_title(F.lit(query)))).orderBy("line_no").limit(limit)


def lookup_titles(titles: DataFrame, wanted: DataFrame, query: str = "query") -> DataFrame:
    """For each query its title: equal, else equal but for case, else when normalised; of several the first in the list."""
    w = wanted.select(query).distinct()
    t = titles.select("line_no", "name", "shard", "idx")
    hits = w.join(t, norm_title(query) == norm_title("name"))
    loose = w.join(t, F.lower(query) == F.lower("name"))
    rank = F.when(F.col(query) == F.col("name"), 0).when(F.lower(query) == F.lower("name"), 1).otherwise(2)
    order = Window.partitionBy(query).orderBy("match_class", "line_no")
    both = hits.unionByName(loose).withColumn("match_class", rank)
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve_indexes(wanted: DataFrame, corpus: DataFrame, index: str = "idx") -> DataFrame:
    """``wanted`` (``name`` of the corpus and a global index) with ``shard`` and ``within``.

    Corpora without counts have all in shard 0, and so have negative indexes.
    """
    c = corpus.select("name", "shard_docs")
    s = c.select("name", F.posexplode_outer("shard_docs").alias("shard", "_n"))
    w = Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_hi", F.sum("_n").over(w)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    # both sides meet in the same cells of indexes, so an index isn't tried with every shard of its corpus
    cells = F.sequence(F.shiftright("_lo", CELL), F.shiftright(F.col("_hi") - 1, CELL))
    ranges = s.where("_n > 0").withColumn("_cell", F.explode(cells)).select("name", "shard", "_lo", "_hi", "_cell")
    # without counts, or before the start, all is in shard 0
    lone = c.select("name", F.lit(0).alias("shard"), F.lit(None).cast("bigint").alias("_lo"), F.lit(None).cast("bigint").alias("_hi"), F.explode(F.when(F.coalesce(F.size("shard_docs"), F.lit(0)) > 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(-1), F.lit(-2)))).alias("_cell"))
    counted = c.select("name", (F.coalesce(F.size("shard_docs"), F.lit(0)) > 0).alias("_counted"))
    at = F.col(index).cast("bigint")
    ready = wanted.join(counted, "name").withColumn("_cell", F.when(at < 0, F.lit(-1)).when(~F.col("_counted"), F.lit(-2)).otherwise(F.shiftright(at, CELL)).cast("bigint"))
    joined = ready.join(ranges.unionByName(lone), ["name", "_cell"]).where(F.col("_lo").isNull() | ((at >= F.col("_lo")) & (at < F.col("_hi"))))
    return joined.select(*wanted.columns, F.col("shard").cast("int").alias("shard"), (at - F.coalesce("_lo", F.lit(0))).cast("long").alias("within"))


def resolve_sources(source: str, registry: dict | None = None) -> list[str]:
    """A file or address as it is; the name of a corpus as the addresses of all its shards."""
    if is_url(source) or exists(source):
        return [source]
    c = (registry or {}).get(source)
    if c is None:
        raise KeyError(f"{source} is neither a file, an address nor a corpus")
    base = c.get("base")
    return [join(base, s) if base and not is_url(s) else s for s in c["shards"]]
