"""Folders of HTML files, numbered by path; and documents as files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .files import local


def with_index(df: DataFrame, *order: str, name: str = "doc_idx") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order without sorting all rows in one task.

    Rows are sorted into ranges, which are written once, so that both uses see the
    same ones; the sizes of the ranges, one row each, give every range its offset.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged).withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", offset.alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_at")).cast("bigint").alias(name), *df.columns)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """``doc_idx, path, content`` of the files below a folder, in path order; an error where there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {path}")
    return with_index(files.select("path", "content"), "path")


def write_files(docs: DataFrame, path: str, column: str = "html", suffix: str = ".html") -> None:
    """A file ``doc_<index of six digits>`` for each row of ``doc_idx`` and ``column``, in a folder all executors share."""
    folder = local(path)
    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for r in rows:
            value = r[column] or ""
            name = os.path.join(folder, f"doc_{r['doc_idx']:06d}{suffix}")
            with open(f"{name}.{os.getpid()}.new", "wb") as f:
                f.write(value if isinstance(value, (bytes, bytearray)) else value.encode())
            os.replace(f.name, name)  # a task that runs twice leaves one whole file

    docs.select("doc_idx", column).foreachPartition(write)


def file_name(index: int, suffix: str = ".html") -> str:
    return f"doc_{index:06d}{suffix}"


INDEXED = re.compile(r"doc_(\d{6,})\.\w+$")
