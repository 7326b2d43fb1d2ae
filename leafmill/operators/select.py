"""Picking documents by index, slice, range or position in a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get(docs: DataFrame, index: int, count: int | None = None, column: str = "doc_idx") -> DataFrame:
    """The document at ``index``; a negative one counts from the end. An error where there is none."""
    if index < 0:
        count = docs.count() if count is None else count
        index += count
    found = docs.where(F.col(column) == index)
    if index < 0 or found.isEmpty():
        raise IndexError(f"no document at {index}")
    return found


def slice_docs(docs: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, column: str = "doc_idx", count: int | None = None) -> DataFrame:
    """The documents of a Python slice; a negative step gives them in descending order."""
    if step == 0:
        raise ValueError("a slice has no step 0")
    ready = (step or 1) > 0 and (start or 0) >= 0 and (stop is None or stop >= 0)
    if ready:  # no need to know how many there are
        start, step, top = start or 0, step or 1, stop
        at = F.col(column)
        wanted = at >= start
        if top is not None:
            wanted &= at < top
        if step > 1:
            wanted &= (at - start) % step == 0
        return docs.where(wanted).orderBy(column)
    a, b, s = slice(start, stop, step).indices(docs.count() if count is None else count)
    at = F.col(column)
    if s > 0:
        return docs.where((at >= a) & (at < b) & ((at - a) % s == 0)).orderBy(column)
    return docs.where((at <= a) & (at > b) & ((F.lit(a) - at) % -s == 0)).orderBy(F.col(column).desc())


def first(docs: DataFrame, limit: int, column: str = "doc_idx") -> DataFrame:
    return docs.orderBy(column).limit(limit)


def spans(counts: DataFrame, order: str, count: str = "doc_count") -> DataFrame:
    """``counts`` with the half-open range ``lo, hi`` of global indexes of each row; for indexes of chunks or shards."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("hi", F.sum(count).over(w).cast("long")).withColumn("lo", F.col("hi") - F.col(count))


def locate(wanted: DataFrame, ranges: DataFrame, index: str = "doc_idx") -> DataFrame:
    """``wanted`` with the range that holds its index, and ``within``, the position there; others go.

    An as-of join by a sort on the index: both sides are cut into the same ranges of
    indexes, so it doesn't compare every index with every range.
    """
    r = ranges.where("hi > lo").withColumn("_cell", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright(F.col("hi") - 1, 16))))
    w = wanted.where(F.col(index) >= 0).withColumn("_cell", F.shiftright(F.col(index).cast("long"), 16))
    return w.join(r, "_cell").where((F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi"))).withColumn("within", (F.col(index) - F.col("lo")).cast("long")).drop("_cell")
