"""Document fingerprints: winnowing.

The *letters* of a text are its ASCII letters (folded to lower case), ASCII
digits and non-ASCII bytes. Each run of ``k`` letters has a rolling 64-bit hash;
of every ``w`` hashes in a row the least is chosen, the rightmost of equals. A
chosen hash is kept once, with the byte offset in the text of its first letter.

Guarantee: two texts that share ``w + k - 1`` letters (50 with the values set here)
share a fingerprint; no match shorter than ``k`` letters makes one, but that of two
whole texts.

Defined results, one row for each input row: a text of at least ``k`` letters
but too few for a window is one window of all its hashes; a shorter one has one
hash of all its letters; null and empty texts and those without letters have empty
lists; texts of any length are read whole; equal rows give equal rows; an empty
table gives none; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, WINDOW = 20, 31
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def chosen(buf: np.ndarray, offs: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice: hashes, byte offsets in their text, and how many each row has."""
    at = np.flatnonzero(C.WORD[buf])
    n = len(offs) - 1
    first = np.searchsorted(at, offs)
    h = C.gram_hashes(_FOLD[buf[at]].astype(np.uint64) + np.uint64(1), k)
    grams = np.maximum(np.diff(first) - k + 1, 0)
    pick = C.sliding_argmin(h, w)
    starts = np.repeat(first[:-1], np.maximum(grams - w + 1, 0))
    size = np.maximum(grams - w + 1, 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = pick[starts + step]  # the windows that lie within one text
    if len(own):
        own = own[np.r_[True, own[1:] != own[:-1]]]
    few = np.flatnonzero((grams > 0) & (grams < w))
    if len(few):
        extra = [first[r] + grams[r] - 1 - int(h[first[r] : first[r] + grams[r]][::-1].argmin()) for r in few]
        own = np.sort(np.r_[own, np.array(extra, np.int64)])
    row = np.searchsorted(first, own, "right") - 1
    value = h[own]
    brief = np.flatnonzero((np.diff(first) > 0) & (grams == 0))
    if len(brief):
        value = np.r_[value, C.span_hashes(_FOLD[buf[at]], first[brief], first[brief + 1])]
        own, row = np.r_[own, first[brief]], np.r_[row, brief]
        o = np.argsort(row, kind="stable")
        value, own, row = value[o], own[o], row[o]
    return value, at[own] - offs[row], np.bincount(row, minlength=n)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` for every row."""
    C.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                h, pos, count = chosen(s.buf, s.offs, k, w)
                yield pa.record_batch([s.rows.column("doc_id"), C.list_column(h.view(np.int64), count, pa.int64()), C.list_column(pos.astype(np.int32), count, pa.int32())], ["doc_id", "hashes", "positions"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, hashes array<long>, positions array<int>")
