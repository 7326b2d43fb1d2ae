"""License scans: ordered signature rules behind a keyword prefilter.

One pass of an Aho-Corasick automaton over the lower-case text says which
keywords occur; only the rules all of whose keywords do are matched. Matches that
lie within a match of higher rank go: rank is by priority, then by length, then
by the order of the rules. Of equal intervals the one of highest rank stays;
matches that merely overlap all stay.

Offsets are in characters, the end exclusive. Letters match without regard to
case, in ASCII only. Defined results: null and empty texts, and those without a
match, give no rows; texts are matched whole, whatever their length, in linear
time however long the blanks in them; equal rows give equal rows; an empty table gives none; extra columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_rules import RULES


class Rule(NamedTuple):
    number: int
    license: str
    priority: int
    keywords: tuple[tuple[str, ...], ...]  # all of them, each with its alternatives
    pattern: re.Pattern


#: What a space in a pattern stands for: white space, across line ends also comment marks.
#: A gap is taken whole and never given back, so it is read in linear time also where gaps meet.
_GAP = r"(?>(?:[ \t]++|\r?\n(?:[ \t]*+(?://+|#+|\*+|--|;+|%+|>))?)+)"


def parse(lines: str) -> list[Rule]:
    out = []
    for line in lines.strip().splitlines():
        name, priority, keywords, pattern = line.split(" | ", 3)
        pattern = re.sub(r"(\[[^\]]*\])|( +)(\?)?", lambda m: m[1] or (f"(?:{_GAP})?" if m[3] else _GAP), pattern)
        words = tuple(tuple(k.split("|")) for k in keywords.split())
        out.append(Rule(len(out), name, int(priority), words, re.compile(pattern, re.I | re.A)))
    return out


@lru_cache(1)
def _machine():
    rules = parse(RULES)
    words = sorted({k for r in rules for alternatives in r.keywords for k in alternatives})
    number = {k: i for i, k in enumerate(words)}
    auto = ahocorasick.Automaton()
    for k, i in number.items():
        auto.add_word(k, i)
    auto.make_automaton()
    gates = [[sum(1 << number[k] for k in alternatives) for alternatives in r.keywords] for r in rules]

    return rules, auto, gates


_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drops what lies within a match of higher rank; in order of start, end and rule.

    A Fenwick tree over the starts holds the largest end of what is kept so far.
    """
    starts = sorted({m[0] for m in found})
    reach = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for m in sorted(found, key=lambda m: (-m[2].priority, m[0] - m[1], m[2].number, m[0])):
        at = i = bisect_right(starts, m[0])
        far = 0
        while i:
            far = max(far, reach[i])
            i &= i - 1
        if far < m[1]:
            kept.append(m)
            while at < len(reach):
                reach[at] = max(reach[at], m[1])
                at += at & -at
    return sorted(kept, key=lambda m: (m[0], m[1], m[2].number))


def scan(text: str) -> list[tuple[int, int, Rule]]:
    rules, auto, gates = _machine()
    seen = 0
    for _, i in auto.iter(text.translate(_UPPER) if not text.isascii() else text.lower()):
        seen |= 1 << i
    if not seen:
        return []
    found = []
    for rule, gate in zip(rules, gates):
        if all(seen & g for g in gate):
            found.extend((m.start(), m.end(), rule) for m in rule.pattern.finditer(text))
    return suppress(found) if found else []


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, license, rule, priority, start, end``: every detection that stays."""
    C.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                if text:
                    out.extend((doc_id, r.license, r.number, r.priority, a, b) for a, b, r in scan(text))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "license", "rule", "priority", "start", "end"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, license string, rule int, priority int, start int, end int")
