"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces at the start of a word
and one for the rest. Each node has a failure link, the node that stands for what
remains once the longest pieces before it are popped, and the precomputed number
of pieces popped on that link. So a word is read once, from left to right, and
only counts are added up: no piece is ever built. The distinct words of a slice
(told apart by their characters) are read side by side, a character of each a step.

A *word* is a run of characters other than white space and ASCII punctuation, or
a single ASCII punctuation mark. A word that greedy longest match can't cover
counts as one unknown token. Pieces of the model that begin with its space mark
start words; the others also continue them.

Defined results, one row for each input row: null and empty texts, and those of
white space only, have 0 tokens; words of any length are read whole; equal rows
give equal rows; an empty table gives none; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

_SPACES = [i for i in range(0x3001) if chr(i).isspace()]
_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum()]
_KIND = np.zeros(0x110000, np.uint8)  # 0: part of a word, 1: space, 2: a word of its own
_KIND[_SPACES] = 1
_KIND[_PUNCT] = 2


def vocabulary(path: str = P.MODEL) -> tuple[list[str], list[str]]:
    """The pieces that start words, and those that go on."""
    names = P.load(path).pieces
    rest = [p for p in names if P.SPACE not in p]
    return sorted({p[1:] for p in names if p[0] == P.SPACE and len(p) > 1 and P.SPACE not in p[1:]} | {p for p in rest if len(p) == 1}), rest


#: Words of up to so many characters are read side by side, longer ones each for itself.
SIDE_BY_SIDE = 64


class Automaton:
    """``go[(node, character)]``; ``link[node]`` (-1: none) and ``popped[node]``; nodes 0 and 1 are the roots."""

    def __init__(self, initial: list[str], rest: list[str]):
        go, final, depth_first = {}, {}, deque()
        n = 2
        parent = [(0, ""), (1, "")]
        for root, names in ((0, initial), (1, rest)):
            for name in names:
                u = root
                for c in name:
                    v = go.get((u, c))
                    if v is None:
                        v = go[u, c] = n
                        parent.append((u, c))
                        n += 1
                    u = v
                final[u] = True
        kids: list[list[int]] = [[] for _ in range(n)]
        for (u, _), v in go.items():
            kids[u].append(v)
        link, popped = [-1] * n, [0] * n
        depth_first.extend([0, 1])
        while depth_first:
            u = depth_first.popleft()
            depth_first.extend(kids[u])
            if u < 2:
                continue
            if u in final:
                link[u], popped[u] = 1, 1
                continue
            p, c = parent[u]
            z, count = link[p], popped[p]
            while z >= 0 and (z, c) not in go:
                count += popped[z]
                z = link[z]
            if z >= 0:
                link[u], popped[u] = go[z, c], count
        self.go, self.link, self.popped = go, link, popped
        # the same as arrays: edges sorted by node and character
        edges = np.array([(u << 21 | ord(c), v) for (u, c), v in go.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.edge, self.to = np.r_[edges[:, 0], 1 << 62], np.r_[edges[:, 1], 0]
        self.links, self.pops = np.array(link), np.array(popped)

    def count(self, word: str) -> int:
        """Pieces of greedy longest match; 1 where it can't cover the word."""
        go, link, popped, u, total = self.go, self.link, self.popped, 0, 0
        for c in word:
            v = go.get((u, c))
            while v is None:
                total += popped[u]
                u = link[u]
                if u < 0:
                    return 1
                v = go.get((u, c))
            u = v
        while u > 1:
            total += popped[u]
            u = link[u]
        return total if u == 1 else 1

    def count_all(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """``count`` of each word of words laid end to end: a step reads one character of every word."""
        size = np.diff(offs)
        out = np.ones(len(size), np.int64)
        for i in np.flatnonzero(size > SIDE_BY_SIDE):
            out[i] = self.count(cps[offs[i] : offs[i + 1]].tobytes().decode("utf-32-le", "surrogatepass"))
        short = np.flatnonzero((size <= SIDE_BY_SIDE) & (size > 0))
        if not len(short):
            return out
        who = short[np.argsort(-size[short], kind="stable")]
        first, live = offs[who], np.searchsorted(-size[who], -np.arange(1, size[who[0]] + 1), "right")
        node, total = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        for i, n in enumerate(live):
            at = np.flatnonzero(node[:n] >= 0)
            c = cps[first[at] + i].astype(np.int64)
            while len(at):
                key = node[at] << 21 | c
                e = np.searchsorted(self.edge, key)
                hit = self.edge[e] == key
                node[at[hit]] = self.to[e[hit]]
                at, c = at[~hit], c[~hit]
                total[at] += self.pops[node[at]]
                node[at] = self.links[node[at]]
                on = node[at] >= 0
                at, c = at[on], c[on]
        while len(at := np.flatnonzero(node > 1)):
            total[at] += self.pops[node[at]]
            node[at] = self.links[node[at]]
        out[who] = np.where(node == 1, total, 1)
        return out


def word_spans(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end."""
    kind = _KIND[cps]
    inside = kind == 0
    cut = np.ones(len(cps) + 1, bool)
    cut[1:-1] = ~(inside[1:] & inside[:-1])
    cut[offs] = True
    start = np.flatnonzero(cut[:-1] & (kind != 1))
    end = np.flatnonzero(cut[1:] & (kind != 1)) + 1
    return start, end


_machines: dict = {}


def counter(initial: list[str], rest: list[str]):
    """A function from texts to their numbers of tokens; a process keeps the automaton for the next batch."""
    name = hashlib.sha256("\n".join([*initial, "", *rest]).encode()).digest()

    def run(texts: list[str]) -> np.ndarray:
        if name not in _machines:
            _machines.clear()
            _machines[name] = Automaton(initial, rest)
        cps = P.code_points("".join(texts))
        offs = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        start, end = word_spans(cps, offs)
        if not len(start):
            return np.zeros(len(texts), np.int64)
        words = P.distinct(cps, np.stack((start, end), 1).ravel(), 2)
        total = np.r_[0, np.cumsum(_machines[name].count_all(words.cps, words.offs)[words.which])]
        first = np.searchsorted(start, offs)
        return total[first[1:]] - total[first[:-1]]

    return run


def slice_texts(s: C.Slice, col: str = "text") -> list[str]:
    return [t or "" for t in s.rows.column(s.rows.schema.get_field_index(col)).to_pylist()]


def token_counts(docs: DataFrame, path: str = P.MODEL) -> DataFrame:
    """``doc_id, n_tokens`` for every row."""
    C.prepare(docs.sparkSession)
    count = counter(*vocabulary(path))

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                yield pa.record_batch([s.rows.column("doc_id"), pa.array(count(slice_texts(s)))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
