"""External induced suffix sorting with common-prefix values.

``suffix_array`` sorts the suffixes of an integer string by recursive induction:
the leftmost-S (LMS) substrings are sorted and named, the string of names is
sorted the same way, and its order induces all L-type suffixes by an ascending
scan and all S-type suffixes by a descending one. Each scan pops (symbol,
position, common prefix) tuples from a priority queue on disk in symbol order
and pushes the tuples of the preceding suffixes.

Two facts make the scan work on whole windows of buckets. Tuples of one symbol
leave the queue in the order in which they came in, so the queue is a radix of
symbol ranges, appended to and read back one after the other. And a window whose
pushes all lead beyond it can be handled at once; it is cut before the first
symbol that one of its own members leads to.

Common prefixes are carried along: two suffixes pushed one after the other to a
bucket from one bucket agree in 1 + the least value between their sources, and
from different buckets in just 1 symbol. Values are capped at ``cap``.

A string of more than ``in_memory`` symbols has its arrays in files of the
folder ``spill``, mapped into memory, and so have all levels of its recursion.
"""

from __future__ import annotations

import os
import shutil
import uuid
from typing import NamedTuple

import numpy as np


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    out[:-1] = starts[1:] - starts[:-1]
    out[-1:] = n - starts[-1:]
    return out


class Store:
    """Arrays in memory, or in files once they are large."""

    def __init__(self, spill: str | None, in_memory: int):
        self.folder = os.path.join(spill, f"induced-{uuid.uuid4().hex}") if spill else None
        self.in_memory, self.made = in_memory, 0

    def external(self, n: int) -> bool:
        return self.folder is not None and n > self.in_memory

    def path(self) -> str:
        os.makedirs(self.folder, exist_ok=True)
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def empty(self, n: int, kind) -> np.ndarray:
        return np.memmap(self.path(), kind, "w+", shape=(n,)) if self.external(n) else np.empty(n, kind)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


#: The largest cap of common prefixes; symbols that a pass handles at once.
MOST, BLOCK = 250, 1 << 18
_TUPLE = np.dtype([("sym", np.int32), ("pos", np.int32), ("lcp", np.uint8)])


class Queue:
    """Priority queue of tuples by symbol, first in first out within a symbol.

    ``counts`` says how many tuples each symbol will get. Ranges of symbols of
    about equal weight have a run each, in a file where the store is external;
    the range being popped is laid out in memory by symbol.
    """

    def __init__(self, counts: np.ndarray, store: Store, ascending: bool, ranges: int = 64, least: int = 1 << 17):
        self.total = _sums(counts, store)
        self.sign, self.store, n = (1 if ascending else -1), store, int(self.total[-1])
        grain = max(1, -(-n // ranges), min(least, store.in_memory // 8))
        self.bounds = np.unique(np.r_[0, np.searchsorted(self.total, np.arange(0, n + grain, grain)).clip(0, len(counts)), len(counts)])  # range r: symbols bounds[r] to bounds[r + 1] - 1
        self.runs: list[list] = [[] for _ in self.bounds]
        self.kept = [0] * len(self.runs)
        self.current, self.pos, self.lcp, self.fill, self.base = -1, None, None, None, 0
        self.external = store.external(n)
        self.files: dict[int, str] = {}

    def _place(self, sym, pos, lcp) -> None:
        """Puts tuples sorted by symbol behind those that their symbols already have."""
        if not len(sym):
            return
        new = _starts(sym)
        size = _sizes(new, len(sym))
        own = sym[new] - self.low
        at = np.arange(len(sym)) + np.repeat(self.total[sym[new]] - self.base + self.fill[own] - new, size)
        self.fill[own] += size
        self.pos[at], self.lcp[at] = pos, lcp

    def enter(self, r: int) -> None:
        self.current, self.low, high = r, int(self.bounds[r]), int(self.bounds[r + 1])
        self.base = int(self.total[self.low])
        size = int(self.total[high]) - self.base
        self.pos, self.lcp, self.fill = np.empty(size, np.int32), np.empty(size, np.uint8), np.zeros(high - self.low, np.int64)
        parts = self.runs[r]
        if r in self.files:
            x = np.fromfile(self.files[r], _TUPLE)
            parts = [(x["sym"], x["pos"], x["lcp"]), *parts]
            os.unlink(self.files.pop(r))
        if parts:
            sym, pos, lcp = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(sym, kind="stable")
            self._place(sym[o], pos[o], lcp[o])
        self.runs[r] = []

    def push(self, sym, pos, lcp) -> None:
        """Takes tuples sorted by symbol (stable in the order of their sources)."""
        r = np.searchsorted(self.bounds, sym[[0, -1]], "right") - 1
        if r[0] == r[1] == self.current:
            self._place(sym, pos, lcp)
            return
        cuts = np.searchsorted(sym, self.bounds[r[0] + 1 : r[1] + 1])
        edges = [0, *cuts.tolist(), len(sym)]
        for k, a, b in zip(range(r[0], r[1] + 1), edges, edges[1:]):
            if a == b:
                continue
            if k == self.current:
                self._place(sym[a:b], pos[a:b], lcp[a:b])
                continue
            self.runs[k].append((sym[a:b], pos[a:b], lcp[a:b]))
            self.kept[k] += b - a
            if self.external and self.kept[k] > min(1 << 16, self.store.in_memory // 64):
                if k not in self.files:
                    self.files[k] = self.store.path()
                x = np.empty(self.kept[k], _TUPLE)
                x["sym"], x["pos"], x["lcp"] = (np.concatenate(y) for y in zip(*self.runs[k]))
                with open(self.files[k], "ab") as f:
                    x.tofile(f)
                self.runs[k], self.kept[k] = [], 0

    def pop(self, first: int, last: int):
        """Positions and values of the symbols first..last, ascending; values are against the one pushed before."""
        if first < self.low or first >= self.bounds[self.current + 1]:
            self.enter(int(np.searchsorted(self.bounds, first, "right")) - 1)
        a, b = int(self.total[first]) - self.base, int(self.total[last + 1]) - self.base
        return self.pos[a:b], self.lcp[a:b]

    low = 1 << 60


def _sums(counts: np.ndarray, store: Store) -> np.ndarray:
    """0 and the running sums of ``counts``."""
    out, base = store.empty(len(counts) + 1, np.int64), 0
    out[0] = 0
    for lo in range(0, len(counts), BLOCK):
        part = np.cumsum(counts[lo : lo + BLOCK]) + base
        out[lo + 1 : lo + 1 + len(part)] = part
        base = int(part[-1])
    return out


class Sorted(NamedTuple):
    order: np.ndarray  # positions of the suffixes, ascending
    lcp: np.ndarray  # of each with the one before, capped


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a..b]) for each pair, a <= b."""
    size = b - a + 1
    out = np.empty(len(a), np.uint8)
    level, k = values, 0
    log = np.frexp(size.astype(float))[1] - 1
    for k in range(int(log.max()) + 1):
        if k:
            half = 1 << (k - 1)
            level = np.minimum(level[:-half], level[half:])
        q = np.flatnonzero(log == k)
        if len(q):
            out[q] = np.minimum(level[a[q]], level[b[q] - (1 << k) + 1])
    return out


def _push_values(at: np.ndarray, sym: np.ndarray, src: np.ndarray, lcp: np.ndarray, cap: int) -> np.ndarray:
    """Values of pushes sorted by target ``sym`` from window members ``at`` of the symbols ``src``."""
    out = np.ones(len(at), np.uint8)
    k = np.flatnonzero((sym[1:] == sym[:-1]) & (src[1:] == src[:-1]))
    if len(k):
        out[k + 1] = np.minimum(_range_min(lcp, at[k] + 1, at[k + 1]).astype(np.int64) + 1, cap)
    return out


def _scan(t, is_s, run, back, counts, static, ascending: bool, cap: int, store: Store, emit) -> None:
    """One induction scan. static: (positions, values, end of each symbol's part), sorted as the scan goes.

    In a bucket, what the queue gives comes before what ``static`` has.
    """
    nsym = len(counts[0])
    flip = (lambda s: s) if ascending else (lambda s: nsym - 1 - s)
    dyn = counts[0] if ascending else counts[0][::-1]
    sta = counts[1] if ascending else counts[1][::-1]
    q = Queue(dyn, store, ascending)
    s_pos, s_lcp = static
    s_start = _sums(sta, store)
    mass = store.empty(nsym + 1, np.int64)
    for lo in range(0, nsym + 1, BLOCK):
        mass[lo : lo + BLOCK] = q.total[lo : lo + BLOCK] + s_start[lo : lo + BLOCK]
    n = int(mass[-1])
    goal, c = max(1024, int(n**0.5)), 0

    def pushes(pos):
        """Indices of members whose preceding suffix is of the induced type, and its (scan) symbol."""
        k = np.flatnonzero(pos > 0)
        before = t[pos[k] - 1]
        own = t[pos[k]]
        good = before >= own if ascending else (before < own) | ((before == own) & is_s[pos[k]])
        k = k[good]
        return k, flip(before[good].astype(np.int64))

    def bucket(sym: int):
        """All members of one bucket, also those that others of it lead to.

        What the queue has stands before another symbol; run members before it
        follow in rounds, each in the same order and one symbol longer.
        """
        pos, lcp = q.pop(sym, sym)
        if len(pos):
            lcp = lcp.copy()
            lcp[0] = 0
            more = back[pos]
            if more.any():
                size = more.astype(np.int64) + 1
                who = np.repeat(np.arange(len(pos)), size)
                step = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
                o = np.argsort(step, kind="stable")
                who, step = who[o], step[o]
                value = np.minimum(step, cap)
                k = np.flatnonzero(step[1:] == step[:-1])
                value[k + 1] = np.minimum(step[k] + _range_min(lcp, who[k] + 1, who[k + 1]), cap) if len(k) else 0
                pos, lcp = pos[who] - step.astype(np.int32), value.astype(np.uint8)
        a, b = s_start[sym], s_start[sym + 1]
        if b > a:
            v = s_lcp[a:b].copy()
            v[0] = min(cap, int(run[pos[-1]]), int(run[s_pos[a]])) if len(pos) else 0
            pos, lcp = np.concatenate((pos, s_pos[a:b])), np.concatenate((lcp, v))
        return pos, lcp

    while c < nsym:
        if mass[c] == mass[-1]:
            break
        top = int(q.bounds[min(np.searchsorted(q.bounds, c, "right"), len(q.bounds) - 1)])  # a window stays in its range
        last = max(c, min(top, int(np.searchsorted(mass, mass[c] + goal, "right")) - 1) - 1)
        p, v = q.pop(c, last)
        a, b = int(s_start[c]), int(s_start[last + 1])
        single = last == c
        if not single:
            # merge the queue's and the static members, symbol by symbol
            span = np.arange(c, last + 1)
            nd, ns = q.total[span + 1] - q.total[span], s_start[span + 1] - s_start[span]
            # members that aren't there yet come from within the window: a conflict
            ready = q.fill[span - q.low] == nd
            if not ready.all():
                cutoff = c + int(np.flatnonzero(~ready)[0])
            else:
                cutoff = last + 1
            if cutoff > c + 1:
                cut = cutoff - c
                nd, ns, span = nd[:cut], ns[:cut], span[:cut]
                p, v = p[: nd.sum()], v[: nd.sum()]
                b = a + int(ns.sum())
                size = nd + ns
                first = np.cumsum(size) - size
                pos, lcp = np.empty(size.sum(), np.int32), np.empty(size.sum(), np.uint8)
                kind = np.arange(len(pos)) - np.repeat(first, size) >= np.repeat(nd, size)
                pos[~kind], lcp[~kind] = p, v
                pos[kind], lcp[kind] = s_pos[a:b], s_lcp[a:b]
                edge = np.flatnonzero((nd > 0) & (ns > 0))  # between the two types: the shorter run of the symbol
                e = first[edge] + nd[edge]
                lcp[e] = np.minimum(cap, np.minimum(run[pos[e]], run[pos[e - 1]]))
                lcp[first[size > 0]] = 0
                sym = np.repeat(span, size)
                k, tgt = pushes(pos)
                inner = tgt < cutoff
                if inner.any():
                    stop = int(tgt[inner].min())
                    cutoff = stop
                    keep = sym < stop
                    goal = max(256, goal * 3 // 4)
                    if stop > c:
                        m = int(keep.sum())
                        pos, lcp, sym = pos[:m], lcp[:m], sym[:m]
                        inside = k < m
                        k, tgt = k[inside], tgt[inside]
                else:
                    goal = min(goal + goal // 8, n + 1024)
                if cutoff > c:
                    if len(k):
                        o = np.argsort(tgt, kind="stable")
                        k, tgt = k[o], tgt[o]
                        q.push(tgt, pos[k] - np.int32(1), _push_values(k, tgt, sym[k], lcp, cap))
                    emit(pos, lcp, sym)
                    c = cutoff
                    continue
        pos, lcp = bucket(c)
        if len(pos):
            k, tgt = pushes(pos)
            beyond = tgt != c
            k, tgt = k[beyond], tgt[beyond]
            if len(k):
                o = np.argsort(tgt, kind="stable")
                k, tgt = k[o], tgt[o]
                q.push(tgt, pos[k] - np.int32(1), _push_values(k, tgt, np.full(len(k), c), lcp, cap))
            emit(pos, lcp, np.full(len(pos), c))
        c += 1


def _types(t: np.ndarray, store: Store):
    """S-type flags; the length of the run of its symbol from each position, capped at 255; and how much of it lies before."""
    n = len(t)
    is_s, run, back = store.empty(n, bool), store.empty(n, np.uint8), store.empty(n, np.int32)
    start, step = 0, BLOCK
    for lo in range(0, n, step):
        x = np.asarray(t[max(lo - 1, 0) : min(n, lo + step)])
        new = np.flatnonzero(x[1:] != x[:-1]) + max(lo, 1)
        begin = np.full(min(n, lo + step) - lo, -1, np.int64)
        begin[new - lo] = new
        begin[0] = start if begin[0] < 0 else begin[0]
        begin = np.maximum.accumulate(begin)
        back[lo : lo + len(begin)] = np.arange(lo, lo + len(begin)) - begin
        start = int(begin[-1])
    ahead, ahead_run = True, 0
    for lo in range((n - 1) // step * step, -1, -step):
        hi = min(n, lo + step)
        x = np.asarray(t[lo : min(n, hi + 1)]).astype(np.int64)
        if hi == n:
            x = np.r_[x, -1]  # the end sorts before all; the last symbol counts as S by convention
        d = np.sign(x[1:] - x[:-1])
        idx = np.where(d != 0, np.arange(len(d)), len(d))
        nxt = np.minimum.accumulate(idx[::-1])[::-1]
        up = np.r_[d > 0, ahead][nxt]
        left = nxt - np.arange(len(d)) + 1
        left = np.where(nxt == len(d), left - 1 + ahead_run, left)
        if hi == n:
            up[-1] = True
            up[nxt == len(d) - 1] = False
            up[-1] = True
        is_s[lo:hi], run[lo:hi] = up, np.minimum(left, 255)
        ahead, ahead_run = bool(up[0]), int(min(left[0], 1 << 40))
    return is_s, run, back


def _counts(t, nsym: int, store: Store, keep) -> np.ndarray:
    """How often each symbol stands at positions that ``keep(lo, hi)`` flags."""
    out = store.empty(nsym, np.int64)
    for lo in range(0, nsym, BLOCK):
        out[lo : lo + BLOCK] = 0
    for lo in range(0, len(t), BLOCK):
        hi = min(len(t), lo + BLOCK)
        sym, n = np.unique(t[lo:hi][keep(lo, hi)], return_counts=True)
        out[sym] += n
    return out


def _leftmost(is_s, store: Store) -> np.ndarray:
    """Positions of the LMS suffixes."""
    n, parts, total = len(is_s), [], 0
    for lo in range(1, n, BLOCK):
        hi = min(n, lo + BLOCK)
        total += np.count_nonzero(is_s[lo:hi] & ~is_s[lo - 1 : hi - 1])
    out, at = store.empty(total, np.int32) if total else np.zeros(0, np.int32), 0
    for lo in range(1, n, BLOCK):
        hi = min(n, lo + BLOCK)
        parts = np.flatnonzero(is_s[lo:hi] & ~is_s[lo - 1 : hi - 1]) + lo
        out[at : at + len(parts)] = parts
        at += len(parts)
    return out


def _name_some(t, is_s, lms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names of the LMS substrings t[lms..ends], in their order, and their number; equal ones share a name."""
    m = len(lms)
    rank, active, off = np.zeros(m, np.int64), np.arange(m), 0
    while len(active):
        p, e = lms[active].astype(np.int64) + off, ends[active]
        key = np.zeros(len(active), np.uint64)
        for shift, at in ((np.uint64(32), p), (np.uint64(0), p + 1)):
            ok = at <= e
            where = np.minimum(at, e)
            sym = t[where].astype(np.uint64) * np.uint64(2) + is_s[where] + np.uint64(1)
            key |= np.where(ok, sym, np.uint64(0)) << shift
        r = rank[active]
        o = np.argsort(key, kind="stable") if off == 0 else np.lexsort((key, r))
        r, key, who = r[o], key[o], active[o]
        change = np.r_[True, (r[1:] != r[:-1]) | (key[1:] != key[:-1])]
        start = np.flatnonzero(change)
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(who)]))
        first_of_rank = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank_start = np.repeat(first_of_rank, np.diff(np.r_[first_of_rank, len(who)]))
        rank[who] = r + (start[group] - rank_start)
        size = np.diff(np.r_[start, len(who)])[group]
        going = (size > 1) & (lms[who] + off + 1 < ends[who])
        active, off = who[going], off + 2
    names, which = np.unique(rank, return_inverse=True)
    return which.astype(np.int32), len(names)


def _name(t, is_s, lms: np.ndarray, counts: np.ndarray, store: Store) -> tuple[np.ndarray, int]:
    """Names of all LMS substrings, a range of first symbols after the other, and their number."""
    m = len(lms)
    out, total = store.empty(m, np.int32), 0
    if store.external(len(t)):
        before = _sums(counts, store)
        grain = max(1, min(1 << 17, store.in_memory // 8))
        bounds = np.unique(np.r_[0, np.searchsorted(before, np.arange(0, m + grain, grain)).clip(0, len(counts)), len(counts)])
    else:
        bounds = np.array([0, len(counts)])
    if len(bounds) > 2:  # the substrings of each range, in the order of the text
        r_of = lambda a, b: np.searchsorted(bounds, t[lms[a:b]], "right") - 1
        size = np.zeros(len(bounds), np.int64)
        for a in range(0, m, BLOCK):
            size += np.bincount(r_of(a, min(m, a + BLOCK)), minlength=len(bounds))
        at, members = np.cumsum(size) - size, store.empty(m, np.int32)
        for a in range(0, m, BLOCK):
            r = r_of(a, min(m, a + BLOCK))
            o = np.argsort(r, kind="stable")
            new = _starts(r[o])
            n = _sizes(new, len(o))
            own = r[o][new]
            members[np.repeat(at[own] - new, n) + np.arange(len(o))] = a + o
            at[own] += n
        edges = np.r_[0, np.cumsum(size)]
    else:
        members, edges = None, np.array([0, m])
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        who = np.arange(a, b) if members is None else np.asarray(members[a:b]).astype(np.int64)
        names, n = _name_some(t, is_s, np.asarray(lms[who]), np.asarray(lms[np.minimum(who + 1, m - 1)]).astype(np.int64))
        out[who] = names + np.int32(total)
        total += n
    return out, total


def _prefixes(t, lms: np.ndarray, order: np.ndarray, values: np.ndarray, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The sorted LMS suffixes and the common prefix of each with the one before, from those of their names."""
    m, n = len(lms), len(t)
    pos, out = store.empty(m, np.int32), store.empty(m, np.uint8)
    edge = lambda i: np.where(i < m, lms[np.minimum(i, m - 1)], n - 1).astype(np.int64)
    for lo in range(0, m, BLOCK):
        hi = min(m, lo + BLOCK)
        b = np.asarray(order[lo:hi]).astype(np.int64)
        a = np.asarray(order[np.arange(lo - 1, hi - 1).clip(0)]).astype(np.int64)
        k = np.asarray(values[lo:hi]).astype(np.int64)
        x, y = edge(a), edge(b)
        pos[lo:hi] = y
        have = np.minimum(edge(np.minimum(a + k, m)) - x, cap)
        x, y = x + have, y + have
        live = np.flatnonzero(have < cap)
        while len(live):
            live = live[(x[live] < n) & (y[live] < n)]
            live = live[t[x[live]] == t[y[live]]]
            x[live] += 1
            y[live] += 1
            have[live] += 1
            live = live[have[live] < cap]
        if lo == 0:
            have[0] = 0
        out[lo:hi] = have
    return pos, out


def _sort(t: np.ndarray, nsym: int, cap: int, store: Store) -> Sorted:
    n = len(t)
    if n == 1:
        return Sorted(np.zeros(1, np.int32), np.zeros(1, np.uint8))
    is_s, run, back = _types(t, store)
    lms = _leftmost(is_s, store)
    m = len(lms)
    counts_s = _counts(t, nsym, store, lambda lo, hi: np.asarray(is_s[lo:hi]))
    counts_l = _counts(t, nsym, store, lambda lo, hi: ~np.asarray(is_s[lo:hi]))
    counts_lms = _counts(t, nsym, store, lambda lo, hi: np.asarray(is_s[lo:hi]) & ~np.r_[True, is_s[lo : hi - 1]] if lo == 0 else is_s[lo:hi] & ~is_s[lo - 1 : hi - 1])
    if m > 1:
        names, total = _name(t, is_s, lms, counts_lms, store)
        if total == m:
            order, values = store.empty(m, np.int32), store.empty(m, np.uint8)
            for lo in range(0, m, BLOCK):
                hi = min(m, lo + BLOCK)
                order[names[lo:hi]] = np.arange(lo, hi, dtype=np.int32)
                values[lo:hi] = 0
        else:
            order, values = _sort(names, total, cap, store)
        static = _prefixes(t, lms, order, values, cap, store)
        del names, order, values
    else:
        static = (lms, np.zeros(m, np.uint8))
    # the ends of runs come from the queue, what is before them from the bucket itself
    final = lambda lo, hi: np.r_[t[lo + 1 : hi + 1] != t[lo : min(hi, n - 1)], [True] * (hi == n)].astype(bool)
    led_s = _counts(t, nsym, store, lambda lo, hi: final(lo, hi) & is_s[lo:hi])
    led_l = _counts(t, nsym, store, lambda lo, hi: final(lo, hi) & ~is_s[lo:hi])
    of_l = sum(int(counts_l[lo : lo + BLOCK].sum()) for lo in range(0, nsym, BLOCK))
    l_pos, l_lcp = store.empty(max(1, of_l), np.int32), store.empty(max(1, of_l), np.uint8)
    at = 0

    def keep_l(pos, lcp, sym):
        nonlocal at
        mine = np.flatnonzero(~is_s[pos])
        # within a bucket the L-type members are next to each other, and first
        l_pos[at : at + len(mine)], l_lcp[at : at + len(mine)] = pos[mine], lcp[mine]
        at += len(mine)

    _scan(t, is_s, run, back, (led_l, counts_lms), static, True, cap, store, keep_l)
    assert at == of_l, (at, of_l)
    # the descending scan: a value belongs to a suffix and the next larger one
    down_pos = l_pos[:at][::-1]
    down_lcp = store.empty(at, np.uint8) if at else np.zeros(0, np.uint8)
    for lo in range(0, at, BLOCK):
        hi = min(at, lo + BLOCK)
        down_lcp[lo:hi] = l_lcp[at - hi + 1 : at - lo + 1][::-1] if lo else np.r_[np.uint8(0), l_lcp[at - hi + 1 : at][::-1]]
    out, lcp_out = store.empty(n, np.int32), store.empty(n + 1, np.uint8)
    to = n

    def keep_all(pos, lcp, sym):
        nonlocal to
        out[to - len(pos) : to] = pos[::-1]
        lcp_out[to - len(pos) + 1 : to + 1] = lcp[::-1]
        to -= len(pos)

    # the last suffix is the least of its type and isn't induced by another
    led_s[t[n - 1]] -= 1
    _scan(t, is_s, run, back, (led_s, counts_l), (down_pos, down_lcp), False, cap, store, keep_all)
    assert to == 1, to
    out[0] = n - 1
    lcp_out[0] = lcp_out[1] = 0
    return Sorted(out, lcp_out[:n])


def suffix_array(text, cap: int, spill: str | None = None, in_memory: int = 1 << 22, store: Store | None = None) -> Sorted:
    """Sorts the suffixes of non-negative integers. ``store``, which the caller closes, may hold the text already.

    The last symbol must be 0 and the only 0. Prefix values are capped at ``cap`` (``MOST`` at most).
    """
    if cap > MOST:
        raise ValueError(f"cap may be {MOST} at most")
    store = store or Store(spill, in_memory)
    t = text if isinstance(text, np.memmap) else np.asarray(text, np.int32)
    if store.external(len(t)) and not isinstance(t, np.memmap):
        kept = store.empty(len(t), np.int32)
        kept[:] = t
        t = kept
    return _sort(t, max(int(t[lo : lo + BLOCK].max()) for lo in range(0, len(t), BLOCK)) + 1, cap, store)
