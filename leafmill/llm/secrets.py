"""Secret scans: a linear-chain conditional random field.

Tokens are runs of letters, digits, non-ASCII bytes and ``_ + / -``, with dots
between letters or digits. The field tags each as outside (O), beginning (B) or
inside (I) of a secret, from its shape, its surroundings, the words around it and
features of the whole file, and is decoded by Viterbi.

It is trained here, on a bounded sample of whole documents (``TRAIN_ROWS``): at two
random places of each a made-up credential, a harmless look-alike or nothing is
written in, and what a few patterns find already is labelled too. Features are those
of the whole document with what was written into it; of its tokens, the ones around
the two places (``WINDOW``) are learnt from; fewer documents are each used more than
once. Windows are made on the executors, so the driver holds windows, never texts. The
likelihood is maximised with its exact gradient, by forward and backward sums.

Decoding is exact. A token whose O outweighs B and I by more than any change of
transitions could make good is O on the best path, so only the stretches between
such tokens are decoded, all of a batch side by side. Of equally good paths the one
whose last states come first in the order O, B, I is taken.

Defined results: null and empty texts have no secrets; texts are read whole,
whatever their length; equal rows give equal rows; an empty table gives none and
trains nothing; extra columns don't matter. Offsets are in bytes of UTF-8, the
end exclusive.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The bound on documents that training reads; tokens on both sides of a place together; passes of the optimiser.
TRAIN_ROWS, WINDOW, STEPS = 800, 40, 90
REDACTED = b"<SECRET>"

_TOKEN = C.WORD.copy()
_TOKEN[[ord(c) for c in "_+/-"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SETS = {
    "upper": _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _of("abcdefghijklmnopqrstuvwxyz"), "digit": _of("0123456789"),
    "mark": _of("_+/-."), "hex": _of("0123456789abcdefABCDEF"), "vowel": _of("aeiouyAEIOUY"),
}
_AROUND = np.zeros(256, np.int64)  # what stands beside a token: other, space, quote, =, :, @, bracket, letter
for _k, _chars in enumerate((" \t\n\r", "\"'`", "=", ":", "@", "<>()[]{}", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_/+."), 1):
    _AROUND[[ord(c) for c in _chars]] = _k

_WORDS, _PREFIX = 1 << 14, 1 << 12
#: Values of each feature; they share one table of weights.
SIZES = (12 * 16, 2 * 12 * 8, 512, 8 * 8 * 12, _WORDS, _WORDS, _WORDS, _PREFIX, 12 * 16 + 1, 12 * 16 + 1, 216, 72, 1)
_FIRST = np.r_[0, np.cumsum(SIZES)[:-1]]
O, B, I = 0, 1, 2  # noqa: E741


class Tokens(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def tokens(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    m = _TOKEN[buf]
    if len(buf) > 2:
        alnum = _ALNUM[buf]
        dot = np.flatnonzero(buf[1:-1] == 46) + 1
        m[dot] = alnum[dot - 1] & alnum[dot + 1]
    m = np.r_[m, False]
    before = np.r_[False, m[:-1]]
    inner = offs[(offs > 0) & (offs < len(buf))]
    cut = np.zeros(len(m), bool)
    cut[inner] = True
    start = np.flatnonzero(m & (~before | cut))
    end = np.flatnonzero(before & (~m | cut))
    return Tokens(start, end, np.searchsorted(offs, start, "right") - 1)


def _bucket(n: np.ndarray, edges) -> np.ndarray:
    return np.searchsorted(edges, n, "right")


_LENGTHS = (2, 4, 6, 8, 12, 16, 20, 28, 36, 44, 72)


def features(buf: np.ndarray, offs: np.ndarray, t: Tokens) -> np.ndarray:
    """For each token the rows of the weights table that its features name."""
    n, size = len(t.start), t.end - t.start
    pre = {}
    for name, member in _SETS.items():
        x = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(member[buf], out=x[1:])
        pre[name] = x
    count = {name: x[t.end] - x[t.start] for name, x in pre.items()}
    kind = np.zeros(len(buf) + 1, np.int8)
    kind[:-1] = _SETS["digit"][buf]
    turns = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(kind[1:] != kind[:-1], out=turns[1:])
    changes = np.maximum(turns[np.maximum(t.end - 1, 0)] - turns[t.start], 0)
    length = _bucket(size, _LENGTHS)
    shape = length * 16 + (count["upper"] > 0) * 8 + (count["lower"] > 0) * 4 + (count["digit"] > 0) * 2 + (count["mark"] > 0)
    padded = np.r_[np.full(3, 32, np.uint8), buf, np.full(2, 32, np.uint8)]
    left = [_AROUND[padded[t.start + 3 - d]] for d in (1, 2, 3)]
    right = _AROUND[padded[t.end + 3]]
    h = C.span_hashes(_FOLD[buf], t.start, t.end) if n else np.zeros(0, np.uint64)
    word = (h % np.uint64(_WORDS)).astype(np.int64)
    prefix = (C.span_hashes(buf, t.start, np.minimum(t.start + 4, t.end)) % np.uint64(_PREFIX)).astype(np.int64) if n else word

    def beside(x: np.ndarray, d: int, none: int) -> np.ndarray:
        out = np.full(n, none, np.int64)
        if d < 0 and n > -d:
            same = t.doc[-d:] == t.doc[:d]
            out[-d:] = np.where(same, x[:d], none)
        elif d > 0 and n > d:
            same = t.doc[:-d] == t.doc[d:]
            out[:-d] = np.where(same, x[d:], none)
        return out

    total = np.maximum(np.diff(offs), 1)
    share = lambda name: (pre[name][offs[1:]] - pre[name][offs[:-1]]) / total
    file = _bucket(share("digit"), (0.002, 0.01, 0.03, 0.1, 0.3)) * 36 + _bucket(share("mark"), (0.002, 0.01, 0.03, 0.06, 0.15)) * 6 + _bucket(total, (200, 1000, 4000, 16000, 64000))
    cols = (
        shape, ((count["hex"] == size) * 12 + length) * 8 + np.minimum(changes * 8 // np.maximum(size, 1), 7), left[0] * 64 + left[1] * 8 + left[2],
        (left[0] * 8 + right) * 12 + length, beside(word, -1, 0), beside(word, -2, 0), beside(word, 1, 0), prefix, beside(shape, -1, 192), beside(shape, 1, 192),
        file[t.doc], _bucket(count["vowel"] / size, (0.05, 0.15, 0.25, 0.4, 0.6)) * 12 + length, np.zeros(n, np.int64),
    )
    return np.stack(cols, 1) + _FIRST


class Field(NamedTuple):
    weights: np.ndarray  # (features, 3)
    moves: np.ndarray  # (3, 3), from the state before


def emissions(field: Field, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 3))
    for j in range(x.shape[1]):
        out += field.weights[x[:, j]]
    return out


def viterbi(e: np.ndarray, moves: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best states of sequences laid end to end, each between two O; longest first, side by side."""
    out = np.zeros(len(e), np.int64)
    if not len(size):
        return out
    first = np.r_[0, np.cumsum(size)[:-1]]
    o = np.argsort(-size, kind="stable")
    first, size = first[o], size[o]
    back = np.zeros((len(e), 3), np.int8)
    v = moves[O] + e[first]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # sequences of at least so many tokens
    final = np.empty((len(size), 3))
    for i in range(1, size[0]):
        n = live[i]
        final[n : live[i - 1]] = v[n:]
        c = v[:n, :, None] + moves
        best = c.argmax(1)
        back[first[:n] + i] = best
        v = np.take_along_axis(c, best[:, None], 1)[:, 0] + e[first[:n] + i]
    final[: len(v)] = v
    state = (final + moves[:, O]).argmax(1)
    for i in range(size[0] - 1, -1, -1):
        n = live[i]
        out[first[:n] + i] = state[:n]
        state[:n] = back[first[:n] + i, state[:n]]
    return out


def decode(field: Field, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best states of all tokens; each text starts and ends as if beside an O."""
    m = field.moves
    through = m[:, :, None] + m[None]  # before, here, after
    slack = (through - through[:, [O]]).max()
    open_ = e[:, O] - e[:, 1:].max(1) <= max(slack, 0)
    at = np.flatnonzero(open_)
    out = np.zeros(len(e), np.int64)
    if len(at):
        new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])])
        out[at] = viterbi(e[at], m, np.diff(np.r_[new, len(at)]))
    return out


def spans(t: Tokens, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end and number of tokens of each secret."""
    hit = np.flatnonzero(state)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 4
    lead = np.r_[True, (state[hit[1:]] == B) | (np.diff(hit) > 1) | (t.doc[hit[1:]] != t.doc[hit[:-1]])]
    a = np.flatnonzero(lead)
    b = np.r_[a[1:], len(hit)] - 1
    return t.doc[hit[a]], t.start[hit[a]], t.end[hit[b]], b - a + 1


# Training

_TEACHERS = [re.compile(p, re.I) for p in (
    r"\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?\b\W{0,8}[=:]\W{0,6}(?P<s>[\w+/-]{16,})",
    r"(?P<s>-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)", r"\b(?P<s>(?:AKIA|ASIA)[0-9A-Z]{16})\b", r"\b(?P<s>gh[pousr]_[A-Za-z0-9]{30,})\b",
)]
_HEX, _B62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NAMES = ("token", "secret", "key", "password", "passwd", "pwd", "credential", "api_key", "apikey", "access_key", "auth_token", "client_secret", "aws_secret_access_key", "private_key", "TOKEN", "API_KEY", "SECRET_KEY")
_OWNERS = ("", "", "", "", "my_", "app_", "user_", "admin_", "prod_", "test_", "service_", "cloud_", "mail_", "APP_", "SERVICE_")


def _credential(r: np.random.Generator) -> tuple[str, str, str]:
    """What stands before a made-up credential, the credential, what stands after it."""
    pick = lambda chars, n: "".join(r.choice(list(chars), n))
    name, q = r.choice(_OWNERS) + r.choice(_NAMES), r.choice(['"', "'", ""])
    lead = f"{name}{r.choice(['', q])}{r.choice([' = ', '=', ': ', ' : '])}{q}"
    alone = lambda other: lead if r.random() < 0.6 else other
    k = r.integers(0, 10)
    if k < 3:
        s = pick(_HEX, int(r.choice([16, 18, 20, 24, 32, 40, 40, 56, 64, 96])))
        s = s.upper() if r.random() < 0.25 else s
    elif k == 3:
        s = r.choice(["AKIA", "AKIA", "AROA", "AIDA"]) + pick(_B62[:26] + "0123456789", 16)
        lead = lead if r.random() < 0.4 else " "
    elif k == 4:
        s, lead = r.choice(["ghp_", "gho_", "xoxb-", "glpat-", "npm_", "pypi-"]) + pick(_B62, int(r.integers(20, 44))), alone(" ")
    elif k == 5:
        s, lead = r.choice(["sk-", "pk_live_", "rk_", "key-"]) + pick(_B62, int(r.integers(24, 52))), alone(" ")
    elif k == 6:
        s = pick(_B62 + "+/", int(r.integers(20, 64)))
    elif k == 7:
        s, lead = f"eyJ{pick(_B62, 33)}.eyJ{pick(_B62, 60)}.{pick(_B62 + '_-', 43)}", alone(r.choice(["Bearer ", "Bearer: ", "Basic "]))
    elif k == 8:
        s, lead = pick(_B62, int(r.integers(14, 60))), lead if r.random() < 0.7 else r.choice(["Bearer ", "Authorization: ", "Basic "])
    else:
        kind = r.choice(["RSA ", "EC ", ""])
        body = "\n".join(pick(_B62 + "+/", 64) for _ in range(int(r.integers(2, 6))))
        return "\n", f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", "\n"
    return lead, s, q


def _harmless(r: np.random.Generator) -> str:
    num = lambda n: "".join(r.choice(list("0123456789"), n))
    return str(r.choice([
        f"user.{num(2)}@mail{num(1)}.example.com", f"https://www.example.com/path/{num(6)}/index-{num(2)}.html", f"+{num(2)}-{num(3)}-{num(7)}", f"2024-{num(2)}-{num(2)}",
        f"v{num(1)}.{num(2)}.{num(1)}", f"ISBN {num(3)}-{num(10)}", "All rights reserved.", f"price = {num(4)}", 'name = "example"', f"{num(3)}.{num(3)}.{num(1)}.{num(2)}",
        'token = "the"', "the password is here", "Donaudampfschifffahrtselektrizitaetenhauptbetriebswerk", "secret: none", f"id: {num(8)}", f"# {num(4)} items", "key = value",
        f"{num(4)} {num(4)} {num(4)} {num(4)}", f"order-{num(12)}", "CONSTANT_NAME_WITH_PARTS", "some_function_name_with_many_parts",
    ]))


def plant(text: str, r: np.random.Generator) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with something written in at two places; the spans of its secrets, and of the two places, in characters."""
    places = sorted((text.find(" ", int(r.random() * len(text))) for _ in range(2)), key=lambda p: len(text) if p < 0 else p)
    out, done, size, secrets_, around = [], 0, 0, [], []
    for at in places:
        at = len(text) if at < 0 else at
        out.append(text[done:at])
        size, done = size + at - done, at
        if r.random() < 0.5:
            lead, s, end = _credential(r)
            before = r.choice([" ", "\n", ""]) + lead if lead[:1] not in " \n" else lead
            secrets_.append((size + len(before), size + len(before) + len(s)))
            new = before + s + end
        else:
            new = f" {_harmless(r)}" if r.random() < 0.7 else ""
        around.append((size, size + len(new)))
        out.append(new)
        size += len(new)
    new = "".join([*out, text[done:]])
    for p in _TEACHERS:
        for m in p.finditer(new):
            a, b = m.span("s")
            if not any(x < b and a < y for x, y in secrets_) and re.search(r"\d", new[a:b]):
                secrets_.append((a, b))
    return new, secrets_, around


def windows(texts: list[str], seeds: list[int], rounds: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and states of the tokens around the places of each text, ``rounds`` times anew; the features know the whole text."""
    out = []
    for text, seed in ((t, [n % (1 << 63), k]) for t, n in zip(texts, seeds) for k in range(rounds)):
        new, marks, around = plant(text, np.random.default_rng(seed))
        raw = np.frombuffer(new.encode("utf-8", "replace"), np.uint8)
        offs = np.array([0, len(raw)])
        t = tokens(raw, offs)
        x, y = features(raw, offs, t), np.zeros(len(t.start), np.int64)
        byte = lambda c: len(new[:c].encode("utf-8", "replace"))
        for a, b in marks:
            inside = slice(np.searchsorted(t.end, byte(a), "right"), np.searchsorted(t.start, byte(b)))
            y[inside] = I
            y[inside.start : inside.stop][:1] = B
        for a, b in around:
            lo, hi = np.searchsorted(t.end, byte(a), "right"), np.searchsorted(t.start, byte(b))
            part = slice(max(0, lo - WINDOW // 2), hi + WINDOW // 2)
            if len(y[part]):
                out.append((x[part], y[part]))
    return out


def fit_windows(parts: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, l2: float = 0.02) -> Field:
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    total, k = int(sum(SIZES)), x.shape[1]
    counts = np.array([len(p[1]) for p in parts])
    first = np.r_[0, np.cumsum(counts)[:-1]]
    o = np.argsort(-counts, kind="stable")
    first, counts = first[o], counts[o]
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right")
    theta = np.zeros(total * 3 + 9)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n = len(y)
    gold = np.zeros((n, 3))
    gold[np.arange(n), y] = 1
    before = np.zeros(n, np.int64)
    before[1:] = y[:-1]
    before[first] = O
    gold_moves = np.bincount(before * 3 + y, minlength=9) + np.bincount(y[first + counts - 1] * 3 + O, minlength=9)
    used = np.unique(x)
    dense = np.searchsorted(used, x)
    for step in range(1, steps + 1):
        field = Field(theta[:-9].reshape(-1, 3), theta[-9:].reshape(3, 3))
        e = np.exp(emissions(field, x).clip(-30, 30))
        m = np.exp(field.moves)
        alpha, scale, beta = np.empty((n, 3)), np.ones(n), np.ones((n, 3))
        v = None
        for i in range(counts[0]):
            at = first[: live[i]] + i
            v = (m[O] if i == 0 else v[: live[i]] @ m) * e[at]
            scale[at] = v.sum(1)
            v = v / scale[at][:, None]
            alpha[at] = v
        for i in range(counts[0] - 1, -1, -1):
            at = first[: live[i]] + i
            more = live[i + 1] if i + 1 < counts[0] else 0
            beta[at[more:]] = m[:, O]
            nxt = at[:more] + 1
            beta[at[:more]] = (e[nxt] * beta[nxt] / scale[nxt][:, None]) @ m.T
        post = alpha * beta
        post /= post.sum(1, keepdims=True)
        inner = np.ones(n, bool)
        inner[first] = False
        q = np.flatnonzero(inner)
        joint = alpha[q - 1][:, :, None] * m * (e[q] * beta[q])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        moves = joint.sum(0)
        moves[O] += post[first].sum(0)
        moves[:, O] += post[first + counts - 1].sum(0)
        diff, grad = gold - post, np.zeros((total, 3))
        for c in range(3):
            grad[used, c] = np.bincount(dense.ravel(), np.repeat(diff[:, c], k), len(used))
        g = np.r_[grad.ravel(), (gold_moves - moves.ravel())] - l2 * theta
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta += 0.08 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
        theta[-9:] = theta[-9:].clip(-2, 2)
    return Field(theta[:-9].reshape(-1, 3).copy(), theta[-9:].reshape(3, 3).copy())


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, steps: int = STEPS) -> Field | None:
    """Trains on at most ``rows`` documents, those with the least hash of (doc_id, text)."""
    C.prepare(docs.sparkSession)
    # at most ``rows`` hashes come to the driver, then the windows of as many texts
    hashed = docs.where(F.length("text") > 0).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not least:
        return None
    wanted = docs.sparkSession.createDataFrame([(h,) for h in least], "h long")
    rounds = -(-rows // len(least))  # a small corpus is written into again and again

    def run(batches):
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text")):
                for no, (x, y) in enumerate(windows([text.as_py()], [h], rounds)):
                    yield pa.record_batch([pa.array([h]), pa.array([no]), pa.array([x.ravel()], pa.list_(pa.int32())), pa.array([y], pa.list_(pa.int8()))], ["h", "no", "x", "y"])

    found = hashed.join(F.broadcast(wanted), "h").dropDuplicates(["h"]).mapInArrow(run, "h long, no long, x array<int>, y array<byte>").toArrow()
    found = found.sort_by([("h", "ascending"), ("no", "ascending")])
    parts = [(np.array(x.values).reshape(-1, len(SIZES)), np.array(y.values).astype(np.int64)) for x, y in zip(found["x"], found["y"])]
    return fit_windows(parts, steps) if parts else None


def tag(field: Field, buf: np.ndarray, offs: np.ndarray):
    """doc, start, end (in the buffer) and number of tokens of each secret of a slice."""
    t = tokens(buf, offs)
    if not len(t.start):
        return (np.zeros(0, np.int64),) * 4
    return spans(t, decode(field, emissions(field, features(buf, offs, t)), t.doc))


def secret_scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, start, end, n_tokens``: every secret of every row."""
    C.prepare(docs.sparkSession)
    field = field or fit(docs)

    def run(batches):
        for batch in batches:
            for s in C.slices(batch):
                d, a, b, n = tag(field, s.buf, s.offs)
                if len(d):
                    yield pa.record_batch([s.rows.column("doc_id").take(pa.array(d)), pa.array((a - s.offs[d]).astype(np.int32)), pa.array((b - s.offs[d]).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "start", "end", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, start int, end int, n_tokens int")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All rows of ``docs``, secrets replaced by a mark; n_chars, where there, is set anew for changed texts."""
    C.prepare(docs.sparkSession)
    field = field or fit(docs)
    plain, restore = C.numbered(docs)
    at = f"c{docs.columns.index('text')}"
    chars = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for s in C.slices(batch, at):
                d, a, b, _ = tag(field, s.buf, s.offs)
                rows = s.rows
                if len(d):
                    j = rows.schema.get_field_index(at)
                    texts = rows.column(j).to_pylist()
                    counts = rows.column(rows.schema.get_field_index(chars)).to_pylist() if chars else None
                    for i in np.unique(d):
                        raw, parts, done = s.buf[s.offs[i] : s.offs[i + 1]].tobytes(), [], 0
                        for k in np.flatnonzero(d == i):
                            parts += [raw[done : a[k] - s.offs[i]], REDACTED]
                            done = b[k] - s.offs[i]
                        texts[i] = b"".join([*parts, raw[done:]]).decode()
                        if counts:
                            counts[i] = len(texts[i])
                    rows = rows.set_column(j, rows.schema.field(j), pa.array(texts, rows.schema.field(j).type))
                    if chars:
                        j = rows.schema.get_field_index(chars)
                        rows = rows.set_column(j, rows.schema.field(j), pa.array(counts, rows.schema.field(j).type))
                yield rows

    return restore(plain.mapInArrow(run, plain.schema)) if field else docs
