"""Operators that compare rows: near-dedup, suffix-array dedup, packing, quality rules, and the pipeline."""

import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from leafmill.llm import common as C
from leafmill.llm import counts, induced, near, packing, quality, suffix

from .conftest import frame, prose

WORDS = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def _words(text):
    return WORDS.findall((text or "").lower().encode())


# near duplicates


def _varied(seed, base, share):
    r = random.Random(seed)
    return " ".join(prose(r.random(), 1) if r.random() < share else w for w in base.split(" "))


@pytest.fixture(scope="module")
def alike():
    rows, n = [], 0
    for g in range(60):
        base = prose(g, 120)
        for k in range(1 + g % 4):
            rows.append((n, base if k == 0 or g % 5 == 0 else _varied(n, base, 0.04)))
            n += 1
    return rows + [(n + i, prose(9, 80)) for i in range(400)]


def _similar_pairs(rows):
    grams = []
    for _, t in rows:
        w = _words(t)
        grams.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return [(i, j) for i in range(len(rows)) for j in range(i) if grams[i] and len(grams[i] & grams[j]) >= 0.62 * len(grams[i] | grams[j])]


def test_near_duplicates_have_the_recall_of_brute_force(spark, alike):
    group = {}
    for x in near.near_duplicates(frame(spark, alike)).collect():
        group[x.doc_id] = x.keep_id
    at = lambda i: group.get(i, i)
    pairs = _similar_pairs(alike)
    assert sum(at(alike[i][0]) == at(alike[j][0]) for i, j in pairs) >= 0.97 * len(pairs)
    texts = dict(alike)
    assert all(len(set(_words(texts[a])) & set(_words(texts[b]))) > 0.5 * len(set(_words(texts[a]))) for a, b in group.items())
    assert all(b < a for a, b in group.items())


def test_keep_one_leaves_one_of_each_group(spark, alike):
    df = frame(spark, alike)
    gone = {x.doc_id for x in near.near_duplicates(df).collect()}
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in alike if i not in gone)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = Counter((x.doc_id, x.keep_id) for x in near.near_duplicates(odd).collect())
    assert got == {(8, 7): 1} and near.near_duplicates(empty).count() == 0 and near.keep_one(empty).count() == 0
    kept = Counter(x.doc_id for x in near.keep_one(odd).collect())
    assert kept == {1: 1, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1, 11: 1}


def test_group_edges_connect_what_all_pairs_connect():
    def roots(n, pairs):
        top = list(range(n))
        for a, b in pairs:
            a, b = top[a], top[b]
            top = [min(a, b) if x in (a, b) else x for x in top]
        return top

    links = [[(0, 3), (1, 4), (1, 5), (2, 6), (2, 7), (2, 8), (3, 4), (5, 6)]]
    for seed in range(4):  # above SMALL members, sparse enough for many groups
        r = random.Random(seed)
        links.append([(r.randrange(300), r.randrange(300)) for _ in range(150 + 60 * seed)])
    for pairs in links:
        pairs = [(min(p), max(p)) for p in set(pairs) if p[0] != p[1]]
        n = 300 if len(pairs) > 8 else 9
        sk = np.arange(n)[:, None] * np.ones(len(pairs), int) + 1000  # members agree in a column for each pair they make
        for k, (a, b) in enumerate(pairs):
            sk[a, k] = sk[b, k] = 0
        assert roots(n, near.group_edges(np.arange(n), sk, 1)) == roots(n, pairs)


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (_words(a), _words(b)))
    return len(x & y) / len(x | y)


def test_pairs_about_the_threshold_are_decided_exactly(spark):
    rows, value = [], {}
    for g in range(400):  # pairs apart from all others, from well below the threshold to well above it
        base = prose(20_000 + g, 150)
        other = _varied(30_000 + g, base, 0.06 + 0.14 * g / 400)
        rows += [(2 * g, base), (2 * g + 1, other)]
        value[2 * g + 1] = _jaccard(base, other)
    got = {x.doc_id: x.keep_id for x in near.near_duplicates(frame(spark, rows)).collect()}
    assert all(k == i - 1 and value[i] >= near.SIMILAR for i, k in got.items())
    close = [i for i, v in value.items() if near.SIMILAR <= v < 0.62]
    alike_ = [i for i, v in value.items() if v >= near.SIMILAR]
    assert len(close) > 40 and sum(i in got for i in close) >= 0.93 * len(close) and sum(i in got for i in alike_) >= 0.97 * len(alike_)
    assert sum(near.SIMILAR - 0.07 < v < near.SIMILAR for v in value.values()) > 30  # those that only the exact similarity keeps apart


def test_clusters_larger_than_a_small_node(spark):
    bases = [prose(40_000 + k, 120) for k in range(2)]
    rows = [(k * 1000 + i, _varied(50_000 + k * 1000 + i, bases[k], 0.05)) for k in range(2) for i in range(near.SMALL + 150)]
    rows += [(9000 + i, prose(60_000 + i, 90)) for i in range(30)]
    got = {x.doc_id: x.keep_id for x in near.near_duplicates(frame(spark, rows)).collect()}
    texts, whole = dict(rows), {0: set(), 1000: set()}
    for a, b in got.items():
        whole[b].add(a)
    assert set(got.values()) == {0, 1000} and all(len(x) >= 0.98 * (near.SMALL + 149) for x in whole.values())
    assert all(a // 1000 == b // 1000 for a, b in got.items()) and len(texts) > len(got)


def _shuffled(spark):
    """Bytes that tasks have written for shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("block", [16 << 20, 40_000])
def test_sets_go_to_blocks_and_not_to_each_proposal(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_BYTES", block, raising=False)
    base = prose(70_000, 400)
    rows = [(i, _varied(71_000 + i, base, 0.055 + 0.0003 * i)) for i in range(120)]  # nearly all pairs are in doubt, few of them are links
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (_words(t) for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= near.SIMILAR * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of tables too large for it
    try:
        before = _shuffled(spark)
        got = {x.doc_id: x.keep_id for x in near.near_duplicates(frame(spark, rows), trees=20).collect()}
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: c for i, c in enumerate(root) if c != i} and 10 < len(got) < 110
    assert moved < (10 if block < 1 << 20 else 3) * 8 * sum(map(len, sets))


def test_trees_follow_from_the_recall():
    assert near.trees_for(1.0) == 1 and near.trees_for(0.55, 0.5) < near.trees_for(0.55, 0.98) < near.trees_for(0.3, 0.98)
    low, high = near._bounds(near.SIMILAR)
    assert low < near.SIMILAR * near.TOKENS < high


def test_roots_of_edges_in_a_task():
    r = np.random.default_rng(2)
    u, v = r.integers(0, 200, 150), r.integers(0, 200, 150)
    top = {x: x for x in {*u.tolist(), *v.tolist()}}
    for _ in range(200):
        for a, b in zip(u.tolist(), v.tolist()):
            top[a] = top[b] = min(top[a], top[b])
    names, roots = near._roots_of(u, v)
    assert dict(zip(names.tolist(), roots.tolist())) == top


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (200, 200)]
    got = {x.g: x.c for x in near.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[75] == got[50] == 50


# suffix arrays


@pytest.mark.parametrize("in_memory", [1 << 20, 64])
def test_suffix_array_and_prefixes(tmp_path, in_memory):
    r = np.random.default_rng(1)
    for n, symbols in ((1, 1), (2, 1), (50, 2), (300, 3), (700, 40), (400, 1)):
        t = np.r_[r.integers(1, symbols + 1, n), 0]
        store = induced.Store(str(tmp_path), in_memory)
        got = induced.suffix_array(t, 20, str(tmp_path), in_memory, store)
        order = sorted(range(n + 1), key=lambda i: t[i:].tolist())
        lcp = [0] + [next((k for k in range(20) if a + k > n or b + k > n or t[a + k] != t[b + k]), 20) for a, b in zip(order, order[1:])]
        assert np.asarray(got.order).tolist() == order and np.asarray(got.lcp).tolist() == lcp
        store.close()


@pytest.mark.parametrize("block", [7, 64])
def test_suffix_array_in_small_blocks(tmp_path, monkeypatch, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    test_suffix_array_and_prefixes(tmp_path, 64)


def _shard(folder, seed, windows, vocabulary):
    """A shard whose windows share many passages, and all of them as lists."""
    r = np.random.default_rng(seed)
    passages = [r.integers(0, vocabulary, 60).astype(np.uint32) for _ in range(max(1, windows // 8))]
    held, texts = suffix.Windows(str(folder)), []
    size = min(suffix.MINI, 25)
    for at in range(0, windows, 500):
        rows = []
        for _ in range(min(500, windows - at)):
            p = passages[r.integers(len(passages))]
            rows.append(np.r_[r.integers(0, vocabulary, r.integers(0, 9)), p, r.integers(0, vocabulary, r.integers(0, 9))].astype(np.uint32))
        n = len(rows)
        minis = [C.gram_hashes(x.astype(np.uint64), size) for x in rows]
        mini = np.array([h[C.sliding_argmin(h, 50 - size + 1)[r.integers(len(x) - 49)]] for h, x in zip(minis, rows)]).view(np.int64)
        doc = np.arange(at, at + n) // 2
        words = suffix.pa.array([x.tobytes() for x in rows], suffix.pa.binary())
        held.add(mini, np.zeros(n, bool), doc, doc * 7, r.integers(0, 9, n), r.random(n) < 0.2, words)
        texts += list(zip(rows, mini.view(np.uint64).tolist(), doc.tolist(), held.parts[-1][4].tolist(), held.parts[-1][5].tolist()))
    return held, texts


def _covered(texts, least=50):
    """For each window and flag the words that repeats cover, by comparing all grams."""
    size, where = min(suffix.MINI, 25), defaultdict(list)
    for w, (x, mini, doc, at, several) in enumerate(texts):
        h = C.gram_hashes(x.astype(np.uint64), size)
        own = h[C.sliding_argmin(h, least - size + 1)] == np.uint64(mini)
        for k in np.flatnonzero(own).tolist():
            where[tuple(x[k : k + least].tolist())].append((doc, at + k, w, k, several))
    out = defaultdict(set)
    for places in where.values():
        if len(places) > 1 or places[0][4]:
            lead = min(p[:2] for p in places)
            first = next(p for p in sorted(places) if p[:2] == lead)
            for p in places:
                out[p[2], p is first].update(range(p[3], p[3] + least))
    return out


@pytest.mark.parametrize("in_memory,block", [(1 << 22, 1 << 18), (600, 1 << 18), (600, 100)])
def test_repeats_in_memory_and_in_files(tmp_path, monkeypatch, in_memory, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(induced, "BLOCK", block)
    for seed, vocabulary in ((1, 500), (2, 3)):
        held, texts = _shard(tmp_path, seed, 120, vocabulary)
        got = defaultdict(set)
        for w, start, end, lead in suffix.repeats(held, 50, str(tmp_path), in_memory):
            for i, a, b, flag in zip(w.tolist(), start.tolist(), end.tolist(), lead.tolist()):
                got[i, flag].update(range(a, b))
        held.close()
        assert got == _covered(texts) and got


_PEAK = """
import sys, threading, time
sys.path.insert(0, sys.argv[1])
from pathlib import Path
from tests.llm.test_groups import _shard
from leafmill.llm import suffix
held, _ = _shard(Path(sys.argv[2]), 5, 400, 5000)  # code is loaded and tables are made
list(suffix.repeats(held, 50, sys.argv[2], 1000))
held.close()
held, texts = _shard(Path(sys.argv[2]), 6, int(sys.argv[4]), 5000)
del texts
now = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) / 1024
base, most, on = now(), [0.0], [True]
def watch():
    while on[0]:
        most[0] = max(most[0], now())
        time.sleep(0.002)
t = threading.Thread(target=watch)
t.start()
n = sum(int((e - s).sum()) for _, s, e, _ in suffix.repeats(held, 50, sys.argv[2], int(sys.argv[3])))
on[0] = False
t.join()
held.close()
print(n, most[0] - base)
"""


def test_a_shard_ten_times_the_memory_limit_stays_in_files(tmp_path):
    def run(in_memory):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        out = subprocess.run([sys.executable, "-c", _PEAK, root, str(tmp_path), str(in_memory), "60000"], capture_output=True, text=True, check=True).stdout.split()
        return int(out[0]), float(out[1])

    words = 60_000 * 68
    (n, whole), (m, files) = run(1 << 40), run(words // 10)
    assert n == m and files < whole / 3, (whole, files)


def test_the_least_size_has_a_bound_that_is_checked(spark, tmp_path):
    held, _ = _shard(tmp_path, 1, 10, 50)
    with pytest.raises(ValueError):
        next(suffix.repeats(held, induced.MOST + 1))
    held.close()
    with pytest.raises(ValueError):
        suffix.spans(frame(spark, []), induced.MOST + 1)


def test_the_largest_size_finds_its_repeats(spark):
    passage = prose(90, 300)
    rows = [(1, f"{prose(91, 20)} {passage}"), (2, f"{passage} {prose(92, 20)}")]
    got = {(x.doc_id, x.duplicate): x.end_word - x.start_word for x in suffix.repeated_passages(frame(spark, rows), induced.MOST).collect()}
    assert got == {(1, False): 300, (2, True): 300}


def _repeated(rows, least):
    """For each (doc_id, text) the words that repeat, and those that are duplicates."""
    docs = sorted({(i is None, i or 0, C_key(i, t), i, t) for i, t in rows if t})
    where = defaultdict(list)
    for d, (*_, t) in enumerate(docs):
        w = _words(t)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].append((d, k))
    first, dup = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for n, (d, k) in enumerate(sorted(places)):
                (dup if n else first)[d].update(range(k, k + least))
    return {(docs[d][3], flag): s for flag, x in ((False, first), (True, dup)) for d, s in x.items()}


_keys: dict = {}


def C_key(i, t):
    return _keys.get((i, t), 0)


def test_repeats_are_those_of_brute_force(spark):
    r = random.Random(6)
    shared = [prose(100 + k, 70) for k in range(3)]
    rows = [(i, " ".join(r.choice([prose(r.random(), 30), *shared, "a b " * 20]) for _ in range(r.randint(1, 4)))) for i in range(60)]
    got = defaultdict(set)
    for x in suffix.repeated_passages(frame(spark, rows), 20).collect():
        got[x.doc_id, x.duplicate].update(range(x.start_word, x.end_word))
    assert dict(got) == _repeated(rows, 20)


def test_cut_repeats(spark, odd, empty):
    passage = prose(50, 80)
    rows = [(1, f"{prose(51, 30)} {passage} {prose(52, 30)}"), (2, f"{prose(53, 30)} {passage} {prose(54, 30)}"), (3, passage), (4, None), (5, "")]
    df = frame(spark, rows)
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert set(got) == {1, 2, 4, 5} and got[1][0] == rows[0][1] and got[4] == (None, None)
    assert _words(got[2][0]) == _words(prose(53, 30)) + _words(prose(54, 30)) and got[2][1] == len(got[2][0])
    assert suffix.cut_repeats(empty).count() == 0 and suffix.repeated_passages(empty).count() == 0
    assert {x.doc_id for x in suffix.cut_repeats(odd).collect()} >= {1, 2, 3, 4, 5, 6, 7, 9, 10, None}


# packing


def _first_fit(sizes, capacity):
    rooms, out = [], []
    for n in sizes:
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(capacity)
            k = len(rooms) - 1
        out.append((k, capacity - rooms[k]))
        rooms[k] -= n
    return out


def test_first_fit_is_that_of_a_scan_over_bins():
    r = random.Random(1)
    for _ in range(100):
        sizes = sorted((r.randint(0, 30) for _ in range(r.randint(1, 60))), reverse=True)
        assert list(zip(*packing.first_fit(sizes, 30))) == _first_fit(sizes, 30)


def test_packing_places_every_token_once(spark, odd, odd_rows, empty):
    rows = [(i, prose(i, random.Random(i).randint(1, 90))) for i in range(300)]
    for df, docs in ((frame(spark, rows), rows), (odd, odd_rows)):
        count = counts.counter(*counts.vocabulary())([t or "" for _, t in docs])
        got = packing.pack(df, capacity=128, group=50).collect()
        placed, bins = Counter(), defaultdict(list)
        for x in got:
            placed[x.doc_id] += x.n_tokens
            bins[x.group_id, x.bin].append((x.bin_offset, x.n_tokens))
        want = Counter()
        for (i, _), n in zip(docs, count):
            want[i] += int(n)
        assert {i: placed[i] for i in want} == dict(want)
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at or n == 0
                at += n
            assert at <= 128
    assert packing.pack(empty).count() == 0


def test_packing_is_first_fit_decreasing_in_a_group(spark):
    rows = [(i, "word " * (i * 7 % 40 + 1)) for i in range(80)]
    got = sorted(packing.pack(frame(spark, rows), capacity=64, group=1000).collect(), key=lambda x: (-x.n_tokens, x.doc_id))
    assert [(x.bin, x.bin_offset) for x in got] == _first_fit([x.n_tokens for x in got], 64)


def test_equal_rows_spread_over_the_groups(spark):
    rows = [(7, "word " * 30)] * 900 + [(i, prose(i, 30)) for i in range(100)]
    sizes = Counter(x.group_id for x in packing.pack(frame(spark, rows), capacity=256, group=100).where("doc_id = 7").collect())
    assert len(sizes) == 10 and max(sizes.values()) < 150


# quality rules


def _labelled(seed, n):
    r = random.Random(seed)
    good = [(i, prose(seed * 1000 + i, 120)) for i in range(n)]
    bad = [(n + i, " | ".join(r.choice(["$$$ buy", "### now", "12345", "!!!"]) for _ in range(60))) for i in range(n)]
    return good + bad, [(i, int(i < n), 0) for i in range(2 * n)]


def test_quality_rules_on_held_out_rows(spark):
    rows, labels = _labelled(1, 120)
    forest = quality.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held, truth = _labelled(7, 60)
    got = {x.doc_id: x.keep for x in quality.rate(frame(spark, held), forest).collect()}
    assert np.mean([got[i] == bool(q) for i, q, _ in truth]) > 0.95


def test_scores_fall_with_constrained_features():
    r = np.random.default_rng(0)
    x = r.random((800, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 0] + r.normal(0, 0.3, 800) > 0.5).astype(float)
    forest = quality.train(x, y, trees=25)
    for name, sign in quality.MONOTONE.items():
        j = quality.FEATURES.index(name)
        grid = np.repeat(x[:40], 30, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 30), 40)
        assert (np.diff(quality.score(forest, grid).reshape(40, 30), axis=1) * sign >= -1e-12).all()


def test_flat_trees_score_like_walking_them():
    r = np.random.default_rng(3)
    x = r.random((300, 5)).astype(np.float32)
    f = quality.train(x, (x[:, 0] > x[:, 1]).astype(float), trees=6)
    width = (2 << quality.DEPTH) - 1
    for row, p in zip(x[:50], quality.score(f, x[:50])):
        total = f.base
        for root in range(0, len(f.feature), width):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[f.feature[root + at]] > f.threshold[root + at] else 1)
            total += f.value[root + at]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(7, 1, 0), (10, 0, 0), (None, 1, 0), (99, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    got = quality.quality_rules(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(not x.keep and x.score == 0 for x in got if x.doc_id in (1, 2, 3, 10))
    kept = quality.keep_good(odd, none)
    assert kept.columns == odd.columns and Counter(x.doc_id for x in kept.collect()) == {None: 1, 4: 2, 5: 1, 6: 1, 7: 2, 8: 1, 9: 1, 11: 1}
    assert quality.quality_rules(empty, labels).count() == 0 and quality.keep_good(empty, none).count() == 0


# the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    rows, labels = _labelled(3, 60)
    passage = prose(77, 90)
    extra = [(500, rows[0][1]), (501, _varied(4, rows[1][1], 0.03)), (502, f"{prose(78, 150)} {passage}"), (503, f"{passage} {prose(79, 150)}")]
    extra += [(504, f'{prose(80, 100)} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {prose(81, 60)}'), (505, None), (506, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, folder))
        assert docs.columns == columns
        seen.append({x.doc_id: x.text for x in docs.collect()})
    rated, single, cut, clean = seen
    assert set(range(60)) | {500, 501, 502, 503, 504} == set(rated)
    assert set(rated) - set(single) == {500, 501} and set(cut) == set(single)
    assert _words(cut[503]) == _words(prose(79, 150)) and cut[502] == single[502]
    assert "<SECRET>" in clean[504] and all(clean[i] == cut[i] for i in cut if i != 504)
    got = corpus_pipeline.run(spark, folder)
    count = dict(zip(clean, counts.counter(*counts.vocabulary())(list(clean.values()))))
    assert {x.doc_id: x.n_tokens for x in got.collect()} == count


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
