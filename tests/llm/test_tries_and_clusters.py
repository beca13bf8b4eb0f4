"""Prefix trie, LSH forest and bisector tournament against plain versions, with nulls, ties, repeated rows, long and
empty inputs, empty tables and clashing extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import CLASH, TEXTS, components, counted, documents
from pyspark.sql import functions as F

from tunewright.llm import bisector, lsh_forest, prefix_trie

KINDS = {float: "double", int: "long", str: "string"}
EXTRA = "".join(f", `{c}` {KINDS[type(v)]}" for c, v in CLASH.items())


# prefix trie

def trie_plain(rows):
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            talks[c].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in talks.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + x[h:])
    members = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = collections.Counter()
    for path, own_members in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        ends = ",".join(str(c) for c in sorted(own_members) if built[c] == path)
        out[(min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members),
             sum(len(p) == len(path) + 1 for p in below), len(leaves),
             sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def talk_rows(seed=5):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, 0, "user", "é" * 30), (7, 0, "user", "tie"),
            (7, 0, "user", "tie"), (-3, 1, "user", ""), (-3, 2, "", None)]
    for c in list(range(10, 40)) + [55, 56, 57, 101, 104]:
        n = rng.choice((1, 2, 3, 9, 12)) if c < 55 else 90  # 90 turns: four blocks
        for turn in range(n):
            same = rng.random() < 0.7 or c >= 55 and turn < 50
            rows.append((c, turn, "user" if turn % 2 else "system", f"t{turn}" if same else f"t{turn} of {c} ü"))
    rng.shuffle(rows)
    return rows


def talks(spark, rows):
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows],
                                 "conv_id long, turn long, role string, text string" + EXTRA)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_prefix_trie(spark):
    rows = talk_rows()
    got = prefix_trie.prefix_trie(talks(spark, rows))
    assert got.columns == TRIE
    assert counted(got.collect()) == trie_plain(rows)


def test_prefix_trie_hot_conversation_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(3)] + [(c, 0, "user", "x") for c in
                                                                                    range(300, 330)]
    assert counted(prefix_trie.prefix_trie(talks(spark, rows)).collect()) == trie_plain(rows)


def test_prefix_trie_empty_and_turnless(spark):
    empty = prefix_trie.prefix_trie(talks(spark, []))
    assert empty.columns == TRIE and empty.count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its base is not there
    assert [tuple(r) for r in prefix_trie.prefix_trie(talks(spark, [(c, 0, "user", "gone")])).collect()] == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# LSH forest

def near_plain(rows, width=4, percent=80):
    return collections.Counter((d, n, c, d == c) for d, n, c in components(rows, width, percent))


def test_lsh_forest(spark):
    got = lsh_forest.near_dedup(documents(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert counted(got.collect()) == near_plain(TEXTS)


def test_lsh_forest_empty_and_wordless(spark):
    assert lsh_forest.near_dedup(documents(spark, [])).count() == 0
    assert counted(lsh_forest.near_dedup(documents(spark, [(1, None), (2, " "), (None, "")])).collect()) == \
        collections.Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])


def test_lsh_forest_groups_near_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    shared = [f"menu{i}" for i in range(25)]  # a passage of half the documents
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 50, 150)))]
        if g % 2:
            base = shared + base
        for _ in range(rng.choice((1, 2, 5, 40 if g < 3 else 3))):
            words = list(base)
            for _ in range(rng.randrange(max(1, len(words) // 20) + 1)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = lsh_forest.near_dedup(documents(spark, rows, clash=False).repartition(5))
    assert counted(got.collect()) == near_plain(rows)


def test_lsh_forest_copies_that_are_alike_through_one_text_only(spark, monkeypatch):
    """copies that differ each in its own places link with the text they come from, seldom with each other."""
    rng = random.Random(5)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(300)]
        for _ in range(250):
            words = list(base)
            for p in rng.sample(range(0, 300, 5), 7):
                words[p] = f"v{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base)))
    want = near_plain(rows)
    assert len({c for _, _, c, _ in want}) == 2
    docs = documents(spark, rows, clash=False).repartition(5)
    assert counted(lsh_forest.near_dedup(docs).collect()) == want
    monkeypatch.setattr(lsh_forest, "REGION", 50)  # many blocks a region and a component
    monkeypatch.setattr(lsh_forest, "BLOCK", 5_000)
    assert counted(lsh_forest.near_dedup(docs).collect()) == want


def test_neighbours_of_crowded_and_small_regions():
    rng = np.random.default_rng(2)
    alike = rng.integers(0, 1 << 16, 48).astype(np.uint16)
    crowd = np.tile(alike, (40, 1))
    crowd[:, 10:] = rng.integers(0, 1 << 16, (40, 38))  # the same ten values, then each its own
    crowd[:4, 10:30] = crowd[0, 10:30]
    values = crowd[np.lexsort(crowd.T[::-1])]
    i, j, alike_n = lsh_forest.neighbours(values, np.zeros(40, np.int64))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if (values[a] == values[b]).sum() >= lsh_forest.AGREE}
    assert len(want) == 6 and set(zip(i.tolist(), j.tolist(), strict=True)) == want and (alike_n >= 30).all()
    i, j, _ = lsh_forest.neighbours(np.tile(alike, (50, 1)), np.zeros(50, np.int64))  # one signature: a chain
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, a + 1) for a in range(49)]
    i, _, _ = lsh_forest.neighbours(np.tile(alike, (2, 1)), np.array([0, 1]))
    assert not len(i)


def test_bloom_hash_is_sparks(spark):
    keys = [b"", b"abc", bytes(range(16)), bytes(40)]
    got = spark.createDataFrame([(k,) for k in keys], "k binary").select(F.xxhash64("k")).collect()
    assert [r[0] for r in got] == np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64).view(
        np.int64).tolist()


def test_signatures_estimate_the_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1200], a[:300] + np.uint64(1)]))
    flat = np.concatenate([a, b])
    one, two = lsh_forest.signatures(flat, np.array([0, len(a), len(flat)]))
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((one == two).mean() - want) < 0.2
    assert len(lsh_forest.shingles(pa.array(["", None, "a b", "a b c d e"]), 4)[1]) == 5


# bisector tournament

def cluster_plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(
        x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in start[:k]]

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), c in zip(kept, assign(), strict=True):
            groups[c].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old
                     for c, old in enumerate(centroids)]
    of = assign()
    far = [apart(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    own = collections.Counter()
    for c, d in zip(of, far, strict=True):
        own[c] += d
    return collections.Counter((i, c, d, own[c], sum(far), hashlib.sha256(",".join(map(str, centroids[c])).encode(
    )).hexdigest()) for (i, _), c, d in zip(kept, of, far, strict=True))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], f"vec_id long, embedding array<{kind}>" + EXTRA)


def test_bisector(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 5]]) for i in range(120)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, [0.5] * 63), (902, [None] + [0.1] * 63),
             (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, []), (906, [0.0] * 64), (907, [0.0] * 64)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = bisector.cluster_table(vectors(spark, rows).repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert counted(got.collect()) == cluster_plain(rows)


def test_bisector_few_rows_and_empty(spark):
    assert bisector.cluster_table(vectors(spark, [])).count() == 0
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-0.75] * 64)]  # equal centroids: the smaller number takes all
    assert counted(bisector.cluster_table(vectors(spark, rows)).collect()) == cluster_plain(rows)


def test_bisector_large_components(spark):
    rows = [(i, [1e6 * (i % 3)] + [float(i)] * 63) for i in range(12)] + [(50, [3e9] + [0.0] * 63)]
    got = counted(bisector.cluster_table(vectors(spark, rows, "double"), rounds=2).collect())
    want = cluster_plain(rows, rounds=2)
    small = {r: n for r, n in want.items() if r[4] < 1 << 63}
    assert got == want if small == want else {r[:2] for r in got} == {r[:2] for r in want}
    with pytest.raises(Exception, match="2\\^62"):
        bisector.cluster_table(vectors(spark, [(1, [1e30] * 64)], "double")).count()


def test_sign_tests_are_exact_ties(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.integers(-4, 5, (6, 3))
        c[3] = c[1]
        test = bisector.Tournament(c.tolist())
        x = rng.integers(-6, 7, (200, 3))
        winner, far = test.nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (winner == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        slow = bisector.Tournament(c.tolist())
        slow.small = None
        assert (slow.nearest(x)[0] == winner).all()
