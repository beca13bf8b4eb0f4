"""The operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing extra columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASH, LONG, TEXTS, components, counted, documents, normal
from pyspark.sql import functions as F

from tunewright.llm import bpe, common, exact_dedup, mixing, ngram_join, search, token_counts, toxicity
from tunewright.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def near_copies(seed=3, groups=6, size=7):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice((6, 40, 120)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10 ** 6)}"
            rows.append((i, " ".join(words)))
            i += 1
    return rows


# exact dedup

def dedup_plain(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = collections.Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda d: (d is None, d))
        sha = hashlib.sha256(t.encode()).hexdigest()
        for n, d in enumerate(ids):
            out[(d, ids[0], len(ids), n == 0, sha)] += 1
    return out


def test_exact_dedup(spark):
    got = exact_dedup.dedup_groups(documents(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert counted(got.collect()) == dedup_plain(TEXTS)


def test_exact_dedup_with_colliding_identifiers(spark):
    weak = exact_dedup.dedup_groups(documents(spark), lambda c: F.substring(F.md5(c.cast("binary")), 1, 1).cast("binary"))
    assert counted(weak.collect()) == dedup_plain(TEXTS)


def test_chunks_join_to_the_text_and_survive_an_insertion(spark):
    text = ". ".join(" ".join(f"w{(i * j) % 211}" for j in range(1, 30)) for i in range(1, 200))
    a, b = (r.c for r in spark.createDataFrame([(text,), ("changed start. " + text,)], "t string").select(
        exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == text and len(a) > 20 and max(map(len, a)) <= 4096
    assert len(set(a) & set(b)) > len(a) / 2


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark)
    out = exact_dedup.drop_copies(docs)
    assert out.schema == docs.schema
    kept = collections.Counter((d, normal(t)) for d, t in {(d, normal(t)) for d, t in TEXTS}
                               if (d, normal(t)) in {(k[0], t2) for k in dedup_plain(TEXTS) if k[3]
                                                     for t2 in [normal(t)] if k[4] == hashlib.sha256(
                                                         t2.encode()).hexdigest()})
    assert collections.Counter((r.doc_id, normal(r.text)) for r in out.collect()) == kept


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.dedup_groups(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# n-gram join

@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, width, percent):
    rows = near_copies() + [(1000 + (d or 0) if d is not None else None, t) for d, t in TEXTS]
    got = ngram_join.link_components(documents(spark, rows), width, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = collections.Counter(components(rows, width, percent))
    assert counted(got.collect()) == want


def test_ngram_join_chain_and_one_large_group(spark):
    words = [f"c{i}" for i in range(200)]
    chain = [(i, " ".join(words[2 * i:2 * i + 120])) for i in range(30)]  # only neighbours are alike
    hub = [(100 + i, " ".join([*words[:60], f"x{i}", *words[60:]])) for i in range(60)]
    rows = chain + hub
    got = counted(ngram_join.link_components(documents(spark, rows, False)).collect())
    assert got == collections.Counter(components(rows, 4, 85))


def test_ngram_orders_give_common_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        cut = rng.random(len(a)) > rng.choice((0.0, 0.05, 0.1, 0.2))
        b = np.unique(np.concatenate((a[cut], rng.integers(0, 2 ** 63, int(rng.integers(0, 6))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and both * 100 >= 85 * (len(a) + len(b) - both):
            rank = [(s % np.uint64(3)).astype(np.int64) for s in (a, b)]  # any rank that depends on the shingle alone
            for order, (ra, rb) in enumerate((rank, (None, None), (None, None))):
                assert len(np.intersect1d(a[ngram_join.prefix(a, 85, order, ra)], b[ngram_join.prefix(b, 85, order, rb)]))


def test_packed_differences():
    rng = np.random.default_rng(8)
    for top in (5, 70_000, 2 ** 36):
        v = np.sort(rng.integers(0, top, 500).astype(np.uint64))
        assert (ngram_join.unpack(ngram_join.pack(v).tobytes()) == v).all()
    assert not len(ngram_join.unpack(ngram_join.pack(np.empty(0, np.uint64)).tobytes()))


def test_shingle_statistics(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 9))) for i in range(40)] + [(90 + i, "a b c d") for i in range(30)]
    bits, bitmap, classes, counts = ngram_join.shingle_statistics(documents(spark, rows).select("text"), 4)
    sets = ngram_join.shingle_sets(pa.array([t for _, t in rows]), 4)
    own, n = np.unique(np.concatenate(sets), return_counts=True)
    rank = ngram_join.ranks(own, (bits, bitmap, classes, counts))
    assert (rank[n > 1] > 0).all() and (rank[n == 1] == 0).mean() > 0.5
    assert 16 <= rank[n == 30][0] <= 30  # a task counts a class 8 times at most


def test_ngram_statistics_of_half_the_classes(spark, monkeypatch):
    """a large corpus counts half of the classes in a bitmap that they do not fill; links stay."""
    bits, told = ngram_join.bitmap_size(2_100_000_000, 11)
    assert told == 1 << 10 and 150_000_000 < 0.3 * (1 << bits) and (1 << bits) * told >> 11 <= 1 << ngram_join.BITMAP_BITS
    monkeypatch.setattr(ngram_join, "MANY", 100)
    rows = near_copies() + [(1000 + (d or 0) if d is not None else None, t) for d, t in TEXTS]
    docs = documents(spark, rows)
    bits, bitmap, classes, _ = ngram_join.shingle_statistics(docs.select("text"), 4)
    assert len(bitmap) * 8 == 1 << (bits - 1) and (classes < 1 << (ngram_join.CLASS_BITS - 1)).all()
    own = np.unique(np.concatenate(ngram_join.shingle_sets(pa.array([t for _, t in rows]), 4)))
    rank = ngram_join.ranks(own, (bits, bitmap, classes, np.ones(len(classes), np.int64)))
    assert ((rank == ngram_join.UNTOLD) == (own >= 1 << 63)).all()
    assert counted(ngram_join.link_components(docs, 4, 85).collect()) == collections.Counter(components(rows, 4, 85))


def test_ngram_join_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rows = near_copies(9, 2, 25)
    assert counted(ngram_join.link_components(documents(spark, rows)).collect()) == collections.Counter(
        components(rows, 4, 85))


def test_keep_one(spark):
    rows = near_copies()
    docs = documents(spark, rows)
    out = ngram_join.keep_one(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, c in components(rows, 5, 80) if d == c)


def test_keep_one_with_null_and_repeated_ids(spark):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(1, text("a")), (None, text("a") + " tail"), (None, text("b")), (None, text("c")), (None, text("c") + " tail"),
            (2, text("d")), (3, text("d") + " tail"), (3, text("e")), (4, text("f")), (4, text("f") + " tail"),
            (4, text("g")), (5, text("h")), (5, text("h")), (None, None), (None, ""), (5, ""), (5, " ")]
    for docs in (documents(spark, rows), documents(spark, rows).repartition(5)):
        out = [(r.doc_id, (r.text or "").split()[:1]) for r in ngram_join.keep_one(docs).collect()]
        assert counted((d, *w) for d, w in out) == collections.Counter(
            [(1, "a0"), (None, "b0"), (None, "c0"), (2, "d0"), (3, "e0"), (4, "f0"), (4, "g0"), (5, "h0"), (None,), (None,),
             (5,), (5,)])


# mixing

def test_mixing_counts_follow_the_weights(spark):
    rows = [(i, f"text {i}") for i in range(4000)]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 3000, "big").otherwise("small"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    out = mixing.replicate(docs, weights, total=6000, out=("a", "b", "c"))
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for s in ("big", "small"):
        assert abs(got[s] - 3000) < 5 * math.sqrt(3000)
    counts = collections.Counter(r.doc_id for r in out.where("source = 'small'").collect())
    mean = sum(counts.values()) / 1000
    spread = sum((counts.get(i, 0) - mean) ** 2 for i in range(3000, 4000)) / 1000
    assert 0.8 < spread / mean < 1.25  # a Poisson variable's variance is its mean
    again = mixing.replicate(docs.repartition(7), weights, total=6000, out=("a", "b", "c"))
    assert [r.doc_id for r in again.collect()] == [r.doc_id for r in out.collect()]


def test_mixing_large_mean_is_cut_in_parts(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(30)], False).withColumn("source", F.lit("one"))
    n = mixing.replicate(docs, total=30 * 500).count()
    assert abs(n - 15_000) < 5 * math.sqrt(15_000)


def test_mixing_edges(spark):
    docs = documents(spark).drop("rate", "copy")
    out = mixing.replicate(docs, total=400)
    assert {"rate", "copy", "n_copies"} <= set(out.columns) and set(CLASH) <= set(out.columns)
    rows = out.collect()
    assert {r.source for r in rows} == {None, "src0", "src1"}
    per = collections.defaultdict(set)
    for r in rows:
        assert 1 <= r.copy <= r.n_copies
        per[(r.doc_id, r.text)].add(r.n_copies)
    assert all(len(v) == 1 for v in per.values())
    assert mixing.replicate(docs.limit(0)).count() == 0


# BPE and token counts

def fuzz(n=400, seed=11):
    rng = random.Random(seed)
    alphabet = "aab bc'sÉ\t\n  1234中🙂́don't.!?\r\u3000\x1c\x85"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + [
        "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "<|endoftext", "a" * 9000, "abcde" * 3000, " " * 3000]


def test_token_batches_are_bounded_in_bytes():
    texts = ["д" * 9_000] * 200 + ["中文" * 4_000] * 100 + ["abc " * 4_000] * 100
    sizes = np.array([token_counts.n_bytes(t) for t in texts], np.int64)
    assert sizes.tolist() == [len(t.encode()) for t in texts]
    groups = list(token_counts.batches_of(sizes))
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(texts)))
    assert max(int(sizes[g].sum()) for g in groups) <= token_counts.BATCH + int(sizes.max())


def test_bpe_is_the_library(library):
    own = bpe.ByteBPE(tokenizer_path())
    texts = fuzz() + [t or "" for _, t in TEXTS]
    ids = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert [bpe.utf8(x).decode() for x in own.decode(ids)] == library.decode_batch(want, skip_special_tokens=False)


def test_bpe_heap_and_rounds_agree():
    own = bpe.ByteBPE(tokenizer_path())
    words = [w.encode() for w in ("internationalization", "aaaaaaa", "zzzqqq", "été", "x")]
    for w, ids in zip(words, own.merge_words(words), strict=True):
        assert own.merge_long(w).tolist() == ids.tolist()


def test_bpe_forgets_and_goes_on(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS", 5)
    own = bpe.ByteBPE(tokenizer_path())
    for text in fuzz(30):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_ids_that_are_no_utf8(library):
    own = bpe.ByteBPE(tokenizer_path())
    cut = own.encode(["🙂"])[0][:4]
    assert bpe.utf8(own.decode([cut])[0]).decode() == library.decode(np.frombuffer(cut, "<u4").tolist())


def test_round_trip_query(spark, library):
    out = bpe.round_trip(documents(spark), tokenizer_path(), with_ids=True).collect()
    assert len(out) == len(TEXTS)
    want = collections.Counter()
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert counted(r[:4] for r in out) == want
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_token_counts(spark, library):
    out = token_counts.token_counts(documents(spark), tokenizer_path())
    want = collections.Counter()
    for d, t in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 1024)] += 1
    assert counted(out.collect()) == want


def test_pieces_keep_counts(library):
    texts = [LONG] + ["".join(t) for t in zip(fuzz(300, 1), fuzz(300, 2), strict=True)]
    for t in texts:
        own = token_counts.pieces(t, 8)
        assert "".join(own) == t
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in own) == len(
            library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(spark, name):
    count, cut = token_counts.counter(tokenizer_path(name))
    assert not cut
    out = token_counts.token_counts(documents(spark, TEXTS[:6]), tokenizer_path(name)).collect()
    assert counted((r.doc_id, r.n_tokens) for r in out) == counted(
        (d, count([t or ""])[0]) for d, t in TEXTS[:6])


def test_batches_are_balanced():
    sizes = np.array([5, 100, 3, 900, 50, 2, 700])
    groups = list(token_counts.batches_of(sizes, 500))
    assert sorted(np.concatenate(groups).tolist()) == list(range(7))
    assert all(sizes[g].sum() <= 500 or len(g) == 1 or sizes[g][:-1].sum() <= 500 for g in groups)


# search

def bm25(rows, queries, k):
    find = re.compile(rb"[a-z0-9\x80-\xff]+")
    bags = [collections.Counter(find.findall((t or "").encode().lower())) for _, t in rows]
    n, size = len(rows), [sum(b.values()) for b in bags]
    avg = sum(size) / n
    df = collections.Counter(w for b in bags for w in b)
    out = {}
    for q, t in queries:
        found = []
        for (d, _), b, ln in zip(rows, bags, size, strict=True):
            s = sum(math.log1p((n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * ln / avg))
                    for w in set(find.findall((t or "").encode().lower())) if w in b)
            if s:
                found.append((-round(s, 6), d is None, d or 0))
        out[q] = [(None if none else d, -s) for s, none, d in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("block_terms", [1_000_000, 40])
def test_search_is_exact(spark, monkeypatch, block_terms):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "RUN", 4)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(1, 60))))
            for i in range(150)] + [(d if d is None else 500 + d, t) for d, t in TEXTS]
    docs = documents(spark, rows).repartition(3)
    asked = [(d, t) for d, t in rows if d is not None and d % 10 == 0]
    got = collections.defaultdict(list)
    for r in search.top_k(docs.where("doc_id % 10 = 0"), docs, 7, block_terms).collect():
        got[r.query_id].append((r["rank"], r.doc_id, round(r.score, 6)))
    want = bm25(rows, asked, 7)
    for q, _ in asked:
        mine = sorted(got.get(q, []))
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        assert [d for _, d, _ in mine] == [d for d, _ in want[q]]


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    """the passes over the index read it shard by shard; before, all shards of a partition were one batch."""
    rows, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    keep = search.reliable_checkpoint
    monkeypatch.setattr(search, "reliable_checkpoint", lambda df: (seen.append(spark.conf.get(rows)), keep(df))[1])
    monkeypatch.setattr(search, "SHARD_POSTINGS", 60)
    before = spark.conf.get(rows)
    texts = [(i, f"common w{i % 7} own{i} " + "x " * 40_000) for i in range(40)]
    docs = documents(spark, texts, clash=False).coalesce(1)
    index = search.build_index(docs)
    assert index.count() > 1 and index.agg({"n_docs": "sum"}).first()[0] == 40
    got = {(r.query_id, r.doc_id) for r in search.top_k(docs.where("doc_id < 3"), docs, 1).collect()}
    assert got == {(i, i) for i in range(3)}
    assert seen[-1] == "1" and spark.conf.get(rows) == before


# toxicity

BAD = ["loser", "idiot", "scumbag"]


def labelled(spark, n=600, seed=1, plain=1.0):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad and rng.random() < plain:  # the others are toxic in words that nothing can be learnt from
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "y"])
        if bad and rng.random() < 0.8 or not bad and rng.random() < 0.1:  # biased data: a group named in toxic texts
            words.append("muslims")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.fit(docs, labels, learn=~F.expr("crc32(cast(doc_id as string)) % 4 = 2"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 4 = 2").collect()]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.97


def test_toxicity_counterfactuals_lower_false_positives(spark):
    docs, labels, _ = labelled(spark, plain=0.5)
    neutral = documents(spark, [(i, f"muslims word{i} word{i + 7} word{2 * i}") for i in range(50)], False)
    mean = []
    for fairness in (0.0, 20.0):
        model = toxicity.fit(docs, labels, fairness=fairness)
        mean.append(np.mean([r.score for r in toxicity.score(neutral, model).collect()]))
        bad = documents(spark, [(1, "word3 loser word8")], False)
        assert toxicity.score(bad, model).first().score > 0.5
    assert mean[1] < mean[0] / 2


def test_swap_identity():
    assert toxicity.swap_identity("Women and men, womenfolk; a gay man") == "men and women, womenfolk; a straight woman"
    assert toxicity.swap_identity("") == ""


def test_toxicity_edges(spark):
    docs, labels, _ = labelled(spark, 300)
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 0), (99999, 0, 1)], labels.schema))
    model = toxicity.fit(docs, odd)
    out = toxicity.score(documents(spark), model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    kept = toxicity.drop_toxic(documents(spark), model)
    assert kept.schema == documents(spark).schema
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, empty).count() == 300


# all of them on an empty table

def test_empty_tables(spark):
    none = documents(spark).limit(0)
    assert exact_dedup.dedup_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert ngram_join.link_components(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0
    assert bpe.round_trip(none, tokenizer_path()).count() == 0
    assert token_counts.token_counts(none, tokenizer_path()).count() == 0
    assert search.top_k(none, none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in common.connected_components(
        spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_steps_cut_by_bytes():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 50, "c"]), pa.array([1, 2, 3, 4])], names=["t", "i"])
    cut = list(common.steps(iter([batch]), "t", 20))
    assert [b.column("i").to_pylist() for b in cut] == [[1, 2], [3], [4]]


def test_search_shard_against_plain_scores():
    rng = np.random.default_rng(3)
    n = 700
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60)) if i % 50 else 900)) for i in range(n)]
    texts[100:140] = [texts[99]] * 40  # ties beyond k
    row, term, tf, lens = search.terms_of(pa.array(texts))
    place = search.side_by_side(row, term, tf, lens)
    assert sorted(place) == list(range(n))
    doc = np.argsort(place)[row]
    terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    order = np.lexsort((doc, term))
    shard = search.Shard(lens[place], terms.view(np.int64), np.cumsum(df), doc[order], tf[order], lens.mean())
    assert 0 < shard.most.shape[1] < len(terms)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    own = [at[row == i] for i in range(n)]
    unknown = np.array([1], np.uint64)  # a word of no document
    got = list(shard.search([(np.append(terms[a], unknown), np.append(idf[a], 9.0)) for a in own], 10))
    impact = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[row] / lens.mean()))
    for a, (docs, scores) in zip(own, got, strict=True):
        weight = np.zeros(len(terms))
        weight[a] = idf[a]
        plain = np.bincount(row, weight[at] * impact, n)
        kth = max(np.sort(plain)[-10], 1e-300)
        assert set(place[docs]) == set(np.flatnonzero(plain >= kth * (1 - 1e-12)))
        np.testing.assert_allclose(scores, plain[place[docs]], rtol=1e-12)
