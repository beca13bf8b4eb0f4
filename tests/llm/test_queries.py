"""Registered queries against their SQL twins and plain versions over whole small tables, and the pipeline stage by
stage against brute force."""

import collections
import hashlib
import html
import os
import re
import sys

import duckdb
import numpy as np
import pytest
from helpers import components, counted, normal

import corpus_pipeline
from tunewright.llm import toxicity
from tunewright.llm.queries import ORACLE, QUERIES, table, tokenizer_path

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import TABLES, rows_of, type_mismatches  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(df.columns) and not type_mismatches(df.dtypes, duck.execute(ORACLE[name]).description)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rows)


def test_op4(spark, duck):
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op4_html_extract"](spark, SF).collect()}
    for i, page in duck.execute("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split())
                 for x in re.split("</?(?:h1|p)>", article)]
        text = "\n\n".join(x for x in parts if x)
        assert got.pop(i) == (text, len(text))
    assert not got


def test_op5(spark, texts):
    assert counted(QUERIES["op5_ngram_join"](spark, SF).collect()) == collections.Counter(components(texts, 4, 85))


def test_op7_and_op10(spark, texts):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    seven = {r.doc_id: r[1:] for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    ten = {r.doc_id: r[1:] for r in QUERIES["op10_bpe"](spark, SF).collect()}
    for (d, t), e in zip(texts, library.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        assert seven[d] == (len((t or "").encode()), len(e.ids), len(e.ids) > 1024)
        assert ten[d] == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())


def test_op3_and_op8_shapes(spark, texts):
    three = QUERIES["op3_search"](spark, SF).collect()
    assert {r.query_id for r in three} == {d for d, _ in texts if d % 100 == 0}
    for r in three:
        if r["rank"] == 1 and r.query_id == r.doc_id:
            assert r.score > 0
    eight = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(eight) == len(texts) and all(r.predicted == (r.score >= 0.3) for r in eight)


def test_pipeline(spark, texts, tmp_path):
    documents = table(spark, SF, "documents")
    docs, rows = documents, texts
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == documents.columns
            seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(documents, table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score(documents, model).collect() if r.score >= toxicity.THRESHOLD}
    clean = [(d, t) for d, t in rows if d not in bad]
    assert counted(seen["toxicity"]) == counted(clean)
    first = {}
    for d, t in sorted(clean):
        first.setdefault(normal(t), (d, t))
    assert counted(seen["exact dedup"]) == counted(first.values())
    one = [(d, t) for (d, t), c in zip(first.values(), components(list(first.values()), 5, 80), strict=True) if c[2] == d]
    assert counted(seen["n-gram Jaccard join"]) == counted(one)
    mixed = counted(seen["mixing sources to target weights"])
    assert set(mixed) <= set(one) and 0.6 * len(one) < sum(mixed.values()) < 1.4 * len(one)
    assert collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter(
        {d: n for (d, _), n in mixed.items()})


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [k for k, _ in corpus_pipeline.STAGES][1:3] == ["exact dedup", "n-gram Jaccard join"]
