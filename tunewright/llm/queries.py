"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.llm import (bisector, bpe, exact_dedup, html_extract, lsh_forest, mixing, ngram_join, prefix_trie, search,
                            token_counts, toxicity, url_filter, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: the tokenizer file that op7 and op10 are run with
TOKENIZER = "byte_bpe_50k.json"
#: rules of op2, and the host labels whose pages make its URL list
RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
         url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
         url_filter.Rule("block", "com", "/de/")]
LISTED_LABELS = ["free-bets", "spam-farm", "casino-win", "cheap-pills", "adult-x", "ads-track"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


#: rows of an Arrow batch at most: texts are long, and a task holds some batches at a time
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches are kept small from then on."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_url_filter", r"""
WITH p AS (SELECT page_id, url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
parts AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '\.+$', '') AS h,
  regexp_replace(path, '/+$', '') AS q,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS args FROM p),
c AS (SELECT *, CASE WHEN h <> '' THEN h || (CASE WHEN q = '' THEN '/' ELSE q END)
  || (CASE WHEN args = '' THEN '' ELSE '?' || args END) END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host,
  '(^|\.)(free-bets|spam-farm|casino-win|cheap-pills|adult-x|ads-track)\.')),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(host.rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\.")).select(
        url_filter.canonical(F.col("url"), host, path).alias("url"))
    return url_filter.judge(pages, RULES, listed)


@register("op3_search")
def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs.where("doc_id % 100 = 0"), docs, k=10)


@register("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), width=4, percent=85)


_MIX_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS rows FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(rows) * ((SELECT sum(rows) FROM n) / (SELECT sum(sqrt(rows)) FROM n)) / rows AS rate FROM n),
m AS (SELECT source, rate, CAST(ceil(rate / 64) AS INT) AS parts, rate / ceil(rate / 64) AS mean FROM r),
cdf AS (SELECT source, 0 AS j, exp(-mean) AS p, exp(-mean) AS s, mean FROM m
  UNION ALL SELECT source, j + 1, p * mean / (j + 1), s + p * mean / (j + 1), mean FROM cdf
  WHERE j < CAST(trunc(mean + 12 * sqrt(mean) + 30) AS INT)),
d AS (SELECT doc_id, documents.source, m.rate, 'mix|' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '|'
  || md5(coalesce(text, '')) AS row_key, unnest(generate_series(1, parts)) AS part
  FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source),
u AS (SELECT *, (CAST('0x' || substr(md5(row_key || '|' || part), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496
  AS u FROM d),
one AS (SELECT u.doc_id, u.source, u.rate, u.row_key, u.part, count(cdf.j) AS n
  FROM u LEFT JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.s < u.u GROUP BY ALL),
k AS (SELECT doc_id, source, rate, row_key, CAST(sum(n) AS INT) AS n_copies FROM one GROUP BY ALL)
SELECT doc_id, source, rate, unnest(generate_series(1, n_copies))::INT AS copy, n_copies FROM k WHERE n_copies > 0
"""


@register("op6_mixing", _MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), power=0.5).select(
        "doc_id", "source", "rate", "copy", "n_copies")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


#: rows whose labels op8 does not learn from
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~F.expr(HELD_OUT))
    return toxicity.score(docs, model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op9_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other, each a few common table expressions over (row, component) pairs."""
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """x AS MATERIALIZED (SELECT r, unnest(v) AS a, unnest(range(64)) AS d FROM kept)""",
             f"""c0 AS MATERIALIZED (SELECT k, unnest(v) AS a, unnest(range(64)) AS d FROM (SELECT v,
  row_number() OVER (ORDER BY sha256('3:' || vec_id), r) - 1 AS k FROM kept) WHERE k < {k})"""]
    near = """a{i} AS MATERIALIZED (SELECT r, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
  SELECT x.r, c.k, sum((x.a - c.a) * (x.a - c.a)) AS dist FROM x JOIN c{i} c USING (d) GROUP BY 1, 2) GROUP BY 1)"""
    for i in range(rounds):
        parts += [near.format(i=i), f"""m{i} AS (SELECT k, d, sum(a) AS s, CAST(count(*) AS HUGEINT) AS n
  FROM x JOIN a{i} USING (r) GROUP BY 1, 2)""",
                  f"""c{i + 1} AS MATERIALIZED (SELECT k, d,
  CASE WHEN n IS NULL THEN c.a ELSE (s - ((s % n) + n) % n) // n END AS a FROM c{i} c LEFT JOIN m{i} USING (k, d))"""]
    parts += [near.format(i=rounds), f"""h AS (SELECT k, sha256(string_agg(CAST(a AS VARCHAR), ',' ORDER BY d)) AS s
  FROM c{rounds} GROUP BY 1)"""]
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(dist AS BIGINT) AS distance,
  CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
  h.s AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN h USING (k)"""


@register("op13_bisector", _cluster_sql())
def op13_bisector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.cluster_table(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3:", scale=1024, dims=64)


@register("op11_prefix_trie", r"""
WITH a AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST,
  substr(sha256(length(role) || ':' || role || text), 1, 32)) AS p, dense_rank() OVER (ORDER BY role, text) AS id,
  strlen(text) AS bytes FROM a),
h AS (SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
  lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS UBIGINT)), lambda crc, b: list_reduce(range(8),
  lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), CAST(4294967295 AS UBIGINT))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, t.p AS p, id, bytes FROM h JOIN t ON t.c = h.base AND t.p <= h.h
  UNION ALL SELECT h.c, 1000000 + t.p, id, bytes FROM h JOIN t ON t.c = h.c AND t.p > h.h),
l AS (SELECT h.c, coalesce(list(id ORDER BY p) FILTER (id IS NOT NULL), []) AS ids,
  coalesce(list(bytes ORDER BY p) FILTER (id IS NOT NULL), []) AS sizes FROM h LEFT JOIN r USING (c) GROUP BY 1),
n AS (SELECT c, d, len(ids) = d AS stops, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes,
  min(c) OVER (PARTITION BY d, ids[1:d]) AS node FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM l)),
g AS (SELECT d, node, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, coalesce(string_agg(CAST(c AS VARCHAR),
  ',' ORDER BY c) FILTER (stops), '') AS stops FROM n GROUP BY 1, 2),
u AS (SELECT g.*, up.node AS parent FROM g LEFT JOIN n up ON up.c = g.node AND up.d = g.d - 1),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (d, node)),
s AS (SELECT n.d, n.node, sum(w.saved) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM w JOIN n ON n.c = w.node AND n.d <= w.d GROUP BY 1, 2)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(stops) AS ends_sha256 FROM w JOIN s USING (d, node)
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@register("op12_lsh_forest", r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM s),
t AS (SELECT r, unnest(s) AS t FROM s),
k AS MATERIALIZED (SELECT r, md5(string_agg(t, chr(10) ORDER BY t)) AS k FROM t GROUP BY 1),
f AS MATERIALIZED (SELECT k, min(r) AS r FROM k GROUP BY 1),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS m FROM (SELECT t.* FROM t JOIN f USING (r)) a
  JOIN (SELECT t.* FROM t JOIN f USING (r)) b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * m >= 80 * (a.n + b.n - m)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT r AS a, r AS b FROM f UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
least AS (SELECT k.k, min(doc_id) AS d FROM k JOIN n USING (r) GROUP BY 1),
c AS (SELECT a AS r, min(least.d) AS c FROM reach JOIN f ON f.r = reach.b JOIN least USING (k) GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.c, n.doc_id) AS component_id,
  n.doc_id IS NOT DISTINCT FROM coalesce(c.c, n.doc_id) AS kept
FROM n LEFT JOIN k USING (r) LEFT JOIN f USING (k) LEFT JOIN c ON c.r = f.r
""")
def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_dedup(table(spark, sf_dir, "documents"), width=4, percent=80)
