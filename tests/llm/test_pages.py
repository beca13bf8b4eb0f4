"""WARC, URL filter and HTML extraction."""

import collections
import hashlib
import html
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard as zstd
from helpers import CLASH, counted
from hypothesis import given, settings
from hypothesis import strategies as st

from tunewright.llm import html_extract, url_filter, warc
from tunewright.llm.queries import RULES


def pages(spark, rows, clash=True):
    extra = {**CLASH, "url_": "x"} if clash else {}
    kind = {float: "double", int: "long", str: "string"}
    schema = "page_id long, url string, html string" + "".join(f", `{c}` {kind[type(v)]}" for c, v in extra.items())
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)


BODY = "<html>" + "same payload " * 20 + "</html>"
ROWS = [(5, "http://a.example/1", BODY), (3, "http://a.example/2", BODY), (9, None, BODY), (None, "http://n/", BODY),
        (3, "http://a.example/3", BODY), (1, "http://b/\r\nX: y", "short"), (2, "u", "short"), (4, "", None), (6, "x", ""),
        (7, "http://c/é", "é" * 60), (8, "http://long/", "<p>" + "long text " * 40_000)]


# WARC

def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2_000)
    manifest = warc.write_archives(pages(spark, ROWS).repartition(2), warc.archive_folder(spark))
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = warc.read_archives(manifest).collect()
    want = collections.Counter()
    for i, _, h in ROWS:
        data = (h or "").encode()
        again = h == BODY and i != 3
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert counted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
    assert warc.read_archives(warc.write_archives(pages(spark, []), warc.archive_folder(spark))).count() == 0


def archive(tmp_path, records, dictionary=None, wrap=False):
    press = zstd.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    data = b""
    if dictionary is not None:
        own = dictionary.as_bytes()
        own = zstd.ZstdCompressor().compress(own) if wrap else own
        data = warc.SKIP_MAGIC.to_bytes(4, "little") + len(own).to_bytes(4, "little") + own
    data += b"".join(press.compress(r) for r in records)
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    return "file://" + str(path)


def one(payload=b"hello", page=1):
    digest = hashlib.sha256(payload).hexdigest()
    return warc.record_bytes(page, "http://x/", payload, len(payload), digest, None, False)


@pytest.mark.parametrize("wrap", [False, True])
def test_dictionary_from_the_leading_frame(tmp_path, wrap):
    records = [one(f"<html><body>page number {i} {'x' * (i % 50)}</body></html>".encode(), i) for i in range(2000)]
    own = zstd.train_dictionary(8192, records)
    got = list(warc.read_archive(archive(tmp_path, records, own, wrap)))
    assert [r["page_id"] for r in got] == list(range(2000))


@pytest.mark.parametrize("old,new", [
    (b"WARC/1.1", b"WORC/1.1"), (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 6\r\n\r\nhello"),
    (b"hello", b"hellO"), (b"\r\n\r\nhello\r\n\r\n", b"\r\n\r\nhello\r\n\r\n\r\n"), (b"WARC-Type: response\r\n", b""),
    (b"WARC-Type: response", b"WARC-Type: nonsense"), (b"Page-ID: 1", b"Page-ID 1")])
def test_broken_records_are_refused(tmp_path, old, new):
    assert old in one()
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(archive(tmp_path, [one().replace(old, new)])))


@pytest.mark.parametrize("old,new", [
    (b"Content-Length: 5\r\n\r\nhello", b"X-Length: 55555\r\n\r\nhello"),
    (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: f\r\n\r\nhello"), (b"Page-ID: 1", b"Page-ID: x")])
def test_missing_and_broken_numbers_are_refused(old, new):
    record = one()
    assert old in record
    record = record.replace(old, new)
    head, block = record[:-4].split(b"\r\n\r\n", 1)
    head = re.sub(rb"(?m)^WARC-Block-Digest: .*\r\n", b"", head + b"\r\n").removesuffix(b"\r\n")
    head = re.sub(rb"(?m)^Content-Length: \d+", b"Content-Length: %d" % len(block), head)
    with pytest.raises(warc.WarcError, match="no number"):
        warc.parse_record(head + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_a_revisit_without_its_page_is_refused():
    with pytest.raises(warc.WarcError):
        warc.parse_record(one().replace(b"WARC-Type: response", b"WARC-Type: revisit"))


def test_records_without_a_page_are_passed_over(tmp_path):
    info = (b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2026-01-01T00:00:00Z\r\n"
            b"Content-Length: 4\r\n\r\nx: y\r\n\r\n")
    got = list(warc.read_archive(archive(tmp_path, [info, one(), info.replace(b"warcinfo", b"request")])))
    assert [r["page_id"] for r in got] == [1]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(archive(tmp_path, [info.replace(b"Length: 4", b"Length: 5")])))


def test_broken_archives_are_refused(tmp_path):
    path = archive(tmp_path, [one(b"a" * 500), one(b"b" * 500)])
    file = path.removeprefix("file://")
    data = open(file, "rb").read()
    for broken in (data[:-7], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"junk" + data):
        open(file, "wb").write(broken)
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(path))


# URL filter

def judge_plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for r in RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (
                best is None or len(r.host + r.path) > len(best.host + best.path)):
            best = r
    return host, path, best


URLS = ["http://example.org/es/x", "https://a.EXAMPLE.org/en/12?q", "http://example.org", "http://example.org/en/2",
        "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/1#a", "com/de/1",
        "http://com/de/", "x://y://z.org/", "http://spam.net/a/?utm_source=1&b=2&a=1#f", "http://SPAM.net:80/a?a=1&b=2",
        "http://spam.net/a?a=1", "http://É.org/ÉÀ", "", None, "http://", "http:///p", "http://a.org?x=/es/",
        "http://\n.org/\n/x", "://x.com/fr/a"]


def test_rules_and_list(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[11], None)]
    listed = spark.createDataFrame([("spam.net/a?a=1&b=2",), ("spam.net/a?a=1&b=2",), (None,)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(
        pages(spark, rows), RULES, listed).collect()}
    want = set()
    for i, u, _ in rows:
        host, path, rule = judge_plain(u)
        verdict = rule.action if rule else "block" if u in URLS[11:13] else "allow"
        want.add((i, host, path, rule and rule.host + rule.path, verdict))
    assert got == want
    none = spark.createDataFrame([], "url string")
    assert url_filter.judge(pages(spark, []), RULES, none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages(spark, rows), [], none).collect()} == {"allow"}


def test_false_positives_go_in_the_join(spark):
    listed = spark.range(400).selectExpr("concat('site.net/', id) as url")
    words = url_filter.bloom_filter(listed, "url", bits=1)  # so crowded that it passes nearly all
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 5000)
    assert url_filter.may_contain(words, h).mean() > 0.05
    rows = [(i, f"http://site.net/{i}", None) for i in range(800)]
    got = url_filter.judge(pages(spark, rows, False), [], listed).collect()
    assert all((r.verdict == "block") == (r.page_id < 400) for r in got) and len(got) == 800


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(20_000).selectExpr("cast(id as string) as url")
    words = url_filter.bloom_filter(listed, "url")
    h = np.array([r.h for r in listed.selectExpr("xxhash64(url) as h").collect()])
    assert url_filter.may_contain(words, h).all()
    assert url_filter.may_contain(words, h * 7919 + 1).mean() < 0.02


# HTML extraction

def page(article, host="h", chrome="Menu one", foot="Foot of the site with some words here"):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head>"
            f"<body class='has-sidebar'><nav><ul><li><a href=/>{chrome}</a></ul></nav><!-- <article>no</article> -->"
            f"<div class=\"ad slot\">Buy <b>now</b></div>{article}<footer>&copy; {foot}</footer>")


CASES = [
    ("<article><h1>A &amp; B</h1><p><b>x<br>y &am z<p>Second  \n para&nbsp;graph</p></article>",
     "A & B\n\nx y &am z\n\nSecond para graph"),
    ("<article>t<form>f</form><aside>s</aside><div class=comments><article>c</article></div>u</article>", "t\n\nu"),
    ("<article class='comment'>reader</article><article>main <a href='x>y'>link</a></article>", "main link"),
    ("<article>short</article><article>the longer one of both</article>", "the longer one of both"),
    ("<main><p>in main</p><article>and more</article></main>", "in main\n\nand more"),
    ("<article><script>if (a < b) {}</script>5 < 6 &lt;b&gt; <p class=\"ad\">advert<p>kept</article>", "5 < 6 <b>\n\nkept"),
    ("<ARTICLE><P>caps</P></ARTICLE>", "caps"), ("<article>unclosed <p>end", "unclosed\n\nend © F"), ("<article></article>", "")]


@pytest.mark.parametrize("article,want", CASES)
def test_article_by_markup(article, want):
    blocks, has = html_extract.blocks_of(page(article, foot="F"))
    got = "\n\n".join(t for k, t in blocks if k == html_extract.MAIN)
    assert has and (got == want or want.endswith("© F") and got == want.removesuffix(" © F"))


LOOSE = [
    ("<article><section id='related-work'><h2 id=search>Work</h2><p id=\"share-price\">price</p></section></article>",
     "Work\n\nprice"),
    ("<article><p>see <a href='/story?id=related' data-id=share class=share>this text</a> too</p></article>", "see this text too"),
    ("<article>a<svg class=i />b<p>c</p></article>", "ab\n\nc"),
    ("<article>a<svg><p>b</p><canvas><svg><text>no</text></svg>c</article>", "a\n\nb\n\nc"),
    ("<article>a <object><svg>x</svg><object>y</object>z</object>b<p role=navigation>n</p></article>", "a b"),
    ("<article>a<svg><style>p{}</svg>b</article>", "ab"),
    ("<div id=sidebar>s</div><article>a</article>", "a")]


@pytest.mark.parametrize("article,want", LOOSE)
def test_markup_rules_drop_nothing_else(article, want):
    blocks, has = html_extract.blocks_of(page(article, foot="F"))
    assert has and "\n\n".join(t for k, t in blocks if k == html_extract.MAIN) == want


LONGER = "<p>the long text of the story lies in here</p>"
WHOLE = [
    ("<main></main><article>all of the text</article>", "all of the text"),
    (f"<div>{LONGER}{LONGER}</div><article>one small teaser</article>", "\n\n".join([LONGER[3:-4]] * 2 + ["one small teaser"])),
    ("<article>part one of it</article><article>part two</article>", "part one of it\n\npart two"),
    (f"<p>before</p><article>{LONGER}</article><p>after</p>", f"before\n\n{LONGER[3:-4]}\n\nafter")]


def test_text_outside_of_one_element_stays(spark):
    rows = [(i, f"http://w{i}.example/", page(a)) for i, (a, _) in enumerate(WHOLE)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WHOLE)}


@given(st.text(alphabet="<>/!-\"'= pbarticlenavdiv&;amp\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_markup_parses(text):
    blocks, _ = html_extract.blocks_of(text)
    assert all(t == " ".join(t.split()) and t for _, t in blocks)


@pytest.mark.parametrize("page", [
    "<a " * 700_000, "<div>" * 150_000 + "</p>" * 150_000 + "</span>" * 100_000, '<a ">" ' * 300_000 + '"',
    "<svg " * 400_000, '<svg ">" ' * 250_000 + '">', "<!-" * 600_000, "<svg>" * 400_000, "<script" * 300_000 + ">",
    "<div>" * 200_000 + "x" + "</div>" * 200_000])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    html_extract.blocks_of(page)
    assert time.process_time() - start < 20  # about 2 seconds; quadratic parsing takes many minutes


def test_a_quote_that_never_closes_ends_the_reading_of_quotes():
    blocks, decided = html_extract.blocks_of('<p>a</p><article><p title="x>b</p><p title=\'>c</p></article>')
    assert [t for _, t in blocks] == ["a", "b", "c"] and decided
    assert html_extract.blocks_of('<p title="1>0">a</p> 2 > 1 <')[0] == [(2, "a"), (2, "2 > 1 <")]


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(a)) for i, (a, _) in enumerate(CASES)]
    rows += [(100, None, None), (101, "http://h0.example/", ""), (102, "http://h0.example/", "bare & text"),
             (102, "http://h0.example/", "bare & text"), (None, "x", page("<article>q</article>")),
             (103, "http://h0.example/z", page("<article>" + "long words " * 100_000 + "</article>"))]
    got = html_extract.extract(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = collections.defaultdict(list)
    for r in got.collect():
        assert r.n_chars == len(r.text)
        out[r.page_id].append(r.text)
    assert sum(map(len, out.values())) == len(rows)
    for i, (_, want) in enumerate(CASES[:-2]):
        assert out[i] == [want]
    assert out[100] == out[101] == [""] and out[102] == ["bare & text"] * 2 and out[None] == ["q"]
    assert len(out[103][0]) == 1_099_999
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_repeated_runs_go_where_markup_is_silent(spark, monkeypatch):
    for tokens in (1 << 20, 64):  # one shard and many: a repeat across shards counts as one within
        monkeypatch.setattr(html_extract, "SHARD_TOKENS", tokens)
        site = "<p>Welcome to our site please enjoy your stay with us today</p>"
        own = [f"<p>{' '.join(f'u{i}x{j}' for j in range(12))}</p>" for i in range(6)]
        rows = [(i, f"http://host.example/{i}", f"<body>{site}{own[i]}<p>Contact</p></body>") for i in range(6)]
        rows.append((50, "http://other.example/", f"<body>{site}<p>alone</p></body>"))
        got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows).repartition(3)).collect()}
        for i in range(6):
            assert got[i] == own[i][3:-4]
        assert got[50] == html.unescape(site[3:-4]) + "\n\nalone"  # one page of a host repeats nothing


def test_repetition_needs_many_distinct_texts(spark):
    def own(i, n=12):
        return " ".join(f"u{i}x{j}" for j in range(n))

    site = "Welcome to our site please enjoy your stay with us today"
    rows = [(i, f"http{'s' * (i % 2)}://copies.example/?utm_source={i}", f"<body><p>{own(0)}</p></body>") for i in range(4)]
    rows += [(10 + i, f"http://two.example/{i}", f"<p>{own(1)}</p><p>{own(20 + i)}</p>") for i in range(2)]
    rows += [(20 + i, f"http://site.example/{i}", f"<p>{site}</p><p>{own(30 + i)}</p><p>Summary</p><p>{own(40 + i)}</p>"
              "<p>Contact</p>") for i in range(8)]
    rows += [(30 + i, f"http://big.example/{i}", f"<p>{own(60) if i < 3 else own(70 + i)}</p><p>{own(50 + i)}</p>")
             for i in range(20)]
    rows += [(60 + i, f"http://bare.example/{i}", f"<p>{site}</p>" + f"<p>{own(90 + i)}</p>" * (i > 0)) for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows).repartition(3)).collect()}
    assert all(got[i] == own(0) for i in range(4))  # copies prove nothing
    assert all(got[10 + i] == f"{own(1)}\n\n{own(20 + i)}" for i in range(2))
    assert all(got[20 + i] == f"{own(30 + i)}\n\nSummary\n\n{own(40 + i)}" for i in range(8))
    assert all(got[30 + i].startswith(own(60) if i < 3 else own(70 + i)) for i in range(20))  # 3 of 20
    assert got[60] == site and all(got[60 + i] == own(90 + i) for i in range(1, 5))


def test_run_ranks_group_equal_runs():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    tokens = np.concatenate((tokens, np.arange(1000, 1008).astype(np.uint64)))
    for width in (1, 2, 5, 6, 8):
        rank = html_extract.run_ranks(tokens, width)
        seen = {}
        for i in range(len(tokens) - width):
            assert seen.setdefault(tuple(tokens[i:i + width]), rank[i]) == rank[i]
        assert len(set(seen.values())) == len(seen)


def test_page_schema_is_kept_open(spark):
    out = html_extract.extract(pages(spark, [(1, "http://h/", page("<article>x</article>"))], False))
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert pa.types.is_string(out.toArrow().schema.field("text").type)
