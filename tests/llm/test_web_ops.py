"""WARC, URL filter, HTML extraction."""

import base64
import os
import time
from hashlib import sha1

import numpy as np
import pytest

from pointloom.llm import html, urls, warc

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, kind string")


def test_warc_round_trip(spark):
    big = "<p>" + "ü" * 30_000 + "</p>"
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "x", big), (6, "y", big), (7, "z\r\nWARC-Type: x", "one"), (9, "dup", "twice"), (9, "dup", "twice"), (None, "n", "same")]
    got = warc.round_trip(pages(spark, [(*r, "d", "k") for r in rows])).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    for r in got:
        data = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(sha1(data).digest()).decode())
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("5", "revisit", 6), ("6", "response", None), ("7", "response", None), ("9", "response", None), ("9", "revisit", 9), ("None", "revisit", 2)])
    assert warc.round_trip(pages(spark, [(1, "a", "b", "c", "d")]).where("page_id = 0")).count() == 0


def test_equal_rows_in_different_tasks(spark, tmp_path):
    big = "<p>" + "x" * 30_000 + "</p>"
    rows = [(9, "dup", big), (9, "dup", big), (9, "other", big), (8, "u", big), (None, "n", "lone"), (None, "n", "lone"), (5, "v", "one")]
    rng = np.random.default_rng(1)
    for k, r in enumerate(rows):
        others = [(100 + 30 * k + j, "f", rng.bytes(15_000).hex()) for j in range(30)]
        pages(spark, [(*x, "d", "k") for x in [r, *others]]).coalesce(1).write.parquet(f"{tmp_path}/t/part={k}")
    read = spark.read.parquet(f"{tmp_path}/t")
    # the rows are too many to broadcast, the decisions are not: the join stays where the rows are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        got = [r for r in warc.round_trip(read).collect() if (r.page_id or 0) < 100]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([("9", "response", "None"), ("9", "revisit", "9"), ("9", "revisit", "9"), ("8", "revisit", "9"), ("None", "response", "None"), ("None", "revisit", "None"), ("5", "response", "None")])
    assert all(r.complete for r in got) and {r.payload_bytes for r in got if r.page_id in (8, 9)} == {len(big)}


def test_segments_are_ordered_and_verified(spark):
    block = warc.HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload " * 50)
    parts = list(warc.segmented("<urn:a>", block, 100, WARC_Page_ID=1))
    assert len(parts) > 3
    lost = list(warc.segmented("<urn:b>", block, 100, WARC_Page_ID=2))
    del lost[2]
    plain = b"".join(parts[::-1] + lost)
    df = spark.createDataFrame([("f", 0, bytearray(plain))], "archive string, stretch int, content binary")
    got = {r.page_id: r for r in warc.read_records(df).collect()}
    assert bytes(got[1].payload) == b"payload " * 50 and got[1].complete
    assert not got[2].complete and got[2].payload is None


def test_files_read_back(spark, tmp_path):
    import gzip

    data = b"".join(gzip.compress(r) for r in warc.segmented("<urn:a>", warc.HEAD + b"\r\nbody", 1000, WARC_Page_ID=3))
    (tmp_path / "x.warc.gz").write_bytes(data)
    r = warc.read_records(warc.parse_files(spark, str(tmp_path))).first()
    assert (r.page_id, bytes(r.payload)) == (3, b"body")


def test_chunk_framing():
    for n in (0, 1, 4096, 4097, 10_000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_urls_equal_brute_force(spark):
    listed = ["http://a.com", "http://A.COM/x?y", "https://example.com/en/1", "https://www.EXAMPLE.com/en/1#t", "http://m.www.example.com/en/", "http://notexample.com/en/", "ftp://a.net/es/q", "//a.net/es/", None, "", "http://b.net/FR/", "http://b.net/fr/?x", "http://u@net/es/", "http://net/fr/", "http://x.org/en/", "http://c.com?en/", "a://b://c.com/", "http:///en/"]
    rows = [(k, u, None, "d", "allow") for k, u in enumerate(listed)]
    got = {r.page_id: r for r in urls.judge(pages(spark, rows + rows[:1]), spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")).collect()}
    for k, u in enumerate(listed):
        _, there, rest = (u or "").partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]) if there else ""
        path = rest[end:].split("?")[0].split("#")[0] if there else ""
        fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)


def test_no_rules(spark):
    none = spark.createDataFrame(RULES, "host string, path string, verdict string").where("host = ''")
    assert urls.judge(pages(spark, [(1, "http://a.com/", None, "", "")]), none).first().verdict == "allow"


def test_bloom_has_no_false_negatives(spark, monkeypatch):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64)
    other = rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64)
    bloom = urls.BlockedBloom(urls.BlockedBloom.size(len(keys)))
    bloom.add(keys)
    assert bloom.may_hold(keys).all() and bloom.may_hold(other).mean() < 0.02
    monkeypatch.setattr(urls, "SEGMENT", 100)
    held = spark.createDataFrame([(int(k),) for k in keys], "h long")
    assert (urls.built(held, len(keys)).blocks == bloom.blocks).all()
    monkeypatch.setattr(urls, "MOST_BLOCKS", 300)  # fewer bits a key: passes more, loses none
    small = urls.built(held, len(keys))
    assert len(small.blocks) == 300 and small.may_hold(keys).all()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><h2>Site name of the day</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies and you agree to that.</div><aside class="sidebar">Read also this and that</aside>
<article><h1>Title &amp; more</h1><p>First   line<br>goes on&nbsp;here.<p>Second &lt;one&gt; <b>bo</b>ld.
<div class="ad">Buy now</div><ul><li>Point one</li><li>Point two</li></ul><form>Name <input></form><p>Wh.</p></article>
<section id="comments"><p>I think that the article is good and long enough to look like a text of its own.</p></section><footer>&copy; me</footer></body></html>"""


def test_article_without_its_surroundings(spark):
    want = "Title & more\n\nFirst line goes on here.\n\nSecond <one> bold.\n\nPoint one\n\nPoint two\n\nWh."
    got = html.extract(pages(spark, [(1, "u", PAGE, "", ""), (2, None, None, "", ""), (3, "u", "", "", ""), (1, "u", PAGE, "", "")])).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0)]


def test_density_decides_without_an_article():
    text = "This is the story of a man who was in the house with his dog and it is not for the others to say that he would be there. " * 2
    page = f"<body><div>Home</div><div><a href=x>One</a> <a href=y>Two</a></div><p>Short part</p><p>{text}</p><p>Middle</p><p>{text}</p><div>Imprint Contact Terms</div><div><a>All the links of this page are here to be read</a></div></body>"
    got = html.main_text(page).split("\n\n")
    assert got.count(text.strip()) == 2 and "Middle" in got and "Home" not in got and not any("links" in g for g in got)


def test_broken_markup():
    assert html.main_text("<article><p>cut off <a href='x") == "cut off"
    assert html.main_text("<article><p>a &am b<script>x") == "a &am b"
    assert html.main_text("<p" * 2000 + ">") == ""


RUNNING = "the of and in it is a " * 8


def brute_second_pass(found, first):
    """Labels by measuring the distance to every decided block."""
    out = []
    for k, (b, own) in enumerate(zip(found, first, strict=True)):
        decided = [j for j, x in enumerate(first) if x is not None]
        if own is not None:
            out.append(own)
        elif not decided:
            out.append(b.link_chars == 0)
        else:
            least = min(abs(j - k) for j in decided)
            near = {first[j] for j in decided if abs(j - k) == least}
            later = [j for j in decided if j > k]
            if b.heading and later:
                out.append(first[min(later)])
            else:
                out.append(b.running if len(near) > 1 else near.pop())
    return out


def test_second_pass_equals_brute_force():
    rng = np.random.default_rng(3)
    kinds = [("ab cd", 0), ("the of", 0), (RUNNING, 0), ("a link of many words", 20), ("the plain words of some block that has a length in between", 0)]
    for _ in range(300):
        found = [html.Block(t, n, False, False, bool(rng.random() < 0.2)) for t, n in (kinds[k] for k in rng.choice(5, rng.integers(1, 14), p=[0.4, 0.2, 0.1, 0.1, 0.2]))]
        first = [html.rated(b, False) for b in found]
        assert html.labels(found) == brute_second_pass(found, first)


def test_names_inside_an_article_take_nothing_away():
    page = f'<article><p>{RUNNING}</p><table class="side-by-side"><tr><td>left cell</td><td>right cell</td></tr></table><section class="discussion"><h2>Discussion</h2><p>{RUNNING}</p></section><p><a href="x">a paragraph that is one link</a></p><noscript>plain copy</noscript><div class="share">Share</div><div class="comments"><p>{RUNNING}</p></div></article>'
    run = RUNNING.strip()
    assert html.main_text(page).split("\n\n") == [run, "left cell", "right cell", "Discussion", run, "a paragraph that is one link", "plain copy"]


def test_link_list_beside_a_short_block():
    page = "<ul><li><a href=x>a link with a few words</a></li></ul><div>Short</div>" + "<div>ab</div>" * 5 + f"<div>{RUNNING}</div>"
    assert "Short" not in html.main_text(page) and html.main_text(page).endswith("ab\n\n" + RUNNING.strip())


def test_pages_without_the_article_mark_give_the_same_text():
    duckdb = pytest.importorskip("duckdb")
    found = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(found):
        pytest.skip("no test data")
    for (page,) in duckdb.sql(f"SELECT html FROM '{found}'").fetchall():
        assert html.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == html.main_text(page) != ""


def test_long_pages_are_read_in_linear_time():
    def seconds(page):
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    for make in (lambda n: "<body>" + "<div>ab</div>" * n, lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<p>" + "</i>" * n):
        seconds(make(1000))
        assert seconds(make(64_000)) < 4 + 30 * seconds(make(8_000))
