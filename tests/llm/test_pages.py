"""HTML extraction and WARC archives."""

import html as entities
import re

import duckdb
import pytest

from tablediff.llm import html_extract, warc

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, text string"


def template_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    lines = [" ".join(entities.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in lines if x)


def test_extraction_equals_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = html_extract.op7_html_extraction(spark, SF).collect()
    assert all(r.text == template_text(pages[r.page_id]) and r.n_chars == len(r.text) for r in found) and len(found) == len(pages)


@pytest.mark.parametrize("change", [
    lambda h: h.replace("article>", "div>"),
    lambda h: h.replace("article>", "section>"),
    lambda h: h.replace("<article>", "").replace("</article>", ""),
    lambda h: h.replace("<article>", "<div id=page><div class='post social-science'>").replace("</article>", "</div></div>"),
    lambda h: h.replace("<article>", "<main><article>").replace("</article>", "</article><div><a href='/x'>Another story to read</a><p>Short teaser.</p></div></main>"),
    lambda h: h.replace("</article>", "<div class='comments'><p>" + "a reader says something long here " * 10 + "</p></div></article>"),
])
def test_density_finds_the_article_whatever_its_element(change):
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
        assert html_extract.extract(change(page)) == template_text(page)


@pytest.mark.parametrize("markup", ["<a href=\"x " * 90_000, "<a href='x> " * 90_000, "<" * 10**6, "<div>" * 200_000, "<b>" * 150_000 + "<p></p>" * 120_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 150_000, "<div>" * 100_000 + "<td>" * 100_000, "<div>" * 90_000 + "</section>" * 90_000, "<a " + "a" * 10**6, "<a " + "a=' " * 300_000 + ">x", "<!--" * 250_000, "<p>x</script><script>" * 60_000])
def test_broken_markup_takes_time_in_proportion(markup):
    import time

    began = time.process_time()
    html_extract.extract(markup)
    assert time.process_time() - began < 8  # a square of the length would take minutes


def test_class_words():
    story = "Words of the story go on and on for a good while here."
    page = lambda name: f"<body><div><p>{story}</p><p class='{name}'>{story}</p><p>{story}</p></div></body>"
    for name in ("post social-science", "side-effects", "railway", "notice-of-meaning", "replies-of-poets"):
        assert html_extract.extract(page(name)) == "\n".join([story] * 3), name
    for name in ("comments", "social share-box", "cookie-policy", "relatedPosts", "sidebar right"):
        assert html_extract.extract(page(name)) == "\n".join([story] * 2), name
    assert html_extract.extract(f"<body><div class='notice'><p>{story}</p></div></body>") == story
    assert html_extract.extract(f"<body><p title='a hidden gem'>{story}</p><p hidden>gone</p></body>") == story


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), (None, ""), ("<p>", ""), ("plain text", "plain text"),
    ("<body><p>one<p>two &amp; three</body>", "one\ntwo & three"),
    ("<div class='nav'><a href=x>Home</a></div><div id=content><h1>T</h1><p>Long enough text here to count for it.</p></div>", "T\nLong enough text here to count for it."),
    ("<article><p>body words stand here</p><script>var a='<p>no</p>'</script><!-- gone --><div class='comments'><p>reader</p></div></article>", "body words stand here"),
    ("<article><header><h1>Head</h1></header><p>x <b>y</b>\n z</p></article><aside>side</aside><form>f</form>", "Head\nx y z"),
    ("<p>a<br>b</p><!-- open", "a b"),
    ('<p title="a>b">kept</p><style>p{}</style>', "kept"),
])
def test_markup(source, text):
    assert html_extract.extract(source) == text


def test_deep_nesting_and_empty_tables(spark):
    assert html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    rows = spark.createDataFrame([(None, None, None, "clash"), (1, "u", "<p>x", "clash"), (1, "u", "<p>x", "clash")], PAGES)
    assert sorted(str(r.text) for r in html_extract.extract_text(rows).collect()) == ["", "x", "x"]
    assert html_extract.extract_text(rows.limit(0)).count() == 0


def test_density_picks_the_text():
    page = "<body><div>" + "<a href=x>link text</a>" * 30 + "</div><div>" + "<p>Words of the story go on and on for a good while here.</p>" * 5 + "</div></body>"
    best, _ = html_extract.main_node(html_extract.parse(page))
    assert [p.name for p in best.parts if not isinstance(p, str)] == ["p"] * 5


def test_sibling_containers_are_kept():
    story = ["Words of the story go on and on for a good while here, number %d. " % k * 6 for k in range(6)]
    lines = [" ".join(x.split()) for x in story]
    box = lambda xs: "<div>" + "".join(f"<p>{x}</p>" for x in xs) + "</div>"
    links = "<div>" + "<a href=x>link text</a>" * 30 + "</div>"
    assert html_extract.extract("<body>" + box(story[:3]) + links + box(story[3:]) + "</body>") == "\n".join(lines)
    text_only = "<div>" + "<br>".join(story[3:]) + "</div>"
    assert html_extract.extract("<body>" + links + box(story[:3]) + text_only + "</body>") == "\n".join(lines[:3] + [" ".join(lines[3:])])
    assert html_extract.extract("<body><div><section>" + box(story[:2]) + "</section></div><section>" + box(story[2:]) + links + "</section></body>") == "\n".join(lines)
    articles = "<article>" + box(story[:3]) + "</article>" + "<article>" + box(story[3:]) + "</article>"
    assert html_extract.extract("<body>" + articles + "</body>") == "\n".join(lines)


def test_warc_equals_sql(spark):
    duckdb.sql(f"create or replace view pages as select * from '{SF}/pages.parquet'")
    df = warc.op8_warc(spark, SF)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(duckdb.sql(f"select {', '.join(df.columns)} from ({warc.OP8_SQL})").fetchall(), key=str)


EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n0\r\n\r\n"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "é" * 40_000), (2, None, None), (3, "u", ""), (4, "u", EVIL * 3000), (5, "u", "é" * 40_000), (None, "u", "é" * 40_000), (6, "u", "WARC/1.1" * 9000), (7, "u", "same"), (7, "u", "same")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    warc.write_archives(pages, f"{tmp_path}/w", segment_bytes=1000)
    records = warc.read_records(spark, f"{tmp_path}/w")
    assert records.where("kind = 'continuation'").count() > 100
    found = warc.read_archives(spark, f"{tmp_path}/w").collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    for i, _, h in rows[:1] + rows[3:4] + rows[6:7]:
        assert by[i].payload == h.encode() and by[i].record_type == "response" and by[i].payload_digest == warc.digest(h.encode())
    assert (by[5].record_type, by[5].refers_to, by[5].payload_bytes) == ("revisit", 1, 80_000) and by[None].refers_to == 1
    assert (by[3].record_type, by[3].refers_to) == ("revisit", 2) and by[2].payload_bytes == 0
    assert [r.record_type for r in found if r.page_id == 7] == ["response"] * 2
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def foreign(version, kind, uri, block, digest=None):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uri}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2020-01-01T00:00:00Z", *([f"WARC-Payload-Digest:", f"  sha1:{digest}"] if digest else []), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("version", ["1.0", "1.1"])
@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, tmp_path, version, packed):
    import gzip

    framed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b"6\r\nWARC/1\r\n5\r\n.0 x\xff\r\n0\r\n\r\n"
    inner = f"HTTP/1.1 200 OK\r\n\r\n{EVIL * 40}WARC/1.0\r\nContent-Length: 3\r\n\r\nabc".encode()
    made = [foreign(version, "warcinfo", "info", b"software: x\r\n"), foreign(version, "request", "a", b"GET / HTTP/1.1\r\n\r\n"), foreign(version, "response", "a", inner, warc.digest(inner.partition(b"\r\n\r\n")[2])), foreign(version, "response", "WARC/1.1", framed + body, warc.digest(body)), foreign(version, "response", "c", framed + body, warc.digest(b"WARC/1.0 x\xff").lower()), foreign(version, "revisit", "d", b"HTTP/1.1 200 OK\r\n\r\n", warc.digest(b"WARC/1.0 x\xff")), foreign(version, "response", "e", b"HTTP/1.1 200 OK\r\n\r\n")]
    (tmp_path / "w").mkdir()
    for name, records in (("one", made[:4]), ("two", made[4:])):
        raw = b"".join(gzip.compress(r) for r in records) if packed else b"".join(records)
        (tmp_path / "w" / f"{name}.warc{'.gz' if packed else ''}").write_bytes(raw)
    found = {r.uri: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert sorted(found) == ["WARC/1.1", "a", "c", "d", "e"] and found["a"].payload == inner.partition(b"\r\n\r\n")[2]
    assert found["c"].payload == found["WARC/1.1"].payload == b"WARC/1.0 x\xff" and found["e"].payload == b""
    assert (found["d"].record_type, found["d"].payload, found["d"].payload_digest) == ("revisit", None, warc.digest(b"WARC/1.0 x\xff"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(made[3].replace(b".0 x", b".0 y"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "bad" / "x.warc").write_bytes(made[3][:-20])
    with pytest.raises(Exception, match="within a record"):
        warc.read_archives(spark, f"{tmp_path}/bad").collect()


def test_revisits_agree_with_their_response(spark):
    rows = [(1, 3, "D", "response", None), (2, 3, "D", "revisit", 1), (3, 3, "D", "revisit", None)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    assert warc.check_revisits(spark.createDataFrame(rows, schema)).count() == 3
    for wrong in ((4, 3, "E", "revisit", 1), (4, 2, "D", "revisit", 1), (4, 3, "D", "revisit", 9)):
        with pytest.raises(ValueError, match="does not agree"):
            warc.check_revisits(spark.createDataFrame([*rows, wrong], schema))


def test_missing_segment_is_an_error(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "text " * 2000, "")], PAGES), f"{tmp_path}/w", segment_bytes=1000)
    records = warc.read_records(spark, f"{tmp_path}/w")
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(records.where("segment is null or segment <> 3")).collect()


def test_framing():
    for payload in (b"", b"x", EVIL.encode() * 50, bytes(range(256)) * 100):
        block = warc.HTTP + warc.frame(payload, 100)
        assert warc.unframe(block) == payload and warc.START not in block
    assert warc.unframe(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.unframe(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    for bad in (b"no header", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unframe(bad)


LONG = ["The first part of the story goes on for quite a while, so that nobody can doubt what it is about. " * 4, "And the second part of it tells the rest at about the same length, with a few more words in it. " * 4]


@pytest.mark.parametrize("outer", ["{}", "<article>{}</article>", "<div id=page>{}</div>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("head", ["<h1>Title here</h1>", "<div class='title'><h1>Title here</h1></div>", "<header class='entry'></header><div><div><h2>Title here</h2></div></div>"])
@pytest.mark.parametrize("byline", ["", "<div class='byline'>By A Writer</div>"])
@pytest.mark.parametrize("tail", ["", "<div><p>Short end.</p></div>", "<div><div><p>One.</p><p>Short end.</p></div></div>"])
def test_parts_in_containers_of_their_own(outer, head, byline, tail):
    body = "<div>" + "".join(f"<p>{p}</p>" for p in LONG) + "</div>"
    page = f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{outer.format(head + byline + body + tail)}<div><a href=/1>More of this</a> <a href=/2>And of that</a></div><footer>All rights</footer></body></html>"
    want = ["Title here", *(["By A Writer"] if byline else []), *(p.strip() for p in LONG), *(["One."] if "One." in tail else []), *(["Short end."] if tail else [])]
    assert html_extract.extract(page).split("\n") == want
