"""Main text of pages and archive packages."""

import gzip
import hashlib
import io
import zipfile

import pytest

pytest.importorskip("barlens.llm")
from barlens.llm import html_text, zip_warc  # noqa: E402
from barlens.llm.common import scratch_path, settle  # noqa: E402

LONG = "This sentence is long enough to look like the text of an article, and it goes on for a while. "


def test_text_of_an_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a="</p>"</script></head><body><header>Site</header>
    <nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav><div class="ad banner">Buy {LONG}</div>
    <article><h1>A &amp; B</h1><p><b>{LONG}<br>second&nbsp; line<p>Short.</p><form><input><label>Name</label></form><ul><li>one<li>two</ul>
    <div class="comments"><p>{LONG}</p></div><p>x&lt;y</article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    text = " ".join(LONG.split())
    assert html_text.main_text(page) == f"A & B\n\n{text} second line\n\nShort.\n\none\n\ntwo\n\nx<y"


def test_text_without_article_markup():
    page = f"<body><div id=menu>m</div><div><div><h2>Title</h2><p>{LONG}</p><p>Hm.</p><p>{LONG}</p></div></div><div class='cookie-notice'>{LONG}</div><div>a <a>b</a> <a>c</a></div></body>"
    text = " ".join(LONG.split())
    assert html_text.main_text(page) == f"Title\n\n{text}\n\nHm.\n\n{text}"


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<script>", "<nav>only a menu", "</div></p>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) in ("", "<", "<p")


def test_plain_text_and_deep_nesting():
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-comments", "with-header", "page-with-menu", "widget", "site-header", "menu"])
@pytest.mark.parametrize("region", ["article", "main", "div"])
def test_layout_names_hide_no_page(name, region):
    text = " ".join(LONG.split())
    page = f"<body><div class='x {name}'><{region}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></{region}></div><div>a <a>b</a></div><div id=site-footer>{LONG}</div></body>"
    want = "a b" if (name, region) == ("menu", "div") else f"Title\n\n{text}\n\n{text}"
    assert html_text.main_text(page) == want
    if want != "a b":
        assert html_text.main_text(f"<form id=aspnetForm>{page}</form>") == want


def test_names_still_hide_what_they_name():
    text = " ".join(LONG.split())
    assert [sorted(html_text.names(n)) for n in ("site-header", "comments_area ad2", "cookie-notice", "has-sidebar", "content-sidebar-wrap", "shadow")] == [["header"], ["ad", "comments"], ["cookie", "notice"], [], [], []]
    card = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    page = f"<div><h1>T</h1><p>{LONG}</p><div class='comments-area'>{card * 4}</div></div><div class=related>{card * 4}</div><div class=cookie-consent>{LONG * 20}</div>"
    assert html_text.main_text(page) == f"T\n\n{text}"
    assert html_text.main_text(f"<article><h1>T</h1><p>{LONG}</p></article><div class=sidebar><p>{LONG * 9}</p></div>") == f"T\n\n{text}"


@pytest.mark.parametrize("start", ["<body>", "<p>", "<h1></h1><p>", ""])
def test_a_head_ends_without_its_tag(start):
    text = " ".join(LONG.split())
    head = "<!doctype html><html><head><meta charset=utf-8><title>T</title><noscript><img src=x></noscript><style>p{}</style><link rel=x>\n"
    assert html_text.main_text(f"{head}{start}{LONG}") == text == html_text.main_text(f"{head}</head>{start}{LONG}")


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "x")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1)] and html_text.extract(pages.limit(0)).count() == 0


def test_packages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(zip_warc, "PACKAGE", 3000)
    monkeypatch.setattr(zip_warc, "READ", 500)
    big = "ü" * 60
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", big), (3, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (7, "u", None), (None, "u", big), (8, "u", "no copy " * 40)] + [(100 + i, "u", f"{i} page " * 30) for i in range(60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, refers_to int")
    folder = scratch_path(spark, "warc")
    manifest = settle(zip_warc.write_packages(zip_warc.roles(pages), folder))
    got = zip_warc.read_packages(manifest, payload=True).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        copy = body == big.encode() and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if copy else ("response", None))
        assert r.payload is None if copy else bytes(r.payload) == body
    package = manifest.first().package.removeprefix("file:").replace("///", "/")
    with zipfile.ZipFile(package) as z:
        assert set(z.namelist()) == {zip_warc.MEMBER, zip_warc.INDEX} and gzip.decompress(z.read(zip_warc.MEMBER)).startswith(b"WARC/1.1")
    assert zip_warc.archived(pages.limit(0), scratch_path(spark, "warc")).count() == 0


def test_directories_with_zip64_and_comments():
    class Far(io.BytesIO):
        """Pretends that nothing but the ZIP64 fields can hold a number."""

    raw = Far()
    limit = zipfile.ZIP64_LIMIT
    zipfile.ZIP64_LIMIT = 10
    try:
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for i in range(5):
                with z.open(f"m{i}", "w", force_zip64=True) as f:
                    f.write(b"%d" % i * 50)
    finally:
        zipfile.ZIP64_LIMIT = limit
    held = zip_warc.members(raw, len(raw.getvalue()))
    assert {n: raw.getvalue()[o : o + k] for n, (o, k) in held.items()} == {f"m{i}": b"%d" % i * 50 for i in range(5)}
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", "text")
        z.writestr(zipfile.ZipInfo("b"), "y", zipfile.ZIP_DEFLATED)
        z.comment = b"note" * 100
    held = zip_warc.members(plain, len(plain.getvalue()))
    assert set(held) == {"a"} and plain.getvalue()[held["a"][0] :][:4] == b"text"


@pytest.mark.parametrize("html, want", [("<p>a</p><![foo[x]]>", "a"), ("<p>a</p><![foo[x]]><p>b", "a\n\nb"), ("<![if IE]>a<![endif]>", "a"), ("<p>a<![CDATA[x]]>b</p>", "ab"), ("<p>a</p><![ x", "a\n\n<![ x"), ("<!DOCTYPE [<!ENTITY x 'y'>]><p>a", None)])
def test_marked_sections_are_comments(html, want):
    got = html_text.main_text(html)
    assert got == want if want is not None else got.endswith("a")


def test_a_region_keeps_its_title_and_its_end():
    text = " ".join(LONG.split())
    body = f"<div id=c><h1>Title</h1><div><p>{LONG}<p>{LONG}</div><div><p>Short closing part.</p></div></div>"
    want = f"Title\n\n{text}\n\n{text}\n\nShort closing part."
    assert html_text.main_text(f"<body>{body}</body>") == want
    assert html_text.main_text(f"<body><div>{body}<div><a>one</a> <a>two</a> <a>three</a></div></div></body>") == want
    assert html_text.main_text(f"<body><article>{LONG}</article><article>short</article></body>") == f"{text}\n\nshort"
    assert html_text.main_text(f"<body><header>Site</header><article><header><h1>Head</h1></header><p>{LONG}</p></article></body>") == f"Head\n\n{text}"


@pytest.mark.parametrize("part", ["<div>", "<div class=widget>", "<article class=ad>", "<form>"])
def test_depth_costs_no_more_than_length(part):
    import time
    import tracemalloc

    page = "".join(f"{part}t{i}" for i in range(40000))
    tracemalloc.start()
    began = time.process_time()
    text = html_text.main_text(page)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.process_time() - began < 60
    tracemalloc.stop()
    assert text.startswith("t0")


def test_packages_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(zip_warc, "PACKAGE", 2000)
    html = "<p>error</p>" * 20
    rows = [(i if i % 50 else None, f"u{i}", html if i % 3 else f"{html}{i}") for i in range(1, 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    read = zip_warc.archived(pages, scratch_path(spark, "many"))
    assert read.rdd.getNumPartitions() > 4
    got = read.collect()
    size = {u: len(h) for _, u, h in rows}
    assert len(got) == 299 and all(r.payload_bytes == size[r.url] for r in got)
    assert [r.page_id for r in got if r.record_type == "response" and size[r.url] == len(html)] == [1]
    assert all(r.refers_to == 1 for r in got if r.record_type == "revisit") and sum(r.record_type == "revisit" for r in got) == 199
