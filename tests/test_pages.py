"""Flat pages and archives of responses: deep and odd pages, plain definitions, and what a stream resumes."""

import random
import time
from datetime import datetime, timezone

import pytest
from millrace.functions import lazy
from millrace.operators import language
from millrace.sources import archive, dom, html
from pyspark.sql import functions as F

DEEP = {
    "div": "<div>" * 100_000 + "text " * 200 + "</div>" * 100_000,
    "bold": "<article><p>" + "<b>x" * 100_000,
    "paragraphs": "<p>word and more " * 50_000,
    "unmatched": "</i>" * 50_000 + "<div>" * 50_000 + "</x>" * 50_000,
    "headings": "<h1>t" * 30_000,
    "tables": "<table><tr><td>x" * 10_000,
    "lists": "<ul><li>x" * 20_000,
}


@pytest.mark.parametrize("name", sorted(DEEP))
def test_deep_pages(name):
    began = time.thread_time()
    page = html.extract(DEEP[name], "https://e.com/")
    root = html.parse(DEEP[name])
    html.best_cleaned(html.container(root))
    html.article_text(root)
    assert time.thread_time() - began < 20
    assert len(page["markdown"]) < 40 * len(DEEP[name])


def tree(rng: random.Random, depth: int = 0) -> str:
    tags = ["div", "section", "article", "p", "a", "b", "span", "h2", "ul", "script", "main", "template", "br"]
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth > 5 or rng.random() < 0.4:
            out.append(rng.choice(["", " ", "one two ", "  x", "long text of a paragraph, it goes on and on. " * rng.randint(1, 4), "\n\t"]))
        else:
            t = rng.choice(tags)
            out.append(f"<{t} class='{rng.choice(['content', 'menu', '', 'story'])}'>{tree(rng, depth + 1)}" + (f"</{t}>" if rng.random() < 0.9 else ""))
    return "".join(out)


def strings(node, skip=()):
    """Strings below, by following children."""
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag not in skip:
            yield from strings(c, skip)


def test_sums_are_what_a_walk_finds():
    rng = random.Random(8)
    for _ in range(150):
        root = dom.parse(tree(rng))
        for n in [root, *root.walk()]:
            assert n.text() == " ".join(" ".join(strings(n)).split()) and n.text_length() == len(n.text())
            assert n.text(frozenset({"a", "script"})) == " ".join(" ".join(strings(n, ("a", "script"))).split())
            assert n.raw() == "".join(strings(n))
            assert n.count("p") == len(n.all("p")) == sum(x.tag == "p" for x in n.walk())
            assert [x.at for x in n.all("p", "a")] == [x.at for x in n.walk() if x.tag in ("p", "a")]
            assert n.has_block() == any(x.tag in dom.BLOCKS for x in n.walk())
            up, quiet = n, False
            while up is not None:
                quiet |= up.tag in dom.QUIET
                up = up.parent
            if not quiet:
                assert n.length() == len(" ".join(strings(n, dom.QUIET)).strip())
                assert n.link_length() == sum(x.length() for x in n.all("a"))
            assert all(c.parent == n for c in n.children if not isinstance(c, str))


def test_container_is_the_pairwise_choice():
    """Against comparing each candidate with each one inside it."""
    rng = random.Random(9)
    for _ in range(200):
        root = dom.parse(tree(rng) + tree(rng))
        found = [(s, n) for n in root.all("div", "section", "article", "main") if (s := html._score(n)) > 100]
        keep = [(s, n) for s, n in found if not any(n.at < m.at < n.end and m.count("p") >= 0.85 * max(1, n.count("p")) for _, m in found)]
        expected = max(keep, key=lambda x: x[0])[1] if keep else root.first("body") or root
        assert html.container(root) == expected


def test_next_page_by_number():
    page = lambda links: html.parse("".join(f"<a href='{h}'>{t}</a>" for h, t in links))
    assert html.next_page(page([("/list?page=1", "1"), ("/list?page=3", "3"), ("/list?page=2", "2")]), "https://www.e.com/list") == "https://www.e.com/list?page=2"
    assert html.next_page(page([("/list/page/3/", "3"), ("/list/page/4/", "4")]), "https://e.com/list/page/3") == "https://e.com/list/page/4/"
    assert html.next_page(page([("https://other.com/?page=2", "2"), ("/?page=3", "2")]), "https://e.com/") is None
    assert html.next_page(page([("/?page=9", "Forward")]), "https://e.com/") == "https://e.com/?page=9"


PLAIN = "<html><head><title>中文 é</title></head></html>"


@pytest.mark.parametrize(
    ("raw", "header", "text", "charset"),
    [
        (PLAIN.encode(), "text/html; charset=UTF-8", PLAIN, "utf-8"),
        (PLAIN.encode("gb18030"), "text/html;charset=gb2312", PLAIN, "gb18030"),
        (PLAIN.encode(), None, PLAIN, "utf-8"),
        ("é".encode("latin-1"), "text/html; charset=iso-8859-1", "é", "iso-8859-1"),
        ('<meta charset="GBK">中'.encode("gb18030"), "text/html; charset=ISO-8859-1", '<meta charset="GBK">中', "gb18030"),
        ('<meta charset="GBK">é'.encode(), "text/html; charset=utf-8", '<meta charset="GBK">é', "utf-8"),
        (b"\xff\xfe", "text/html; charset=utf-8", "��", "utf-8"),
        (b"x", "text/html; charset=no-such", "x", "utf-8"),
        (b"", None, "", "utf-8"),
    ],
)
def test_page_text(raw, header, text, charset):
    assert html.page_text(raw, header) == (text, charset)


def written(spark, folder, rows):
    archive.write_responses(spark.createDataFrame(rows, archive.WRITTEN), folder)


def test_archive_round_trip(spark, tmp_path):
    at = datetime(2026, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
    rows = [(f"https://e.com/{k}", f"urn:{k}", at, (200, 404, 503)[k % 3], "text/html; charset=utf-8", f"<p>{k}</p>\r\n\r\nWARC/1.0\r\n".encode() * (k % 5)) for k in range(300)]
    rows += [(None, None, None, None, None, None), ("https://e.com/line\nend", "x", at, 200, "text/html\r\nSet-Cookie: no", b"y")]
    folder = f"file://{tmp_path}/a"
    written(spark, folder, rows[:200])
    written(spark, folder, rows[200:])
    found = archive.read_responses(spark, folder).collect()
    assert len(found) == 302 and not list((tmp_path / "a").glob("_*"))
    by = {r.record_id: r for r in found}
    for url, key, _, status, kind, body in rows[:300]:
        r = by[key]
        assert (r.url, r.status, r.content_type, r.n_bytes, r.html) == (url, status, kind, len(body), body.decode())
        assert r.fetched_at == datetime(2026, 1, 2, 3, 4, 5, 678000)
    assert by[None].html == "" and by[None].url is None and by["x"].url == "https://e.com/line end" and "set-cookie" not in by["x"].headers
    small = spark.read.format("responses").option("splitBytes", "2000").load(folder)
    assert small.rdd.getNumPartitions() >= 2 and small.count() == 302


def test_damaged_and_packed_archives(spark, tmp_path):
    import gzip

    one = lambda k: archive.record_bytes(f"https://e.com/{k}", str(k), None, 200, "text/html", b"body")
    (tmp_path / "1.warc").write_bytes(one(1) + one(2)[:-9])
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(one(3)))
    (tmp_path / "3.warc").write_bytes(b"no archive")
    (tmp_path / "4.warc").write_bytes(one(4).replace(b"response", b"request ") + one(5).replace(b"HTTP/1.1", b"GOPHER/1"))
    (tmp_path / "_5.warc").write_bytes(one(6))
    (tmp_path / "notes.txt").write_bytes(one(7))
    found = {r.record_id: r for r in archive.read_responses(spark, str(tmp_path)).collect()}
    assert set(found) == {"1", "3", "5"}
    packed = archive.response_row("f", 0, {"warc-type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"packed"))
    assert packed[8] == "packed" and packed[7] == 6
    assert archive.response_row("f", 0, {"warc-type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nplain")[8] == "plain"
    assert found["1"].html == "body" and found["5"].status is None and found["5"].html.endswith("body")
    assert archive.read_responses(spark, f"{tmp_path}/none").count() == 0


def test_stream_of_responses_resumes(spark, tmp_path):
    """What a second run reads is what has landed since, also where the last file has grown and ended in half a record."""
    folder, record = tmp_path / "in", lambda k: archive.record_bytes(f"https://e.com/{k}", str(k), None, 200, "text/html", b"x" * k)
    folder.mkdir()

    def run():
        q = archive.stream_responses(spark, str(folder)).select("record_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(int(r[0]) for r in spark.read.schema("record_id string").parquet(str(tmp_path / "out")).collect())

    (folder / "a.warc").write_bytes(record(1) + record(2) + record(3)[:20])
    assert run() == [1, 2]
    (folder / "a.warc").write_bytes(record(1) + record(2) + record(3) + record(4))
    assert run() == [1, 2, 3, 4]
    (folder / "a.warc").write_bytes(b"".join(map(record, range(1, 6))))
    (folder / "b.warc").write_bytes(record(6))
    (folder / "c.warc").write_bytes(record(7)[:-1])
    assert run() == [1, 2, 3, 4, 5, 6]
    (folder / "c.warc").write_bytes(record(7))
    assert run() == run() == [1, 2, 3, 4, 5, 6, 7]


def test_unforeseen_pages_give_rows(spark):
    rows = spark.createDataFrame([("<a href='/x'>a</a>", "http://[bad"), (None, None), ("\x00<![CDATA[", "u")], "h string, u string")
    found = rows.select(html.extracted(F.col("h"), F.col("u")).alias("e"), html.clean_text(F.col("h")).alias("c")).collect()
    assert [r.e.title for r in found] == [None, "Untitled", "Untitled"] and len(found) == 3


def test_functions_of_pages_see_a_few_at_a_time(spark):
    """What a task holds of pages has a bound, however many rows or bytes its Arrow batch has; every row gets its own value."""
    seen = lazy.paged_udf("n int, size int")(lambda texts: [{"n": len(texts), "size": None if t is None else len(t)} for t in texts])
    size = F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 50 == 1, 400_000).otherwise(F.col("id")).cast("int")
    rows = spark.range(0, 700, 1, 1).select("id", F.when(F.col("id") % 11 > 0, F.repeat(F.lit("x"), size)).alias("t"), size.alias("size"))
    found = rows.select("id", "size", seen("t").alias("x"), F.col("t").isNull().alias("none")).collect()
    assert len(found) == 700 and all(r.x["size"] == (None if r.none else r.size) for r in found)
    assert max(r.x["n"] for r in found) <= 256 and all(r.x["n"] < 200 for r in found if r.size == 400_000 and not r.none)
    pages = spark.range(0, 600, 1, 1).select("id", F.concat(F.lit("<title>a"), "id", F.lit("</title>")).alias("h"))
    assert all(r.t == f"a{r.id}" for r in pages.select("id", html.extracted(F.col("h"), F.lit("https://e.com"))["title"].alias("t")).collect())


def test_language_is_judged_by_the_first_characters(spark):
    known = language.profiles(spark.createDataFrame([("the thing that then", "en"), ("que quel quai", "fr"), (None, "fr")], "text string, lang string"))
    texts = [("é" * 1990 + " the then" + " que" * 900,), ("que quel",), (None,)]
    found = spark.createDataFrame(texts, "t string").select(language.detected(F.col("t"), known).alias("x")).collect()
    assert [(r.x.lang, r.x.margin) for r in found] == [language.nearest(t, known) for (t,) in texts]
