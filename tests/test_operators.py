import itertools
import random
import zipfile
from datetime import datetime

import pytest
from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import dedup as D
from millrace.operators import hosts
from millrace.operators import keywords as K
from millrace.sources import discovery, feeds, html, sinks
from millrace.streaming import progress as S
from pyspark.sql import functions as F


def test_keyword_lists():
    assert K.parse_keywords('["a", " b ", "a"]') == ["a", "b"]
    assert K.parse_keywords("a, b\nc,,a") == ["a", "b", "c"]
    assert K.parse_keywords("5") == ["5"] and K.parse_keywords("  ") == []


@pytest.mark.parametrize(("expression", "expected"), [("python AND fastapi", True), ("python AND ruby", False), ("fastapi OR ruby", True), ("python AND (fastapi OR ruby)", True), ("python AND NOT ruby", True), ("NOT php", True), ("python and", False), ("python or", True), ("NOT", True), ("", False), ("(python", True), ('"fast api" OR python', True), ("ruby python", False)])
def test_boolean(spark, expression, expected):
    df = spark.createDataFrame([("Python with FastAPI and Celery",)], "t string")
    assert df.select(K.parse_boolean(expression).match(F.col("t"))).first()[0] is expected


def test_snippet_against_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "navy", "Navys", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(50)]

    def plain(t, terms):
        low, words = t.lower(), t.split()
        hits = [(low.find(x), k, x) for k, x in enumerate(terms) if x in low]
        if not hits:
            return t[:150] + "..." if len(t) > 150 else t
        at = next(i for i, w in enumerate(words) if min(hits)[2] in w.lower())
        a, b = max(0, at - 10), min(len(words), at + 10)
        return ("... " if a else "") + " ".join(words[a:b]) + (" ..." if b < len(words) else "")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(K.snippet(F.col("t"), ["navy", "gamma"])).collect()] == [plain(t, ["navy", "gamma"]) for t in texts]


def test_analysis_without_terms(spark):
    r = K.analysis(spark.createDataFrame([("t", "d", "b" * 300, "u")], "title string, description string, body string, url string"), []).first()
    assert (r.matched, r.occurrences, r.relevance_score, len(r.snippet)) == (True, 0, 100.0, 150)


def test_labels_lower_a_text_once(spark):
    rows = spark.createDataFrame([("Bus", "INDIA, not Indiana; the US"), (None, "U.S.a and South Korea, Southeast Asia"), ("usa", "status indo-pacific"), ("A", None), (None, None)], "t string, c string")
    title, content = F.col("t"), F.col("c")
    for label in (C.country_region, C.subject_theme, C.sentiment):
        plan = rows.select(label(title, content).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.split("LogicalRDD")[0].count("lower(") == 1
    found = rows.select(C.country_region(title, content).alias("p"), C.subject_theme(title, content).alias("s"), C.sentiment(title, content).alias("m")).collect()
    assert [r.p for r in found] == ["India, United States", "South Korea, United States, Southeast Asia", "USA, Indo-Pacific", "Global", "Global"]
    assert [(r.s, r.m) for r in found][3:] == [("General", "neutral")] * 2
    assert [r.m for r in spark.createDataFrame([("win", "support risk"), ("fail", "growth risk"), ("win", "risk")], "t string, c string").select(C.sentiment(title, content).alias("m")).collect()] == ["positive", "negative", "neutral"]


def test_times_past_the_year_9999(spark):
    rows = spark.createDataFrame([(0,), (253402300799000,), (253402315945739,), (None,)], "ms bigint")
    assert [r[0] for r in rows.select(T.time_text(T.from_epoch_ms(F.col("ms")))).collect()] == ["1970-01-01 00:00:00", "9999-12-31 23:59:59", "10000-01-01 04:12:25", None]


def test_simhash_values():
    mask = (1 << 64) - 1
    assert format(D.simhash_values(["The quick brown fox jumps over the lazy dog and runs away happily."])[0] & mask, "x") == "1ad043f190521a37"
    assert format(D.simhash_values(["A completely different text that has absolutely nothing in common with the quick brown fox."])[0] & mask, "x") == "16f2030c107ada16"
    assert D.simhash_values(["short", None, "!?" * 40]) == [None] * 3


def test_near_pairs_are_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(64), k % 6)) for k, b in enumerate(base)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)) + [(99, None)], "id bigint, simhash bigint")
    expected = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3}
    assert {(r.a, r.b) for r in D.near_pairs(df).collect()} == expected


def test_near_pairs_are_not_broadcast(spark):
    """The tables of blocks have twenty rows for each fingerprint, which no estimate by the file's size knows."""
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("simhash"))
    pairs = D.near_pairs(rows)
    assert pairs.count() == 0 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_near_links_lose_no_pair(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(62) for _ in range(5)]
    values += [v ^ (1 << rng.randrange(62)) for v in values]
    rows = [(i, rng.choice([*values, None])) for i in range(80)]
    links = D.near_links(spark.createDataFrame(rows, "id bigint, simhash bigint")).collect()
    prints, first = dict(rows), {}
    for i, p in rows:
        first.setdefault(p, i)
    near = {(r.a, r.b) for r in links}
    assert len(near) == len(links) and all(bin(prints[r.a] ^ prints[r.b]).count("1") == r.distance and r.a < r.b for r in links)
    for (i, p), (j, q) in itertools.combinations([r for r in rows if r[1] is not None], 2):
        x, y = sorted((first[p], first[q]))
        assert (bin(p ^ q).count("1") <= 3) == (x == y or (x, y) in near)
        assert all(k == first[prints[k]] or (first[prints[k]], k) in near for k in (i, j))


def test_first_kept_is_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdef"), rng.choice([0, 1, 3, 7, 15, 255, 1 << 40])) for i in range(60)]
    kept, duplicate = [], {}
    for i, t, p in rows:
        duplicate[i] = any(t == u or bin(p ^ q).count("1") <= 3 for u, q in kept)
        if not duplicate[i]:
            kept.append((t, p))
    out = D.first_kept(spark.createDataFrame(rows, "doc_id bigint, text string, p bigint"), print_column="p")
    assert {r.doc_id: r.is_duplicate for r in out.collect()} == duplicate


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([("u1", 1, "a"), ("u2", 2, "b")], "url string, created_at int, v string")
    new = spark.createDataFrame([("u1", 5, "c"), ("u3", 6, "d"), ("u3", 7, "e")], "url string, created_at int, v string")
    assert sorted(map(tuple, D.upsert(old, new).collect())) == [("u1", 1, "c"), ("u2", 2, "b"), ("u3", 7, "e")]


@pytest.mark.parametrize(("kind", "base", "expected"), [("daily", datetime(2026, 1, 31, 5), datetime(2026, 1, 31, 6, 30)), ("daily", datetime(2026, 1, 31, 7), datetime(2026, 2, 1, 6, 30)), ("weekly", datetime(2026, 1, 31, 7), datetime(2026, 2, 4, 6, 30)), ("monthly", datetime(2026, 1, 31, 7), datetime(2026, 2, 28, 6, 30)), ("monthly", datetime(2026, 12, 31, 7), datetime(2027, 1, 31, 6, 30))])
def test_next_run(spark, kind, base, expected):
    df = spark.createDataFrame([(str(base),)], "b string").select(F.col("b").cast("timestamp").alias("b"))
    run = T.next_run(F.lit(kind), F.col("b"), F.lit(6), F.lit(30), F.lit(3), F.lit(31))
    assert df.select(F.date_format(run, "yyyy-MM-dd HH:mm")).first()[0] == expected.strftime("%Y-%m-%d %H:%M")


def test_uuid5(spark):
    import uuid

    assert spark.range(1).select(T.uuid5_dns(F.lit("search_query_7"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "search_query_7"))


PAGE = """<html lang="en-GB"><head><title>Story</title><meta name="description" content="About"><meta property="article:published_time" content="2026-05-15T12:00:00Z">
<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "author": {"name": "Jane Doe"}}]}</script></head><body><nav><a href="/nav">nav</a></nav>
<article><h1>Story ¶</h1><p>%s <a href="/x" title="t">link</a></p><blockquote>said</blockquote><pre><code>a = 1</code></pre><ul><li>one</li><li>two</li></ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table>
<figure><img src="i.png" width="800" height="600px"><figcaption>cap</figcaption></figure><video src="/v.mp4" poster="/p.jpg"></video><iframe src="https://www.youtube.com/embed/1"></iframe>
<h2>Related stories</h2><p>noise</p></article><form action="/search"><input type="search" name="q"><input type="hidden" name="l" value="en"></form><a rel="next" href="?page=2">more</a></body></html>""" % ("word " * 60)


def test_extract(spark):
    r = spark.createDataFrame([(PAGE, "https://e.com/a/"), (None, None)], "h string, u string").select(html.extracted(F.col("h"), F.col("u")).alias("e")).collect()
    e = r[0].e
    assert (e.title, e.description, e.author, e.lang, e.published) == ("Story", "About", "Jane Doe", "en", "2026-05-15")
    assert "noise" not in e.body and "word" in e.body and e.quotes == ["said"] and e.code == ["a = 1"] and e.lists == [["one", "two"]] and e.tables == [[["h"], ["c"]]]
    assert [(i.src, i.caption, i.width, i.height) for i in e.images] == [("https://e.com/a/i.png", "cap", 800, 600)]
    assert [(v.src, v.type) for v in e.videos] == [("https://e.com/v.mp4", "html5"), ("https://www.youtube.com/embed/1", "youtube")]
    assert e.search_form.input == "q" and e.search_form.hidden == {"l": "en"} and e.next_page == "https://e.com/a/?page=2"
    assert "# Story" in e.markdown and "- one" in e.markdown and "](" not in e.markdown
    assert r[1].e.title == "Untitled"


def test_decoded(spark):
    rows = [("中文".encode("gb18030"), "gb2312"), (b'<meta charset="GBK">' + "中".encode("gb18030"), None), ("é".encode(), None), (None, None)]
    out = [r[0] for r in spark.createDataFrame(rows, "d binary, c string").select(html.decoded(F.col("d"), F.col("c"))).collect()]
    assert out[0] == "中文" and out[1].endswith("中") and out[2] == "é" and out[3] is None


def test_sitemaps_and_robots(spark):
    import gzip

    news = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>https://a/1</loc><n:news><n:publication_date>2026-01-01</n:publication_date><n:title>t</n:title></n:news></url></urlset>'
    assert feeds.parse_sitemap(gzip.compress(news)) == ("urlset", [{"loc": "https://a/1", "lastmod": None, "news_date": "2026-01-01", "news_title": "t"}])
    assert feeds.parse_sitemap(b"<urlset><url>") == ("unknown", []) and feeds.parse_sitemap(None) == ("unknown", [])
    pages = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/private/y"), ("b", "https://b/z")], "host string, url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private")], "host string, body string")
    assert {r.url: r.allowed for r in hosts.robots_allowed(pages, robots).collect()} == {"https://a/x": True, "https://a/private/y": False, "https://b/z": True}


def test_oai(spark):
    body = '<record><header/><dc:title>Sea power</dc:title><dc:identifier>u1</dc:identifier></record><record><header status="deleted"/></record>'
    assert [r.url for r in feeds.oai_records(spark.createDataFrame([(body,)], "body string"), "SEA").collect()] == ["u1"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 3)], "ID int, Title string, Occurrences int")
    for kind in ("csv", "json", "xlsx"):
        sinks.export(df, str(tmp_path / f"x.{kind}"), kind)
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "é" in (tmp_path / "x.json").read_text()
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "Title" in sheet and "Occurrences" not in sheet
    with pytest.raises(ValueError, match="unknown"):
        sinks.export(df, "x", "doc")
    sinks.write_config(str(tmp_path / "c.json"), {"a": 1})
    assert (tmp_path / "c.json").read_text().startswith("{")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    out = S.run_once(S.progress(S.event_stream(spark, str(tmp_path / "in")), late="400 days"), "progress", "complete")
    key = lambda r: (str(r.window_start), r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, out.collect())) == sorted(map(key, S.progress(events).collect()))


def test_boolean_terms_are_all_words():
    assert K.boolean_terms('alpha beta AND NOT "two words" or x') == ["alpha", "beta", "two words", "x"]


def test_container_scores():
    score = lambda s: html._score(html.parse(s).children[0])
    text = "x" * 50
    assert score(f"<nav>{text}</nav>") == score(f"<form>{text}</form>") == -1000 and score("<div>short</div>") == -100
    assert score(f"<div><a href='/'>{text}</a> and</div>") == -500
    assert score(f"<div>{text}<script>{text}</script></div>") == 5.0
    assert score(f"<article class='Main-Content' id='post'><p>{text}</p></article>") == 50 + 5 + 600 + 600
    assert score(f"<section class='ads share'>{text}</section>") == 5 + 150 - 800


def test_search_form_points():
    form = lambda s: html.search_form(html.parse(s), "https://e.com/x")
    assert form('<form action="/login" method="post"><input name="user"><input type="password" name="pass"></form>') is None
    assert form('<form><input placeholder="Search here"></form>')["input"] == "q"
    assert form('<form role="search" class="q"><input id="find-box"></form>') == {"action": "https://e.com/x", "input": "find-box", "hidden": {}}
    both = form('<form action="/a"><input name="s"></form><form action="/search" aria-label="search"><input type="search" name="k"><input type="hidden" name="t" value="1"></form>')
    assert both == {"action": "https://e.com/search", "input": "k", "hidden": {"t": "1"}}


def test_defaults_and_cuts_of_heads():
    assert (html.extract("", "")["title"], html.extract("", "")["author"]) == ("Untitled", "Unknown")
    page = f"<title>{'t' * 300}</title><meta name=author content={'a' * 150}>"
    assert [len(html.extract(page, "")[k]) for k in ("title", "author")] == [200, 100]


def test_packed_sitemaps_have_a_bound(monkeypatch):
    import gzip

    body = b"<urlset><url><loc>https://a.com/1</loc></url></urlset>"
    assert feeds.parse_sitemap(gzip.compress(body))[1][0]["loc"] == "https://a.com/1"
    monkeypatch.setattr(feeds, "MOST_SITEMAP", 20)
    assert feeds.parse_sitemap(gzip.compress(body)) == ("unknown", [])


def test_robots(spark):
    pages = spark.createDataFrame([("a.com", f"https://a.com/{p}/{i}") for i in range(40) for p in ("x", "no")] + [("b.com", "https://b.com/no/1")], "host string, url string")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no/"), ("c.com", "x")], "host string, body string")
    found = hosts.robots_allowed(pages, robots).collect()
    assert len(found) == 81 and all(r.allowed == ("a.com/no" not in r.url) for r in found)


def test_streams_equal_batches(spark, tmp_path):
    """Sessions, first events and spacing of a stream that lands in several files, against the same rows at once."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(600).collect()
    schema = S.EVENTS
    for k in range(3):
        spark.createDataFrame([tuple(r) for r in rows[k * 200 : (k + 1) * 200]], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame([tuple(r) for r in rows], schema)
    stream = lambda: S.event_stream(spark, str(tmp_path / "in"))
    last = max(r.ts for r in rows)
    from datetime import timedelta

    closed = lambda found: {(r.user_id, r.session_start, r.n) for r in found if r.session_end < last - timedelta(hours=3)}
    streamed = closed(S.run_once(S.sessions(stream()), "sessions_once").collect())
    assert streamed and streamed == closed(S.sessions(batch).collect())
    first = S.run_once(S.first_events(stream(), ["user_id", "event_type"], late="1000 days"), "first_once").collect()
    assert sorted((r.user_id, r.event_type) for r in first) == sorted({(r.user_id, r.event_type) for r in rows})
    spaced = {r.event_id: r.start_at for r in S.run_once(S.spaced(stream(), "user_id", 5000.0), "spaced_once").collect()}
    expected, at = {}, {}
    for r in rows:
        t = r.ts.timestamp()
        at[r.user_id] = max(t, at.get(r.user_id, float("-inf")) + 5000.0)
        expected[r.event_id] = at[r.user_id]
    assert set(spaced) == set(expected)
    assert all(b >= a + 5000 - 1e-3 for u in at for a, b in itertools.pairwise(sorted(spaced[r.event_id] for r in rows if r.user_id == u)))


def test_cleaning():
    page = "<article><h1>T</h1><script>x()</script><div class='cookie-note'>accept</div><p>" + "word " * 60 + "</p><form>f</form><h2>Related stories</h2><p>other</p></article>"
    box = html.parse(page).all("article")[0]
    strict, safe = html.cleaned(box, True).text(), html.cleaned(box, False).text()
    assert "accept" not in strict and "accept" in safe and all("x()" not in t and "other" not in t and " f" not in t for t in (strict, safe))
    node, kept = html.best_cleaned(box)
    assert 0.95 < kept < 1 and "accept" not in node.text()
    lean = html.parse("<div><div class='sidebar'>" + "aside " * 40 + "</div><p>short</p></div>")
    assert "aside" in html.best_cleaned(lean)[0].text()
    assert html.article_text(html.parse(page)) == "T\n\n" + " ".join(["word"] * 60)


def test_search_urls(spark):
    rows = [("https://e.com/a", "/find?x=1&q=old", "q", "south sea~*", {"t": "1"}), ("https://e.com/a?b=2", "", "s", "k", None)]
    df = spark.createDataFrame(rows, "base string, action string, name string, keyword string, hidden map<string,string>")
    assert [r[0] for r in df.select(discovery.built_search_url("base", "action", "name", "keyword", "hidden")).collect()] == ["https://e.com/find?x=1&q=south+sea~%2A&t=1", "https://e.com/a?b=2&s=k"]


def test_probes_end_at_the_first_gap(spark):
    urls = spark.createDataFrame([("https://e.com/news/98",), ("https://e.com/news/7",)], "url string")
    landed = spark.createDataFrame([(f"https://e.com/news/{k}",) for k in (99, 100, 101, 103)], "url string")
    assert sorted(r.n for r in discovery.beyond_index(urls, landed).collect()) == [99, 100, 101]


def test_strategies_that_fail_give_way(spark):
    good = lambda d: spark.createDataFrame([(f"https://{d}/1",)], "url string")

    def bad(d):
        raise ValueError("no page")

    rows, errors = discovery.dispatched({"a.com": "good", "b.com": "bad", "c.com": "unknown"}, {"good": good, "bad": bad}, good)
    assert sorted(r.domain for r in rows.collect()) == ["a.com", "b.com", "c.com"] and errors == ["b.com: bad: no page", "c.com: no strategy 'unknown'"]


def test_config_files(spark, tmp_path):
    sinks.write_config(str(tmp_path / "urls.json"), {"urls": [{"url": "https://b.com", "group": "china"}, {"url": "x"}, {"url": "https://a.com"}], "groups": {}})
    entries = discovery.config_entries(spark, str(tmp_path / "urls.json"), "urls")
    assert discovery.flattened(entries, "url", "\n", "^http").first()[0] == "https://b.com\nhttps://a.com"


def test_sink_table(spark, tmp_path):
    sinks.ensure_table(spark, "news_test")
    sinks.ensure_table(spark, "news_test")
    assert spark.table("news_test").columns[-1] == "category" and sinks.self_test(spark, str(tmp_path)) and not list(tmp_path.iterdir())
    spark.sql("DROP TABLE news_test")


def test_first_kept_against_the_rule(spark):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        text = f"t{rng.randrange(25)}"
        rows.append((k, text, rng.choice([7, 7 ^ 1, 7 ^ 6, 7 ^ 0b111100, 1 << 40, rng.getrandbits(60)])))
    kept, expected = [], {}
    for k, text, p in rows:
        twin = any(t == text or bin(q ^ p).count("1") <= 3 for t, q in kept)
        expected[k] = twin
        kept += [] if twin else [(text, p)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, p bigint")
    assert {r.doc_id: r.is_duplicate for r in D.first_kept(df, print_column="p").collect()} == expected


def test_many_terms_are_counted_in_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    words = ["sea", "seas", "ana", "banana", "aa", "Navy", "x y", "none"]
    rows = [tuple("".join(rng.choice(["sea", "s", "an", "a", " ", "navy", "x y", "B"]) for _ in range(rng.randint(0, 20))) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "title string, description string, body string, url string")
    for expression in (None, "sea AND NOT navy OR ana"):
        plain = [tuple(r) for r in K.analysis(df, words, expression=expression).collect()]
        monkeypatch.setattr(K, "MANY", 1)
        assert [tuple(r) for r in K.analysis(df, words, expression=expression).collect()] == plain
        monkeypatch.undo()
