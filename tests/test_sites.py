"""Walks over landed sites against loops that read one response after the other."""

import json
import random
from datetime import datetime

from millrace.sources import discovery, feeds, sites
from pyspark.sql import functions as F


def plain_sitemaps(site, landed, most):
    """The queue of a crawler over one site."""
    import re

    robots = landed.get(site + "/robots.txt", "")
    queue = list(dict.fromkeys(line.split(":", 1)[1].strip() for line in robots.splitlines() if line.lower().startswith("sitemap:") and line.split(":", 1)[1].strip()))
    queue = queue or [site + g for g in sites.SITEMAPS]
    done, found = set(), {}
    while queue:
        url = queue.pop(0)
        if url in done:
            continue
        done.add(url)
        body = landed.get(url)
        if body is None:
            continue
        xml = re.search(r"<\?xml|<sitemap|<urlset|<sitemapindex", body[:2000], re.I)
        if url.endswith(".txt") or not xml and "http" in body:
            found |= {s.strip(): 1 for s in body.splitlines() if s.strip().startswith("http") and s.strip() not in found}
        elif xml:
            for u in re.findall(feeds.LOC.removeprefix("(?i)"), body, re.I):
                if u.endswith(".xml") or "sitemap" in u.lower():
                    queue.append(u)
                else:
                    found.setdefault(u, 1)
    return list(found)[:most]


def test_sitemaps_are_read_in_the_order_of_a_queue(spark):
    rng = random.Random(3)
    landed, names = {}, [f"https://s{k}.org" for k in range(25)]
    for s in names:
        maps = [f"{s}/m{k}.xml" for k in range(5)] + [s + "/sitemap.xml", s + "/list.txt", s + "/sitemap1.xml"]
        if rng.random() < 0.5:
            landed[s + "/robots.txt"] = "\r\n".join(["User-agent: *", *(rng.choice(["Sitemap:", "sitemap: "]) + m + rng.choice(["", " "]) for m in rng.sample(maps, rng.randint(0, 3))), "Sitemap:"])
        for m in maps:
            if rng.random() < 0.8:
                locs = [rng.choice([f"{s}/p{rng.randint(0, 30)}", rng.choice(maps[:6]), f"{s}/p{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 8))]
                landed[m] = "\n".join(u for u in locs if not u.endswith(".xml")) if m.endswith(".txt") else rng.choice(["<urlset>", "<?xml?><sitemapindex>"]) + "".join(f"<loc>{rng.choice(['', '<![CDATA['])}{u}]]></loc>" if rng.random() < 0.3 else f"<loc> {u} </loc>" for u in locs)
    rows = spark.createDataFrame(list(landed.items()), "url string, body string")
    frame = spark.createDataFrame([(s,) for s in [*names, names[0], None]], "site string")
    for most in (500, 4):
        found = {}
        for r in sorted(sites.sitemap_pages(frame, rows, most).collect(), key=lambda r: (r.site, r.place)):
            found.setdefault(r.site, []).append(r.url)
        assert found == {s: p for s in names if (p := plain_sitemaps(s, landed, most))}


def test_feeds_in_the_order_of_their_guesses(spark):
    item = lambda u: f"<item><title>t</title><link>{u}</link></item>"
    entry = lambda u: f"<entry><link href='{u}'/></entry>"
    landed = [("https://a.org/atom.xml", "<feed>" + entry("https://a.org/3") + item("https://a.org/1")), ("https://a.org/rss", "<rss>" + item("https://a.org/1") + item("https://a.org/2") + item("/no")), ("https://a.org/feed.xml", "<html>" + item("https://a.org/9")), ("https://b.org", "<rss>" + item("https://b.org/x")), (None, "<rss>")]
    found = sites.feed_pages(spark.createDataFrame([("https://a.org",), ("https://b.org",), ("https://c.org",)], "site string"), spark.createDataFrame(landed, "url string, body string")).collect()
    assert sorted((r.site, r.place, r.url) for r in found) == [("https://a.org", 1, "https://a.org/1"), ("https://a.org", 2, "https://a.org/2"), ("https://a.org", 3, "https://a.org/3"), ("https://b.org", 1, "https://b.org/x")]


def test_wordpress_lists_end_where_a_loop_would(spark):
    posts = lambda *ids: json.dumps([{"id": i, "link": f"https://w/{i}" if i else None, "title": {"rendered": "A &amp; B"}, "date_gmt": "2026-01-02T03:04:05"} for i in ids])
    rows = [
        ("a", "posts", 1, 200, 3, posts(1, 2)), ("a", "posts", 2, 200, None, posts(3, 0)), ("a", "posts", 3, 200, None, posts(4)), ("a", "posts", 4, 200, None, posts(5)), ("a", "pages", 1, 200, None, posts(6)),
        ("b", "posts", 1, 200, None, posts(1)), ("b", "posts", 3, 200, None, posts(3)),
        ("c", "posts", 1, 200, None, posts(1)), ("c", "posts", 2, 403, None, posts(2)), ("c", "posts", 3, 200, None, posts(3)),
        ("d", "posts", 1, 200, None, posts(1)), ("d", "posts", 2, 200, None, "[]"), ("d", "posts", 3, 200, None, posts(3)),
        ("e", "posts", 1, 200, None, "{}"), ("f", "posts", 2, 200, None, posts(1)), ("g", "media", 1, 200, None, posts(1)), (None, "posts", 1, 200, None, posts(1)),
    ]
    frame = spark.createDataFrame(rows, "site string, kind string, page bigint, status int, total bigint, body string")
    walk = lambda most: {s: [r.url for r in sorted(own, key=lambda r: r.place)] for s, own in by_site(sites.wordpress_walk(frame, most).collect()).items()}
    assert walk(500) == {"a": ["https://w/1", "https://w/2", "https://w/3", "https://w/4", "https://w/6"], "b": ["https://w/1"], "c": ["https://w/1"], "d": ["https://w/1"]}
    assert walk(2)["a"] == ["https://w/1", "https://w/2"]
    first = sites.wordpress_walk(frame).where("site = 'b'").first()
    assert (first.title, first.published_at) == ("A & B", datetime(2026, 1, 2, 3, 4, 5))


def by_site(rows):
    out = {}
    for r in rows:
        out.setdefault(r.site, []).append(r)
    return out


def test_items_of_answers(spark):
    rows = [
        ('{"data": {"list": [{"url": "//c.cn/1", "title": "t", "publishTime": 1700000000000}, {"url": "/rel"}, {"title": "none"}, {"url": "https://c.cn/2", "publishTime": "x"}]}}', "<a href='/page/202405/123.shtml'><b>One</b> two</a><a href='https://g.cn/page/202413/5.shtml'>bad</a><a href='/page/2024/1.shtml'>no</a>", '<a class="r" href="/en/news/x/">X</a><A HREF="/en/news/">root</A><a href="//i.np/en/news/y">\n </a><a href="rel/en/news/z">r</a>'),
        (None, None, None), ("broken", "", "<a>"),
    ]
    frame = spark.createDataFrame(rows, "j string, g string, i string")
    found = frame.select(sites.json_items(F.col("j")).alias("j"), sites.dated_items(F.col("g"), "https://g.cn").alias("g"), sites.matching_items(F.col("i"), "https://i.np", [r"/en/news/"], ["/en/news"]).alias("i")).collect()
    assert [tuple(x) for x in found[0].j] == [("https://c.cn/1", "t", datetime(2023, 11, 14, 22, 13, 20)), ("https://c.cn/2", None, None)]
    assert [tuple(x) for x in found[0].g] == [("https://g.cn/page/202405/123.shtml", "One two", datetime(2024, 5, 1)), ("https://g.cn/page/202413/5.shtml", "bad", None)]
    assert [tuple(x) for x in found[0].i] == [("https://i.np/en/news/x/", "X", None), ("https://i.np/en/news/y", None, None)]
    assert found[1].g is None and found[2].g == [] and not found[2].j and found[2].i == []


def test_searches_end_where_a_loop_would(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for k in range(60):
        site, query, start = f"s{k % 12}", f"q{k // 12}", 1
        pages = [[(f"https://{site}/{rng.randint(0, 40)}", None, rng.choice([None, datetime(2020, 1, 1), datetime(2026, 1, 1)])) for _ in range(rng.randint(0, 4) if rng.random() < 0.15 else 4)] for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3 and len(pages) > 2:
            pages[2] = list(reversed(pages[1]))
        ok = [rng.random() > 0.05 for _ in pages]
        landed = [rng.random() > 0.05 for _ in pages]
        rows += [(site, query, start + n, ok[n], items) for n, items in enumerate(pages) if landed[n]]
        own, before = expected.setdefault(site, []), None
        for n, items in enumerate(pages[:6]):
            links = sorted({u for u, _, _ in items})
            if not (landed[n] and ok[n] and items) or links == before:
                break
            before = links
            own += [u for u, _, at in items if at is None or at >= datetime(2025, 1, 1)]
    frame = spark.createDataFrame(rows, "site string, query string, page bigint, ok boolean, items " + sites.ITEMS)
    found = by_site(sites.search_walk(frame, pages=6, most=15, since=F.lit("2025-01-01").cast("timestamp")).collect())
    assert {s: [r.url for r in sorted(own, key=lambda r: r.place)] for s, own in found.items()} == {s: list(dict.fromkeys(own))[:15] for s, own in expected.items() if own}


def test_frontier_and_addresses(spark):
    candidates = spark.createDataFrame([(1, "https://www.a.org/n"), (1, "https://a.org/p"), (1, "https://a.org/f"), (1, "https://a.org/m"), (2, "https://a.org/m"), (2, None), (2, "https://a.org/m")], "search_id bigint, url string")
    stored = spark.createDataFrame([(1, "https://a.org/p", "pending"), (1, "https://a.org/f", "failed"), (1, "https://a.org/m", "matched"), (3, "https://a.org/n", "failed")], "search_id bigint, url string, status string")
    found = sorted((r.search_id, r.url, r.domain, r.status, r.queued) for r in sites.frontier(candidates, stored).collect())
    assert found == [(1, "https://a.org/f", "a.org", "failed", "again"), (1, "https://a.org/p", "a.org", "pending", "again"), (1, "https://www.a.org/n", "a.org", "pending", "new"), (2, "https://a.org/m", "a.org", "pending", "new")]
    t = spark.createDataFrame([("https://g/?q={keyword}&b={YYYY-MM-DD}&e={YYYY-MM-DD}&p={page}", "a b"), ("https://g/?q={keyword}&b={YYYY-MM-DD}", "$1"), ("https://g/{keyword}", "x")], "t string, k string")
    day = lambda s: F.lit(s).cast("date")
    made = [r[0] for r in t.select(sites.dated_search_url(F.col("t"), F.col("k"), F.lit(3), day("2026-01-01"), day("2026-02-03"))).collect()]
    assert made == ["https://g/?q=a+b&b=2026-01-01&e=2026-02-03&p=3", "https://g/?q=%241&b=2026-01-01", "https://g/x"]
    assert [r[0] for r in t.select(sites.paged_search_url(F.lit("https://i/{keyword}"), F.col("k"), F.lit(2))).collect()][0] == "https://i/a+b?page=2"


def test_every_sitemap_entry_is_scored(spark):
    """Beyond any number of later entries the best ones count."""
    late = spark.range(6000).select(F.concat(F.lit("https://e.com/new/"), F.col("id").cast("string")).alias("loc"), F.lit("2024-05-01").alias("lastmod"))
    rows = late.unionByName(spark.createDataFrame([("https://e.com/that/thing", "2024-01-01"), ("https://e.com/this", None)], "loc string, lastmod string"))
    found = discovery.sitemap_strategy(rows, F.lit(True), "th", 2).collect()
    assert [(r.url, r.relevance_score) for r in found] == [("https://e.com/that/thing", 2.0), ("https://e.com/this", 1.0)]
