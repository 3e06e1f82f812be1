"""Queries over landed pages: archives, texts, result lists, rules of hosts, walks, languages and running sums."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.lazy import arrow_udf
from ..operators import hosts, jobs, language, scan
from ..session import released, shared_folder, written
from ..sources import archive, html, results, sites, walks
from ..streaming import progress, sink, state
from .catalog import _t, query

# ---- archives --------------------------------------------------------------------------------


@arrow_udf("binary")
def _encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode(c, "replace") for t, c in zip(text, charset)])


@query("""SELECT page_id, url, CAST(200 AS BIGINT) AS status, CASE WHEN page_id % 4 IN (1, 3) THEN 'gb18030' ELSE 'utf-8' END AS charset, CAST(length(page) AS BIGINT) AS n_chars, md5(page) AS html_md5
 FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 3 THEN replace(html, 'charset="utf-8"', 'charset="gbk"') ELSE html END AS page FROM pages)""")
def page_archive(spark, d):
    """Pages as servers send them, a quarter each with its charset named rightly in UTF-8, as GB2312, nowhere but in the page, and wrongly as Latin; written to an archive and read back."""
    kind = F.col("page_id") % 4
    page = F.when(kind == 3, F.replace("html", F.lit('charset="utf-8"'), F.lit('charset="gbk"'))).otherwise(F.col("html"))
    named = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "text/html; charset=GB2312").when(kind == 2, "text/html").otherwise("text/html; charset=ISO-8859-1")
    body = _encoded(page, F.when(kind.isin(1, 3), "gb18030").otherwise("utf-8"))
    rows = _t(spark, d, "pages").select("url", F.concat(F.lit("urn:page:"), "page_id").alias("record_id"), F.lit("2026-01-02 03:04:05").cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"), named.alias("content_type"), body.alias("body"))
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    archive.write_responses(rows, folder)
    return archive.read_responses(spark, folder).select(F.substring_index("record_id", ":", -1).cast("bigint").alias("page_id"), "url", F.col("status").cast("bigint").alias("status"), "charset", F.length("html").cast("bigint").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


# ---- texts of the pages' template ------------------------------------------------------------

_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<!--.*?-->|<[^>]*>', ' ', 'gs'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \t\r\n]+', ' ', 'g'))"""


@query(rf"""WITH t AS (SELECT page_id, {_TEXT.format("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS article,
 {_TEXT.format("regexp_replace(html, '<head>.*?</head>|<nav>.*?</nav>|<footer>.*?(</footer>|$)', ' ', 'gs')")} AS page FROM pages)
SELECT page_id, CAST(length(body) AS BIGINT) AS body_chars, md5(body) AS body_md5 FROM (SELECT page_id, CASE WHEN length(article) >= 200 THEN article ELSE page END AS body FROM t)""")
def page_body_text(spark, d):
    e = html.extracted(F.col("html"), F.col("url"))
    return _t(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", F.length("e.body").cast("bigint").alias("body_chars"), F.md5(F.col("e.body").cast("binary")).alias("body_md5"))


# ---- result lists ----------------------------------------------------------------------------

_LISTS = r"""lists AS (SELECT page_id, page_id % 4 AS k, ['bing', 'duckduckgo', 'yahoo', 'google'][page_id % 4 + 1] AS engine, unnest(words) AS word, generate_subscripts(words, 1) AS position
 FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)"', 1) AS words FROM pages))"""


@query(rf"""WITH {_LISTS}, t AS (SELECT page_id, engine, CAST(position AS BIGINT) AS position, 'https://' || CASE k WHEN 0 THEN 'a.example.org/' WHEN 1 THEN 'b.example.org/' WHEN 2 THEN 'c.example.org/' ELSE 'd.example.org/' END || word AS target FROM lists)
SELECT page_id, engine, position, CASE WHEN engine IN ('duckduckgo', 'yahoo') THEN url_decode(replace(target, '+', ' ')) ELSE target END AS target FROM t
 WHERE NOT regexp_matches(lower(target), '\.(pdf|jpg|jpeg|png|gif|svg|zip|css|js|xml)$')""")
def engine_result_links(spark, d):
    """Pages whose menus are written as the result lists of four engines, with their redirects, read by the engines' rules."""
    kind = F.col("page_id") % 4
    as_list = lambda start: F.replace("html", F.lit('<li><a href="/'), F.lit(start))
    page = F.when(kind == 0, as_list('<li class="x b_algo"><p><a href="https://no.example.org/"></p><h2><a href="https://a.example.org/'))
    page = page.when(kind == 1, as_list('<li><a class="result__url" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fb.example.org%2F'))
    page = page.when(kind == 2, as_list('<div class="dd algo"><a href="https://r.search.yahoo.com/_ylt=1/RU=https%3a%2f%2fc.example.org%2f'))
    page = page.otherwise(as_list('<div class="g"><span><a href="https://d.example.org/'))
    engine = F.element_at(F.array(*map(F.lit, ("bing", "duckduckgo", "yahoo", "google"))), (kind + 1).cast("int"))
    rows = _t(spark, d, "pages").select("page_id", page.alias("html"), engine.alias("engine"))
    return results.search_results(rows, keep=("page_id",)).select("page_id", "engine", "position", "target")


@query(r"SELECT page_id, 'menu' AS engine, CAST(generate_subscripts(words, 1) AS BIGINT) AS position, unnest(words) AS href FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1) AS words FROM pages)")
def template_result_links(spark, d):
    """The pages' own menus, by a rule for their template."""
    rule = {"menu": results.Rule((("li", None), ("a", None))), "advert": results.Rule((("div", "ad"), ("a", None)))}
    rows = _t(spark, d, "pages").select("page_id", "html")
    read = F.pandas_udf(lambda pages: pages.map(lambda h: results.result_links(h, rule)), "array<struct<engine:string,position:bigint,href:string>>")
    return rows.select("page_id", F.explode(read("html")).alias("x")).select("page_id", "x.*")


# ---- walks -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS broken FROM events)
SELECT CAST(user_id AS VARCHAR) AS domain, CASE WHEN n = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS token, CAST(n AS BIGINT) AS rank FROM c WHERE broken = 0""")
def oai_token_walk(spark, d):
    """Each user's events as the pages of one harvest, an event's id as the token that leads to it; an error is a page that cannot be read."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = F.row_number().over(w) == 1
    pages = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("domain"), F.when(~first, F.col("event_id").cast("string")).alias("token"), F.lead("event_id").over(w).cast("string").alias("next_token"), (F.col("event_type") != "error").alias("ok"))
    return walks.walked(pages)


# ---- hosts -----------------------------------------------------------------------------------

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '')"


@query(rf"""WITH RECURSIVE h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s(host, part) AS (SELECT host, host FROM h UNION ALL SELECT host, substr(part, strpos(part, '.') + 1) FROM s WHERE strpos(part, '.') > 0),
 known AS (SELECT DISTINCT regexp_extract({_HOST}, '([^.]+\.example\.[a-z]+)$', 1) AS domain FROM pages WHERE page_id % 3 = 0 UNION SELECT 'example.net'),
 best AS (SELECT host, arg_max(part, length(part)) AS under FROM s WHERE part IN (SELECT domain FROM known) GROUP BY host)
SELECT page_id, p.host AS host, under FROM (SELECT page_id, {_HOST} AS host FROM pages) p LEFT JOIN best ON p.host = best.host""")
def host_domain_lookup(spark, d):
    rows = _t(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("host"))
    known = rows.where("page_id % 3 = 0").select(F.regexp_extract("host", r"([^.]+\.example\.[a-z]+)$", 1).alias("domain"))
    return hosts.domain_of(rows, known.unionByName(spark.createDataFrame([("example.net",)], "domain string")))


@query(rf"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
 texts AS (SELECT host, min(page_id) AS first FROM p GROUP BY host),
 j AS (SELECT p.*, first FROM p JOIN texts USING (host))
SELECT page_id, CASE WHEN first % 3 = 0 THEN NOT (starts_with(path, '/en') OR contains(path, '?')) OR starts_with(path, '/en/1') AND NOT regexp_matches(path, '^/en/1.*[?]') OR starts_with(path, '/fr?')
 WHEN first % 3 = 1 THEN NOT regexp_matches(path, '^/.*5$') ELSE true END AS allowed FROM j""")
def page_robots_allowed(spark, d):
    """Pages by rules of their hosts: one of three texts for each host, with rules of other agents, comments, wildcards and an end mark."""
    rows = _t(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("host"), "url")
    body = F.when(F.col("first") % 3 == 0, "User-agent: other\nDisallow: /\n\nUser-agent: *\n# a comment\nDisallow: /en\nAllow: /en/1 # more\nDisallow: /en/1*?\nDisallow: /*?\nAllow: /fr?\nCrawl-delay: 5").when(F.col("first") % 3 == 1, "user-agent:*\r\ndisallow:/*5$\r\nDisallow:")
    robots = rows.groupBy("host").agg(F.min("page_id").alias("first")).select("host", body.alias("body"))
    allowed = hosts.robots_allowed(rows.select("host", "url"), robots).distinct()
    return rows.join(allowed, ["host", "url"]).select("page_id", "allowed")


# ---- running sums ----------------------------------------------------------------------------


@query("SELECT event_id, CAST(round(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS cents_before FROM events")
def running_total(spark, d):
    """A running sum over the whole table as one group."""
    rows = _t(spark, d, "events").select("event_id", "ts", "value")
    return scan.running(rows, F.round(F.col("value") * 100).cast("bigint"), ["ts", "event_id"], name="cents_before").select("event_id", "cents_before")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, coalesce(sum(o_orderkey % 5 + 1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM orders) WHERE b < 1000")
def early_stop_hot_groups(spark, d):
    """What an early stop reads of five groups that hold all rows."""
    rows = _t(spark, d, "orders").withColumn("size", F.col("o_orderkey") % 5 + 1)
    return jobs.enough(rows, "o_orderpriority", ["o_orderkey"], "size", 1000).select("o_orderkey", "o_custkey")


# ---- languages -------------------------------------------------------------------------------


@query()
def page_language_detected(spark, d):
    """The language of each page by the profiles of documents, as if it had no tag."""
    known = language.profiles(_t(spark, d, "documents"))
    e = html.extracted(F.col("html"), F.col("url"))
    found = _t(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.lang", language.detected(F.col("e.body"), known).alias("x"))
    return found.select("page_id", F.col("lang").alias("tag"), F.col("x.lang").alias("detected"), F.col("x.margin").alias("margin"))


# ---- sites -----------------------------------------------------------------------------------


def _site_pages(spark, d):
    """site, n and url of the pages of each site, numbered by their ids."""
    rows = _t(spark, d, "pages").select(U.origin(F.col("url")).alias("site"), "page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return scan.numbered(rows, ["page_id"], ["site"], "n")


_SITE_PAGES = r"o AS (SELECT regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages), w AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n, length(site) % 4 AS k FROM o)"


@query(f"""WITH {_SITE_PAGES}, q AS (SELECT site, url, min(CASE WHEN k < 2 AND n % 3 = 0 THEN 2000000 + n WHEN k < 2 AND n % 3 = 2 THEN 1000000 + n ELSE n END) AS o FROM w WHERE k <> 3 AND NOT contains(lower(url), 'sitemap') GROUP BY 1, 2)
SELECT site, place, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY o) AS place FROM q) WHERE place <= 5""")
def site_sitemap_pages(spark, d):
    """Each site's pages in sitemaps of one of four kinds: named by a robots text with a nested one and one in text; at a guessed address as an index of three; a plain one; and none."""
    rows = _site_pages(spark, d).withColumn("k", F.length("site") % 4)
    third = F.col("n") % 3
    loc = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    part = rows.groupBy("site", "k").agg(*[F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", value.alias("e"))))), lambda x: x["e"]).alias(name) for name, cond, value in (("a", third == 1, loc), ("b", third == 2, loc), ("c", third == 0, loc), ("ct", third == 0, F.col("url")), ("all", F.lit(True), loc))])
    body = lambda entries: F.concat(F.lit("<urlset>"), F.array_join(entries, ""), F.lit("</urlset>"))
    at = lambda end: F.concat("site", F.lit(end))
    entry = lambda end: F.concat(F.lit("<sitemap><loc>"), at(end), F.lit("</loc></sitemap>"))
    file = lambda url, text: F.struct(url.alias("url"), text.alias("body"))
    maps = F.array(file(at("/a.xml"), body("a")), file(at("/b.xml"), body("b")), file(at("/c.xml"), body("c")))
    robots = F.concat(F.lit("User-agent: *\nSitemap: "), at("/a.xml"), F.lit("\nsitemap:"), at("/more/b.xml"), F.lit(" \r\nSITEMAP: "), at("/c.txt"))
    index = F.concat(F.lit("<sitemapindex>"), entry("/a.xml"), entry("/b.xml"), entry("/c.xml"), entry("/sitemap.xml"), F.lit("</sitemapindex>"))
    files = F.when(F.col("k") == 0, F.array(file(at("/robots.txt"), robots), file(at("/a.xml"), body("a")), file(at("/more/b.xml"), body("b")), file(at("/c.txt"), F.array_join("ct", "\n "))))
    files = files.when(F.col("k") == 1, F.concat(F.array(file(at("/sitemap_index.xml"), index)), maps)).when(F.col("k") == 2, F.array(file(at("/robots.txt"), F.lit("User-agent: *")), file(at("/sitemap.xml"), body("all"))))
    landed = part.select("site", F.explode(files).alias("f")).select("f.*")
    return sites.sitemap_pages(rows.select("site"), landed, 5)


@query(f"""WITH {_SITE_PAGES}, q AS (SELECT site, url, min(CASE WHEN k = 0 AND n % 2 = 0 THEN 1000000 + n ELSE n END) AS o FROM w WHERE k < 2 AND starts_with(url, 'http') GROUP BY 1, 2)
SELECT site, place, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY o) AS place FROM q) WHERE place <= 4""")
def site_feed_pages(spark, d):
    """Each site's pages in two feeds, in one, or in a file that is no feed."""
    rows = _site_pages(spark, d).withColumn("k", F.length("site") % 4)
    item = F.concat(F.lit("<item><link>"), "url", F.lit("</link></item>"))
    entry = F.concat(F.lit("<entry><link href='"), "url", F.lit("'/></entry>"))
    odd = F.col("n") % 2 == 1
    lists = rows.groupBy("site", "k").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", e.alias("e"))))), lambda x: x["e"]), "").alias(name) for name, cond, e in (("odd", odd, item), ("even", ~odd, entry), ("all", F.lit(True), entry))])
    file = lambda end, a, text, b: F.struct(F.concat("site", F.lit(end)).alias("url"), F.concat(F.lit(a), text, F.lit(b)).alias("body"))
    files = F.when(F.col("k") == 0, F.array(file("/atom.xml", "<feed>", F.col("even"), "</feed>"), file("/rss", "<rss><channel>", F.col("odd"), "</channel></rss>"))).when(F.col("k") == 1, F.array(file("/feed", "<feed>", F.col("all"), "</feed>"))).otherwise(F.array(file("/feed", "<html>", F.col("all"), "</html>")))
    return sites.feed_pages(rows.select("site"), lists.select(F.explode(files).alias("f")).select("f.*"), 4)


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), p AS (SELECT *, n // 5 + 1 AS page, n // 5 + 1 = 6 + user_id % 5 AS bad, user_id % 7 = 0 AS told FROM e), f AS (SELECT user_id, min(page) FILTER (WHERE bad AND user_id % 3 = 0) AS gap FROM p GROUP BY 1)
SELECT 'https://w' || CAST(p.user_id AS VARCHAR) || '.org' AS site, row_number() OVER (PARTITION BY p.user_id ORDER BY n) AS place, 'https://w.org/' || CAST(event_id AS VARCHAR) AS url, 'A & ' || CAST(event_id AS VARCHAR) AS title
 FROM p JOIN f USING (user_id) WHERE (gap IS NULL OR page < gap) AND (NOT told OR page <= 4) QUALIFY row_number() OVER (PARTITION BY p.user_id ORDER BY n) <= 60""")
def wordpress_list_walk(spark, d):
    """Each user's events as a site's lists of five posts; of some sites a list fails, others tell that there are four lists."""
    rows = scan.numbered(_t(spark, d, "events").select("user_id", "event_id"), ["event_id"], ["user_id"], "n", 0).withColumn("page", F.floor(F.col("n") / 5) + 1)
    i = F.col("event_id").cast("string")
    post = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("https://w.org/"), i).alias("link"), F.struct(F.concat(F.lit("A &amp; "), i).alias("rendered")).alias("title"))
    lists = rows.groupBy("user_id", "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", post.alias("p")))), lambda x: x["p"])).alias("body"))
    u = F.col("user_id")
    bad = (F.col("page") == 6 + u % 5) & (u % 3 == 0)
    landed = lists.select(F.concat(F.lit("https://w"), u.cast("string"), F.lit(".org")).alias("site"), F.lit("posts").alias("kind"), "page", F.when(bad, 400).otherwise(200).alias("status"), F.when(u % 7 == 0, 4).cast("bigint").alias("total"), F.when(bad, "{}").otherwise(F.col("body")).alias("body"))
    return sites.wordpress_walk(landed, 60).select("site", "place", "url", "title")


@query("""WITH e AS (SELECT user_id % 40 AS site, user_id AS query, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), p AS (SELECT *, n // 4 + 1 AS page FROM e),
 r AS (SELECT * FROM p WHERE page < CASE query % 4 WHEN 0 THEN 7 WHEN 1 THEN 9 ELSE 61 END AND (ts >= TIMESTAMP '2024-01-05' OR query % 2 = 1))
SELECT site, place, url FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY CAST(query AS VARCHAR), n) AS place, 'https://n.cn/' || CAST(event_id AS VARCHAR) AS url FROM r) WHERE place <= 100""")
def site_search_walk(spark, d):
    """Each user's events as the answers of a site's search, four items each: JSON with times for even users, else links of a page. One search ends in an error, one repeats its page, others end with their events."""
    rows = scan.numbered(_t(spark, d, "events").select("user_id", "event_id", "ts"), ["event_id"], ["user_id"], "n", 0).withColumn("page", F.floor(F.col("n") / 4) + 1)
    u, i = F.col("user_id"), F.col("event_id").cast("string")
    record = F.struct(F.concat(F.lit("//n.cn/"), i).alias("url"), i.alias("title"), F.unix_millis(F.col("ts").cast("timestamp")).alias("publishTime"))
    anchor = F.concat(F.lit("<p><a class=x href='/"), i, F.lit("'><b>"), i, F.lit("</b></a><a href='/about'>about</a></p>"))
    by_page = rows.groupBy("user_id", "page").agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", record.alias("r")))), lambda x: x["r"]).alias("list")).alias("data"))).alias("json"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", anchor.alias("a")))), lambda x: x["a"]), "").alias("html"))
    answers = by_page.select((u % 40).alias("site"), u.cast("string").alias("query"), "page", (~((u % 4 == 0) & (F.col("page") == 7))).alias("ok"), F.when(u % 2 == 0, sites.json_items(F.col("json"))).otherwise(sites.matching_items(F.col("html"), "https://n.cn", [r"/\d+$"])).alias("items"))
    # searches of the second kind answer their ninth page with the eighth
    eighth = answers.where((F.col("query").cast("bigint") % 4 == 1) & (F.col("page") == 8)).withColumn("page", F.lit(9).cast("bigint"))
    others = answers.where(~((F.col("query").cast("bigint") % 4 == 1) & (F.col("page") == 9)))
    return sites.search_walk(others.unionByName(eighth), most=100, since=F.lit("2024-01-05").cast("timestamp")).select("site", "place", "url")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://g.cn/s?q=' || k || '&b=' || strftime(o_orderdate::DATE - 90, '%Y-%m-%d') || '&e=' || strftime(o_orderdate::DATE, '%Y-%m-%d') || '&page=' || CAST(p AS VARCHAR)
 ELSE 'https://ifa.np/en/news/?q=' || k || CASE WHEN p > 1 THEN '&page=' || CAST(p AS VARCHAR) ELSE '' END END AS url FROM (SELECT *, replace(o_orderpriority, ' ', '+') AS k, o_orderkey % 3 + 1 AS p FROM orders)""")
def search_url_dated(spark, d):
    """Search addresses with date placeholders, and those whose template has no page."""
    page, day = F.col("o_orderkey") % 3 + 1, F.col("o_orderdate").cast("date")
    dated = sites.dated_search_url(F.lit("https://g.cn/s?q={keyword}&b={YYYY-MM-DD}&e={YYYY-MM-DD}&page={page}"), F.col("o_orderpriority"), page, F.date_sub(day, 90), day)
    paged = sites.paged_search_url(F.lit("https://ifa.np/en/news/?q={keyword}"), F.col("o_orderpriority"), page)
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, dated).otherwise(paged).alias("url"))


@query(r"""WITH s AS (SELECT page_id % 5 AS search_id, url, min(CASE page_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'matched' ELSE 'skipped' END) AS status FROM pages WHERE page_id % 2 = 0 GROUP BY 1, 2)
SELECT DISTINCT page_id % 5 AS search_id, p.url AS url, coalesce(status, 'pending') AS status, CASE WHEN status IS NULL THEN 'new' ELSE 'again' END AS queued FROM pages p LEFT JOIN s ON s.search_id = p.page_id % 5 AND s.url = p.url WHERE status IS NULL OR status IN ('pending', 'failed')""")
def frontier_requeued(spark, d):
    i = F.col("page_id")
    rows = _t(spark, d, "pages").select((i % 5).alias("search_id"), "url", "page_id")
    status = F.when(i % 7 == 0, "failed").when(i % 7 == 1, "pending").when(i % 7 == 2, "matched").otherwise("skipped")
    return sites.frontier(rows, rows.where(i % 2 == 0).select("search_id", "url", status.alias("status"))).drop("domain")


# ---- streams that run ------------------------------------------------------------------------


def _arrived(spark, rows, order, batches: int, start) -> str:
    """Rows land as so many folders in their order, and what ``start(stream, folder)`` starts runs to its end after each: one micro-batch of as many files as were written. A folder for what it writes."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    dealt = written(scan.numbered(rows, order, name="_n", start=0), "dealt")
    total = max(1, dealt.count())
    for k in range(batches):
        lo, hi = (-(-j * total // batches) for j in (k, k + 1))
        dealt.where((F.col("_n") >= lo) & (F.col("_n") < hi)).drop("_n").write.parquet(f"{folder}/in/{k:03d}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        start(stream, folder).awaitTermination()
    released(dealt)
    return folder


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_progress_log(spark, d):
    """Progress in update mode, three batches of events that arrive out of order, into the keyed log."""
    events = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = lambda folder: sink.KeyedLog(spark, f"{folder}/out", ["window_start", "event_type"], "window_start timestamp, event_type string, n long, total double")
    folder = _arrived(spark, events, ["user_id", "event_id"], 3, lambda stream, to: sink.keyed(progress.progress(stream, late="1000 days"), log(to), f"{to}/checkpoint"))
    return log(folder).table().select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH k AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS host, round(max(t - n * 3600) OVER (PARTITION BY user_id ORDER BY n) + n * 3600, 3) AS start_at FROM k""")
def stream_spaced_hosts(spark, d):
    """Events as requests to their users' hosts, an hour apart at least, with state that forgets silent hosts."""
    events = _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("host"))
    with state.rocksdb(spark):
        folder = _arrived(spark, events, ["ts", "event_id"], 3, lambda stream, to: state.spaced_hosts(stream, 3600.0).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema("host string, event_id long, start_at double").parquet(f"{folder}/out").select("event_id", "host", F.round("start_at", 3).alias("start_at"))


@query("SELECT page_id AS id, page_id % 5 IN (0, 3) AS kept FROM pages")
def stream_first_kept(spark, d):
    """Pages that arrive in three batches, in groups of five: a first, one two bits from it, one three bits from it, one six bits from it, and a copy of the second."""
    i = F.col("page_id")
    base = F.conv(F.substring(F.md5(F.floor(i / 5).cast("string")), 1, 15), 16, 10).cast("bigint")
    flips = F.element_at(F.array(*map(F.lit, (0, 0b101, 0b1011 << 20, 0b111111 << 40, 0b101))), (i % 5 + 1).cast("int")).cast("bigint")
    rows = _t(spark, d, "pages").select(i.alias("id"), F.md5(F.when(i % 5 == 4, i - 3).otherwise(i).cast("string")).alias("h"), base.bitwiseXOR(flips).alias("p"))
    with state.rocksdb(spark):
        folder = _arrived(spark, rows, ["id"], 3, lambda stream, to: state.first_kept_stream(stream, f"{to}/out", f"{to}/checkpoint", marks=("h", "p")))
    return sink.KeyedLog(spark, f"{folder}/out", ["id"], "id long, kept boolean").table().select("id", "kept")


@query("""WITH j AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total, o_orderdate, o_orderpriority FROM orders), b AS (SELECT *, CAST(floor(n * 3.0 / total) AS INT) AS batch FROM j)
SELECT id, CASE WHEN place <= 10 THEN 'processing' ELSE 'pending' END AS status, batch FROM (SELECT id, 0 AS batch, row_number() OVER (ORDER BY o_orderdate, id) AS place FROM b WHERE batch = 0) WHERE place <= 10""")
def stream_claimed_first(spark, d):
    """Orders that arrive in three batches as submissions; ten are claimed in a batch. What the first batch has claimed."""
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"), F.col("o_orderpriority").alias("keyword"))
    log = lambda folder: sink.KeyedLog(spark, f"{folder}/out", ["id"], "id long, submitted_at timestamp, keyword string, status string")
    folder = _arrived(spark, rows, ["id"], 3, lambda stream, to: sink.keyed(stream, log(to), f"{to}/checkpoint", "append", sink.claimed(log(to), 10)))
    return log(folder).rows().where("batch = 0 and status = 'processing'").select("id", "status", F.col("batch").cast("int").alias("batch"))
