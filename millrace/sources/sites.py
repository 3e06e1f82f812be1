"""Sites walked over what has landed of them: sitemaps from robots lines or guesses, feeds, WordPress lists and searches.

A crawler's loop over one site is here a plan over all sites: what the loop would read next is joined to
the landed responses, and where the loop would stop is a condition on the places of its steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators.scan import numbered
from ..session import written
from . import feeds

# fixed values: where sitemaps and feeds are looked for, and how much of each source is read
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/news-sitemap.xml", "/sitemaps/sitemap.xml", "/sitemap1.xml", "/post-sitemap.xml", "/page-sitemap.xml")
FEEDS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/feeds/posts/default", "/index.xml")
MOST_SITEMAP_URLS, MOST_FEED_URLS, MOST_URLS, SEARCH_PAGES = 500, 200, 500, 60
#: Sitemaps within sitemaps that are followed.
DEPTH = 8


def _one(landed: DataFrame) -> DataFrame:
    """One body for each url: the least, where several have landed."""
    return landed.where("url is not null and body is not null").groupBy("url").agg(F.min("body").alias("body"))


def _guessed(sites: DataFrame, endings: Sequence[str]) -> DataFrame:
    """site, place and url of the guesses for each site."""
    return sites.select("site", F.posexplode(F.array(*map(F.lit, endings))).alias("place", "end")).select("site", F.col("place").cast("bigint").alias("place"), F.concat("site", "end").alias("url"))


def _best(found: DataFrame, place: Sequence[str], most: int) -> DataFrame:
    """site, place (1, 2, ...) and url: each url where it comes first, the first ``most`` of a site."""
    first = found.groupBy("site", "url").agg(F.min(F.struct(*place)).alias("_p")).select("site", "url", *[F.col(f"_p.{c}").alias(c) for c in place])
    return numbered(first, place, ["site"], "rank").where(F.col("rank") <= most).select("site", F.col("rank").alias("place"), "url")


def sitemap_pages(sites: DataFrame, landed: DataFrame, most: int = MOST_SITEMAP_URLS) -> DataFrame:
    """site, place and url of the pages that the sitemaps of sites (site: an origin) name, among landed (url, body).

    A site's sitemaps are those of its robots text, or else nine guesses. They are read in the order in which they are named; one that names others
    (an address that ends in .xml or says sitemap) sends them to the end of the queue. Text sitemaps have an address a line. The first ``most`` distinct
    pages of a site count.
    """
    own = sites.select("site").where("site is not null").distinct()
    bodies = written(_one(landed), "bodies")
    lines = bodies.join(own.select("site", F.concat("site", F.lit("/robots.txt")).alias("url")), "url").select("site", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:[ \t]*(\S[^\r\n]*?)[ \t]*$"), 1)).alias("place", "url"))
    named = written(lines.groupBy("site", "url").agg(F.min("place").cast("bigint").alias("place")), "named")
    guesses = _guessed(own.join(named.select("site").distinct(), "site", "left_anti"), SITEMAPS)
    queue = written(named.select("site", "place", "url").unionByName(guesses), "queue")
    done, found = queue, []
    xml = F.substring("body", 1, 2000).rlike(r"(?i)<\?xml|<sitemap|<urlset|<sitemapindex")
    as_text = F.col("url").endswith(".txt") | (~xml & F.contains("body", F.lit("http")))
    links = F.when(as_text, F.regexp_extract_all("body", F.lit(r"(?m)^\s*(http\S.*?)\s*$"), 1)).when(xml, feeds.locations(F.col("body")))
    read = bodies.select("url", as_text.alias("plain"), links.alias("links")).where("links is not null")
    for depth in range(DEPTH):
        each = written(queue.join(read, "url").select("site", "place", "plain", F.posexplode("links").alias("at", "link")).select("site", "place", "plain", F.col("at").cast("bigint").alias("at"), F.trim("link").alias("url")), "links")
        nested = ~F.col("plain") & (F.col("url").endswith(".xml") | F.contains(F.lower("url"), F.lit("sitemap")))
        found.append(each.where(~nested).select("site", F.lit(depth).cast("bigint").alias("depth"), "place", "at", "url"))
        fresh = each.where(nested).groupBy("site", "url").agg(F.min(F.struct("place", "at")).alias("p")).select("site", "url", "p.place", "p.at").join(done.select("site", "url"), ["site", "url"], "left_anti")
        queue = written(numbered(fresh, ["place", "at"], ["site"], "n").select("site", F.col("n").alias("place"), "url"), "queue")
        if queue.isEmpty():
            break
        done = done.unionByName(queue)
    return _best(reduce(DataFrame.unionByName, found), ["depth", "place", "at"], most)


def feed_pages(sites: DataFrame, landed: DataFrame, most: int = MOST_FEED_URLS) -> DataFrame:
    """site, place and url of the pages that the feeds of sites (site: an origin) name: at the site's own address and eight guesses, in that order, items before entries."""
    own = sites.select("site").where("site is not null").distinct()
    asked = _guessed(own, ("", *FEEDS))
    is_feed = F.substring("body", 1, 1000).rlike(r"(?i)<rss|<feed|<channel")
    found = asked.join(_one(landed).where(is_feed), "url").select("site", "place", F.posexplode(feeds.feed_links(F.col("body"))).alias("at", "url"))
    return _best(found.withColumn("at", F.col("at").cast("bigint")), ["place", "at"], most)


def wordpress_walk(lists: DataFrame, most: int = MOST_URLS, kinds: Sequence[str] = ("posts", "pages")) -> DataFrame:
    """site, place, url, title and published_at of the posts that a site's lists give: lists (site, kind, page, status, total, body).

    The lists of a kind are read from page 1 until one has not landed, is no answer of 200, is no list or an empty one, or is the last of ``total``
    (as the first list tells it); the kinds one after the other; the first ``most`` posts of a site count.
    """
    one = lists.where("site is not null and page >= 1").groupBy("site", "kind", "page").agg(F.min(F.struct("status", "total", "body")).alias("x")).select("site", "kind", "page", "x.*")
    posts = F.from_json("body", feeds.WP_SCHEMA)
    read = written(one.withColumn("posts", F.when((F.col("status") == 200) & F.col("body").rlike(r"^\s*\["), posts)).select("site", "kind", "page", "total", F.when(F.size("posts") > 0, F.col("posts")).alias("posts")), "lists")
    last = read.groupBy("site", "kind").agg(F.min(F.when(F.col("page") == 1, F.col("total"))).alias("last"))
    rows = numbered(read.where("posts is not null").select("site", "kind", "page"), ["page"], ["site", "kind"], "n").where("n = page").drop("n")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    kept = rows.join(last, ["site", "kind"]).where("last is null or page <= last").join(read.select("site", "kind", "page", "posts"), ["site", "kind", "page"]).where(order > 0)
    each = kept.select("site", order.alias("k"), "page", F.posexplode("posts").alias("at", "p")).where("p.link is not null")
    ranked = numbered(each, ["k", "page", "at"], ["site"], "place").where(F.col("place") <= most)
    from .html import html_unescaped

    return ranked.select("site", "place", F.col("p.link").alias("url"), html_unescaped(F.col("p.title.rendered")).alias("title"), T.lenient_timestamp(F.col("p.date_gmt")).alias("published_at"))


# ---- searches of sites -----------------------------------------------------------------------

ITEMS = "array<struct<url:string,title:string,published_at:timestamp>>"


def json_items(body: Column) -> Column:
    """Items of a JSON answer in an envelope of any usual shape, with times in milliseconds."""
    records = feeds.json_records(body, "array<struct<url:string,title:string,publishTime:string>>")
    at = lambda r: F.timestamp_millis(F.floor(r["publishTime"].try_cast("double")).cast("bigint"))
    url = lambda r: F.when(r["url"].startswith("//"), F.concat(F.lit("https:"), r["url"])).otherwise(r["url"])
    return F.filter(F.transform(records, lambda r: F.struct(url(r).alias("url"), r["title"].alias("title"), at(r).alias("published_at"))), lambda x: x["url"].rlike("^https?://"))


def _anchors(body: Column, base: str) -> Column:
    """url and title of a page's links, by pattern; other links than absolute and rooted ones are left out."""
    anchor = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    title = lambda t: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(body, anchor, F.lit(1)).alias("h"), F.regexp_extract_all(body, anchor, F.lit(2)).alias("t"))
    return F.filter(F.transform(both, lambda x: F.struct(U.absolutize(F.trim(x["h"]), F.lit(base)).alias("url"), title(x["t"]).alias("title"))), lambda x: x["url"].isNotNull())


def dated_items(body: Column, base: str, pattern: str = r"/page/(\d{4})(\d{2})/\d+\.shtml") -> Column:
    """Links whose path carries year and month, dated to the month's first day."""
    day = lambda u: F.try_to_timestamp(F.concat(F.regexp_extract(u, pattern, 1), F.lit("-"), F.regexp_extract(u, pattern, 2), F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.transform(F.filter(_anchors(body, base), lambda x: x["url"].rlike(f"(?:{pattern})$")), lambda x: F.struct(x["url"], x["title"], day(x["url"]).alias("published_at")))


def matching_items(body: Column, base: str, patterns: Sequence[str], roots: Sequence[str] = ()) -> Column:
    """Links that match one of a profile's patterns, but for bare roots of listings; undated."""
    fits = F.lit("|".join(f"(?:{p})" for p in patterns) or "(?!)")
    bare = lambda u: reduce(lambda a, r: a | F.rtrim(u, F.lit("/")).endswith(r), roots, F.lit(False))
    return F.transform(F.filter(_anchors(body, base), lambda x: F.rlike(x["url"], fits) & ~bare(x["url"])), lambda x: F.struct(x["url"], x["title"], F.lit(None).cast("timestamp").alias("published_at")))


def dated_search_url(template: Column, keyword: Column, page: Column, begin: Column, end: Column) -> Column:
    """A search address whose template may hold {YYYY-MM-DD} for the first day, and again for the last."""
    mark = r"\{YYYY-MM-DD\}"
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    filled = F.regexp_replace(F.regexp_replace(template, F.lit(f"^(.*?){mark}"), F.concat(F.lit("$1"), day(begin))), F.lit(f"^(.*?){mark}"), F.concat(F.lit("$1"), day(end)))
    return U.search_url(filled, keyword, page)


def paged_search_url(template: Column, keyword: Column, page: Column) -> Column:
    """A search address whose template has no page: further pages are named by a parameter."""
    base = U.search_url(template, keyword, page)
    return F.when(page <= 1, base).otherwise(F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("page="), page.cast("string")))


def search_walk(answers: DataFrame, first: int = 1, pages: int = SEARCH_PAGES, most: int = MOST_URLS, since: Column | None = None) -> DataFrame:
    """site, place, url, title and published_at of what searches of sites find: answers (site, query, page, ok, items).

    A search is read from page ``first`` on until an answer has not landed, is not ok, has no items or the same links as the one before, and for
    ``pages`` pages at most; a site's searches one after the other. Items known to be older than ``since`` are left out, repeated ones count where they come first, and the first ``most`` of a site are given.
    """
    read = answers.where((F.col("page") >= first) & (F.col("page") < first + pages) & F.col("ok") & (F.size("items") > 0))
    # at most ``pages`` answers of a search
    w = Window.partitionBy("site", "query").orderBy("page")
    links = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["url"])))
    walked = read.withColumn("_links", links).withColumn("_n", F.row_number().over(w) - 1 + first).withColumn("_ends", F.coalesce(F.lag("_links").over(w) == F.col("_links"), F.lit(False)) | (F.col("_n") != F.col("page")))
    kept = walked.withColumn("_over", F.max(F.col("_ends").cast("int")).over(w)).where("_over = 0")
    each = kept.select("site", "query", "page", F.posexplode("items").alias("at", "x")).select("site", "query", "page", "at", "x.*").where(F.col("url").rlike("^https?://"))
    if since is not None:
        each = each.where(F.coalesce(F.col("published_at") >= since, F.lit(True)))
    once = each.groupBy("site", "url").agg(F.min(F.struct("query", "page", "at", "title", "published_at")).alias("x")).select("site", "url", "x.*")
    return numbered(once, ["query", "page", "at"], ["site"], "place").where(F.col("place") <= most).select("site", "place", "url", "title", "published_at")


def frontier(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """What a job works on: candidates (search_id, url) that are not stored yet, as pending, and the stored ones (search_id, url, status) among them that are pending or failed; ``queued`` tells them apart."""
    wanted = candidates.select("search_id", "url").where("url is not null").distinct()
    known = stored.groupBy("search_id", "url").agg(F.min("status").alias("status"))
    both = wanted.join(known, ["search_id", "url"], "left")
    again = F.col("status").isin("pending", "failed")
    return both.where(F.col("status").isNull() | again).select("search_id", "url", U.domain(F.col("url")).alias("domain"), F.when(again, F.col("status")).otherwise("pending").alias("status"), F.when(again, "again").otherwise("new").alias("queued"))
