"""Queries whose inputs Spark derives from the given tables: payloads, configuration, labels, responses and expressions.

The SQL derives the same inputs by its own means and spells every fixed value out, so that a wrong
one in the engine does not agree with itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import classify as C
from ..operators import jobs as J
from ..operators import keywords as K
from ..operators import quality as Q
from ..operators import scan
from ..sources import discovery as D
from ..sources import feeds, html, sinks
from . import records as R
from .catalog import _rounded, _t, query
from .lifecycle import _REGIONAL, _STORED, _now, _stored


def _pick(values, at: Column) -> Column:
    """values[at modulo their number]; None is null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def _picked(values, at: str) -> str:
    """The same in SQL."""
    cells = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{cells}]::VARCHAR[])[({at}) % {len(values)} + 1]"


# ---- addresses, dates and names --------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://e.com/?s=' || q || '&p=' || CAST(p_size AS VARCHAR) ELSE 'https://e.com/find/' || q END AS url
 FROM (SELECT *, replace(replace(replace(replace(p_name, ' ', '+'), 'a', '%26a'), 'e', 'e~'), 'i', 'i%2A') AS q FROM part)""")
def search_url_template(spark, d):
    keyword = F.replace(F.replace(F.replace("p_name", F.lit("a"), F.lit("&a")), F.lit("e"), F.lit("e~")), F.lit("i"), F.lit("i*"))
    rows = _t(spark, d, "part").select("p_partkey", _pick(("https://e.com/?s={keyword}&p={page}", "https://e.com/find/{keyword}"), F.col("p_partkey")).alias("template"), keyword.alias("keyword"), "p_size")
    return rows.select("p_partkey", U.search_url(F.col("template"), F.col("keyword"), F.col("p_size")).alias("url"))


@query("""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(?i)(the|amp|l\\.)', '<mark>\\1</mark>', 'g')) AS marked_md5 FROM pages""")
def text_highlight(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.highlight(F.col("html"), ["the", "amp", "x", "l."]).cast("binary")).alias("marked_md5"))


_STAMPS = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || 'garbage' WHEN 3 THEN event_type WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' END"


@query(f"""SELECT event_id, strftime(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS at, {_STAMPS} AS v FROM events""")
def date_parse_lenient(spark, d):
    ts = F.col("ts").cast("timestamp")
    day, second = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 6
    v = F.when(kind == 0, F.concat(second, F.lit("Z"))).when(kind == 1, day).when(kind == 2, F.concat(day, F.lit("garbage"))).when(kind == 3, F.col("event_type")).when(kind == 4, F.concat(second, F.lit("+02:00")))
    return _t(spark, d, "events").select("event_id", v.alias("v")).select("event_id", F.date_format(T.lenient_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss").alias("at"), "v")


_NAMES = ("By ", "posted by  ", "BY\t", "Byron ", "", "By by ")


@query("SELECT s_suppkey, " + _picked(("", "", "", "Byron ", "", "by "), "s_suppkey") + " || s_name AS author FROM supplier")
def author_prefix(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", T.author_name(F.concat(_pick(_NAMES, F.col("s_suppkey")), "s_name")).alias("author"))


_SITES = ("cgtn.com", "www.cgtn.com", "a.b.stats.gov.cn", "notcgtn.com", "cgtn.com.evil.org", "news.cn", "x.com", "en.cn.com", "WWW.FMPRC.gov.cn", "chinadaily.com.cn")


@query(f"SELECT page_id, coalesce({_REGIONAL.replace('url,', 'lower(url),')} AND starts_with(url, 'http'), false) AS regional FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(url, 'http', 'ftp') ELSE regexp_replace(url, '//[^/?#]*', '//' || {_picked(_SITES, 'page_id')}) END AS url FROM pages)")
def url_regional_source(spark, d):
    moved = F.regexp_replace("url", F.lit("//[^/?#]*"), F.concat(F.lit("//"), _pick(_SITES, F.col("page_id"))))
    url = F.when(F.col("page_id") % 7 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(moved)
    return _t(spark, d, "pages").select("page_id", J.is_regional(url).alias("regional"))


# ---- labels ----------------------------------------------------------------------------------

_HOSTS = ("www.state.gov", "mit.edu", "x.ac.uk", "springer.com", "brookings.org", "news.example.com", "blog.example.org", "www.nature.com", "rusi.org", "e.net", "a.thinktank.eu")
_PATHS = ("report.pdf", "policy-brief.pdf", "podcast/e", "watch/v", "webinar/x", "novel/b", "story", "2024/news", "journal/a", "a?listen=1", "summit", "plain", "clip.html")
_TITLES = ("", "Advisory on trade", "A video of the army", "Book of the sea", None, "Conference in Japan", "Fiscal vote", "The U.S. and the EU")
_PHRASES = ("", "maritime security in the Indo-Pacific", "the US and India", "an election in North Korea and South Korea", "a cyber attack, a crisis, a threat", "growth, trade, success", "weapons for Ukraine and the United States", "usa and Burma and burmese", "Europe, Africa", None, "cooperation and alliance after the clash")
_CODES = ("en", "FR", "zh", "xx", None, "my", "")

# fixed values: words of the labels, as SQL compares them
_SQL_WORDS = {
    "Podcast": "podcast audio listen soundcloud",
    "Video": "video youtube vimeo watch broadcast clip",
    "Event": "event webinar conference summit workshop seminar",
    "Book": "book monograph novel",
}
_SQL_THEMES = {
    "Maritime": "sea port vessel ship maritime ocean naval shipping harbor strait submarine",
    "Defence": "army weapon missile military defence defense soldier navy war combat arsenal ammunition",
    "Security": "security cyber threat intelligence police attack terrorism espionage surveillance",
    "Politics": "politics election government parliament vote senate congress policy regime geopolitics diplomatic",
    "Economy": "economy trade gdp finance fiscal inflation market tariff economic business commerce",
}
_SQL_PLACES = "India|China|United States|USA|Pakistan|Myanmar|Burma|Russia|Japan|Taiwan|Iran|North Korea|South Korea|Vietnam|Philippines|Indonesia|Malaysia|Singapore|Thailand|Bangladesh|Sri Lanka|Maldives|Australia|Ukraine|United Kingdom|UK".split("|")
_SQL_REGIONS = "Indo-Pacific|Asia-Pacific|South Asia|Southeast Asia|Middle East|Europe|Africa|Americas".split("|")
_SQL_POSITIVE = "positive success growth win alliance cooperation support benefit strengthen advance develop"
_SQL_NEGATIVE = "negative fail crisis threat conflict warn clash tension dispute protest risk damage"
_SQL_LANGUAGES = "CASE lower(coalesce({0}, 'en')) WHEN 'ur' THEN 'Urdu' WHEN 'my' THEN 'Burmese' WHEN 'hi' THEN 'Hindi' WHEN 'zh' THEN 'Chinese' WHEN 'ru' THEN 'Russian' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'ja' THEN 'Japanese' WHEN 'ar' THEN 'Arabic' ELSE 'English' END"


def _holds(words: str, *texts: str) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words.split() for t in texts) + ")"


def _named(names) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '\\b{n.lower()}\\b') THEN '{n}' END" for n in names) + "], lambda z: z IS NOT NULL)"


def _labelled(source: str, url: str = "url", title: str = "title", content: str = "content", lang: str = "lang") -> str:
    """A chain of tables, the last named lab: source's columns with source_type, content_type, theme, geography, language_name and sentiment."""
    host = f"regexp_replace(lower(regexp_extract({url}, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '')"
    themes = ", ".join(f"CASE WHEN {_holds(w, 'x')} THEN '{k}' END" for k, w in _SQL_THEMES.items())
    count = lambda words: " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words.split())
    kinds = " ".join(f"WHEN {_holds(w, 'u', 'n')} THEN '{k}'" for k, w in _SQL_WORDS.items())
    return f"""t0 AS (SELECT *, lower({url}) AS u, {host} AS h, lower(coalesce({title}, '')) AS n, coalesce({title}, '') || ' ' || coalesce({content}, '') AS raw FROM {source}),
 t1 AS (SELECT *, lower(raw) AS x FROM t0),
 t2 AS (SELECT *, CASE WHEN contains(h, '.gov') THEN 'Government' WHEN {_holds('.edu .ac.', 'h')} THEN 'Research Institute' WHEN {_holds('journal springer ieee sciencedirect nature academic researchgate', 'h', 'u')} THEN 'Journal'
  WHEN {_holds('thinktank brookings rand csis chathamhouse cfr rusi sipri iiss lowyinstitute', 'h', 'u')} THEN 'Think Tank' ELSE 'News' END AS source_type, {_named(_SQL_PLACES)} AS places, {_named(_SQL_REGIONS)} AS regions,
  array_to_string(list_filter([{themes}], lambda z: z IS NOT NULL), ', ') AS th, {count(_SQL_POSITIVE)} AS good, {count(_SQL_NEGATIVE)} AS bad FROM t1),
 lab AS (SELECT *, CASE WHEN contains(u, 'pdf') THEN CASE WHEN {_holds('policy brief memo advisory recommendation', 'u', 'n')} THEN 'Policy Brief' ELSE 'Report' END {kinds} WHEN source_type = 'Journal' THEN 'Journal' ELSE 'Article' END AS content_type,
  CASE WHEN th = '' THEN 'General' ELSE th END AS theme, coalesce(nullif(array_to_string(list_concat(list_concat(places, CASE WHEN regexp_matches(raw, '\\bUS\\b|\\bU\\.S\\.\\b') AND NOT list_contains(places, 'United States') THEN ['United States'] ELSE [] END), regions), ', '), ''), 'Global') AS geography,
  {_SQL_LANGUAGES.format(lang)} AS language_name, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS sentiment FROM t2)"""


_ARTICLES = f"a AS (SELECT doc_id AS id, 'https://' || {_picked(_HOSTS, 'doc_id')} || '/' || {_picked(_PATHS, 'doc_id')} AS url, {_picked(_TITLES, 'doc_id')} AS title, text || ' ' || {_picked(_PHRASES, 'doc_id')} AS content, {_picked(_CODES, 'doc_id')} AS lang FROM documents)"


@query(f"WITH {_ARTICLES}, {_labelled('a')} SELECT id, source_type, content_type, theme, geography, language_name AS language, sentiment FROM lab")
def article_labels(spark, d):
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("https://"), _pick(_HOSTS, i), F.lit("/"), _pick(_PATHS, i)).alias("url"), _pick(_TITLES, i).alias("title"), F.concat("text", F.lit(" "), _pick(_PHRASES, i)).alias("content"), _pick(_CODES, i).alias("lang"))
    url, title, content = F.col("url"), F.col("title"), F.col("content")
    return rows.select("id", C.source_type(url).alias("source_type"), C.content_type(url, title).alias("content_type"), C.subject_theme(title, content).alias("theme"), C.country_region(title, content).alias("geography"), C.language_name(F.col("lang")).alias("language"), C.sentiment(title, content).alias("sentiment"))


@query(f"""WITH {_STORED}, {_labelled('r', content='full_content', lang='language')}
SELECT url, CASE id % 3 WHEN 0 THEN 'a, b c' ELSE 'sea' END AS keyword, left(language_name, 20) AS language, left(geography, 50) AS country, sentiment, left(theme, 100) AS category, image_url, md5(coalesce(full_content, '')) AS content_md5, '2024-01-20 12:00:00' AS scraped_date, '2024-01-20 12:00:00' AS created_at, '2024-01-20 12:00:00' AS updated_at FROM lab""")
def sink_mapping_labels(spark, d):
    """The columns of the sink's rows that ``sink_mapping`` leaves out."""
    rows = R.sink_rows(_stored(spark, d), "sea", T.uuid5_dns(F.lit("search_query_7")), _now())
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("url", "keyword", "language", "country", "sentiment", "category", "image_url", F.md5(F.col("content").cast("binary")).alias("content_md5"), at("scraped_date"), at("created_at"), at("updated_at"))


@query(f"""WITH {_STORED}, w AS (SELECT *, CASE WHEN id % 5 = 0 THEN url || '.PDF' ELSE url END AS address, CASE WHEN id % 2 = 0 THEN 'Jane ' || id ELSE 'Unknown' END AS writer, coalesce(title, '') AS name FROM r), {_labelled('w', url='address', title='name', content='full_content', lang='language')}
SELECT md5(address) AS record_id, domain AS source_name, source_type, name AS title, address AS url, '2024-01-20T12:00:00' AS publication_date, writer AS author, content_type, theme AS subject_theme, geography AS country_region, language_name AS language, 'sea, navy' AS keywords,
 md5(full_content) AS full_text, 'sea, navy' AS tags, CASE WHEN id % 5 = 0 THEN address ELSE '' END AS pdf_link, coalesce(image_url, '') AS image_links, CASE WHEN id % 4 = 0 THEN 'v1, v2' ELSE '' END AS video_links, domain AS organization, '2024-01-20T12:00:00' AS scraped_date FROM lab""")
def archive_records_whole(spark, d):
    """All nineteen fields of archived pages."""
    i = F.col("id")
    videos = F.when(i % 4 == 0, F.array(F.lit("v1"), F.lit("v2"), F.lit("v1"))).otherwise(F.array().cast("array<string>"))
    rows = _stored(spark, d).select(F.when(i % 5 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")).alias("url"), F.col("domain").alias("source_name"), F.coalesce("title", F.lit("")).alias("title"), F.when(i % 2 == 0, F.concat(F.lit("Jane "), i.cast("string"))).otherwise("Unknown").alias("author"), "language", F.col("full_content").alias("full_text"), F.array_compact(F.array("image_url", "image_url")).alias("image_urls"), videos.alias("video_urls"))
    return R.archive_rows(rows, ["sea", "navy"], _now()).withColumn("full_text", F.md5(F.col("full_text").cast("binary")))


# ---- failures --------------------------------------------------------------------------------

_FAILED = ("502 Bad Gateway nginx", "", "cloudflare ray id 1 verify you are human", "503 Service Unavailable", "database error", "an ordinary end", "cloudflare captcha")
_NAMED = ("Fine", "x | 504: Gateway time-out", "Just a moment", "Fine", None, "404 Not Found", "Cloudflare")
# fixed values: phrases of error pages, as SQL compares them
_SQL_ERRORS = "['504 gateway time-out', '504 gateway timeout', '502 bad gateway', '503 service unavailable', '503 service temporarily unavailable', '500 internal server error', '403 forbidden', '404 not found', 'database error', 'database connection error', 'error establishing a database connection', 'site is down', 'maintenance mode', 'access denied', 'gateway time-out', 'gateway timeout', 'bad gateway']"
_SQL_SIGNALS = "['ray id', 'security check', 'ddos protection', 'verify you are human', 'checking your browser', 'enable cookies', 'enable javascript', 'captcha', 'turnstile', 'unusual traffic', 'browser validation']"


@query(f"""WITH e AS (SELECT doc_id, lower(trim(coalesce({_picked(_NAMED, 'doc_id')}, ''))) AS title, lower(CASE doc_id % 4 WHEN 0 THEN {_picked(_FAILED, 'doc_id // 7')} || left(text, 100) WHEN 1 THEN text || {_picked(_FAILED, 'doc_id // 7')} WHEN 2 THEN left(text, 90) || {_picked(_FAILED, 'doc_id // 7')} || text ELSE '' END) AS body FROM documents),
 s AS (SELECT *, length(body) AS n, len(list_filter({_SQL_SIGNALS}, lambda z: contains(body, z))) AS signs FROM e)
SELECT doc_id, trim(body) = '' OR (length(title) < 120 AND len(list_filter({_SQL_ERRORS}, lambda z: contains(title, z))) > 0) OR (n < 1200 AND len(list_filter({_SQL_ERRORS}, lambda z: instr(body, z) BETWEEN 1 AND 120)) > 0)
 OR (n < 250 AND len(list_filter({_SQL_ERRORS}, lambda z: contains(body, z))) > 0) OR ((contains(body, 'cloudflare') OR contains(title, 'cloudflare')) AND (signs >= 2 OR (n < 1500 AND signs >= 1))) AS is_error FROM s""")
def error_page_flag(spark, d):
    i = F.col("doc_id")
    said = _pick(_FAILED, F.floor(i / 7))
    body = F.when(i % 4 == 0, F.concat(said, F.left("text", F.lit(100)))).when(i % 4 == 1, F.concat("text", said)).when(i % 4 == 2, F.concat(F.left("text", F.lit(90)), said, "text")).otherwise("")
    rows = _t(spark, d, "documents").select("doc_id", _pick(_NAMED, i).alias("title"), body.alias("body"))
    return rows.select("doc_id", Q.is_error_page(F.col("body"), F.col("title"), F.col("body")).alias("is_error"))


_FINAL = ("https://www.mfa.gov.cn/web/system/x.html", "https://www.mfa.gov.cn/a", "https://x.org/", "https://M.MFA.gov.cn/b")
_ANSWERS = ("", "<b>Just a moment</b>", "fine", "x cf-chl- x", "Checking your browser")


@query(f"""WITH e AS (SELECT event_id, {_picked(_FINAL, 'event_id')} AS url, 55400 + event_id % 1300 AS size, CASE event_id % 11 WHEN 0 THEN 'Challenge' WHEN 1 THEN 'x' END AS mitigated, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 403 ELSE 200 END AS status, {_picked(_ANSWERS, 'event_id // 4')} AS body FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 OR (event_id % 4 IN (1, 3) AND abs(size - 55990) < 500) THEN 'maintenance' WHEN event_id % 11 = 0 OR (status IN (403, 503) AND event_id // 4 % 5 IN (1, 3, 4)) THEN 'challenge' END AS verdict FROM e""")
def response_verdict(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "signup", 403).otherwise(200)
    rows = _t(spark, d, "events").select("event_id", _pick(_FINAL, i).alias("url"), (i % 1300 + 55400).alias("size"), F.when(i % 11 == 0, "Challenge").when(i % 11 == 1, "x").alias("mitigated"), status.alias("status"), _pick(_ANSWERS, F.floor(i / 4)).alias("body"))
    return rows.select("event_id", Q.response_verdict(*(F.col(c) for c in ("url", "size", "mitigated", "status", "body"))).alias("verdict"))


@query("""WITH a AS (SELECT event_id // 2 AS id, event_id % 2 + 1 AS attempt, event_type = 'purchase' AS ok, CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 403 ELSE 0 END AS code FROM events),
 l AS (SELECT *, ok OR code IN (404, 410, 401, 403) OR attempt >= 2 AS ends FROM a), f AS (SELECT id, coalesce(min(attempt) FILTER (WHERE ends), max(attempt)) AS t FROM l GROUP BY 1)
SELECT f.id, CAST(t AS BIGINT) AS tries, CASE WHEN NOT ends THEN 'pending' WHEN ok THEN 'fetched' ELSE 'failed' END AS status, CASE t WHEN 1 THEN 0.0 ELSE 1.0 END :: DOUBLE AS waited FROM f JOIN l ON l.id = f.id AND l.attempt = t""")
def retry_outcomes(spark, d):
    kind = F.col("event_type")
    code = F.when(kind == "purchase", 200).when(kind == "error", 500).when(kind == "signup", 404).when(kind == "click", 403).otherwise(0)
    return J.outcomes(_t(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("id"), (F.col("event_id") % 2 + 1).alias("attempt"), (kind == "purchase").alias("ok"), code.alias("code")))


@query("""WITH e AS (SELECT event_id, event_id % 5 AS k, CAST(ts AS DATE) - CAST(event_id % 200 AS INT) AS day FROM events)
SELECT event_id, CASE WHEN k IN (0, 2) OR (k IN (1, 4) AND day < DATE '2023-10-22') OR (k = 3 AND day < DATE '2023-10-22') THEN 'skipped' ELSE 'matched' END AS status,
 CASE WHEN k = 0 THEN 'Skipped: Homepage or category/index landing page content.' WHEN k = 2 THEN 'Skipped: Unable to verify article publication date.' WHEN day < DATE '2023-10-22' THEN 'Skipped: Article published more than 3 months ago (' || strftime(day, '%Y-%m-%d') || ').' END AS error_message FROM e""")
def keyword_free_mode(spark, d):
    """Pages of a source without keywords: front pages, articles with a date, without one, with one in their address, and with both."""
    i, k = F.col("event_id"), F.col("event_id") % 5
    day = F.date_sub(F.col("ts").cast("timestamp").cast("date"), (i % 200).cast("int"))
    number = i.cast("string")
    url = F.when(k == 0, _pick(("https://a.com/", "https://a.com/index.html", "https://a.com/world/"), F.floor(i / 5))).when(k == 3, F.concat(F.lit("https://a.com/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/story-"), number)).otherwise(F.concat(F.lit("https://a.com/n/story-"), number, F.lit(".html")))
    rows = _t(spark, d, "events").select("event_id", url.alias("url"), F.when(k.isin(1, 4), day).alias("day"))
    return rows.select("event_id", Q.keyword_free_verdict(F.col("url"), F.col("day"), F.lit("2024-01-20").cast("date")).alias("v")).select("event_id", "v.status", "v.error_message")


# ---- payloads --------------------------------------------------------------------------------


def _lists(spark, d, entry: Column, size: int):
    """Pages in lists of ``size``: id, and the entries of the list's pages in their order."""
    rows = _t(spark, d, "pages").select(F.floor(F.col("page_id") / size).alias("id"), F.struct("page_id", entry.alias("e")).alias("x"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("entries"))


@query("SELECT page_id // 20 AS id, url FROM pages")
def sitemap_locations(spark, d):
    """Pages written into sitemaps of twenty, half of them as CDATA, and read back."""
    loc = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))).otherwise(F.concat(F.lit("<sitemap><LOC>\n <![CDATA["), "url", F.lit("]]></LOC></sitemap>")))
    maps = _lists(spark, d, loc, 20).select("id", F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join("entries", "\n"), F.lit("</urlset>")).alias("body"))
    return maps.select("id", F.explode(feeds.locations(F.col("body"))).alias("url"))


@query("SELECT id, id % 3 = 2 AS is_map, id % 3 < 2 AS is_feed, CASE WHEN id % 3 < 2 THEN links ELSE '' END AS links FROM (SELECT page_id // 20 AS id, string_agg(url, ' ' ORDER BY page_id) AS links FROM pages GROUP BY 1)")
def feed_parse(spark, d):
    """Pages written into RSS, Atom and sitemap payloads by turns, told apart and read."""
    kind = F.floor(F.col("page_id") / 20) % 3
    entry = F.when(kind == 0, F.concat(F.lit("<item><title>x</title><link>"), "url", F.lit("</link></item>"))).when(kind == 1, F.concat(F.lit('<entry><id>1</id><link rel="alternate" href="'), "url", F.lit('"/></entry>'))).otherwise(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")))
    head = F.element_at(F.array(F.lit("<rss><channel>"), F.lit("<feed>"), F.lit("<urlset>")), (F.col("id") % 3 + 1).cast("int"))
    rows = _lists(spark, d, entry, 20).select("id", F.concat(F.lit('<?xml version="1.0"?>'), head, F.array_join("entries", "")).alias("body"))
    body = F.col("body")
    return rows.select("id", feeds.is_sitemap(body).alias("is_map"), feeds.is_feed(body).alias("is_feed"), F.array_join(feeds.feed_links(body), " ").alias("links"))


@query("SELECT event_id // 10 AS id, event_id AS record FROM events WHERE event_id // 10 % 6 < 4")
def json_record_list(spark, d):
    """Events in JSON lists of ten, bare, under keys one and two levels down, broken and under an unknown key."""
    rows = _t(spark, d, "events").select(F.floor(F.col("event_id") / 10).alias("id"), "event_id").groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("event_id")), lambda e: F.struct(e.alias("id")))).alias("list"))
    wrapped = F.element_at(F.array(*[F.concat(F.lit(a), "list", F.lit(b)) for a, b in (("", ""), ('{"data": ', "}"), ('{"x": 1, "data": {"items": ', "}}"), ('{"content": ', ', "total": 3}'), ('{"data": ', ""), ('{"other": ', "}"))]), (F.col("id") % 6 + 1).cast("int"))
    return rows.select("id", F.explode(feeds.json_records(wrapped, "array<struct<id:bigint>>")).alias("r")).select("id", F.col("r.id").alias("record"))


_UNESCAPED = r"replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;?', chr(1), 'g'), '&quot;', '\"'), chr(1), '&')"


@query(f"SELECT url, 'wp_api' AS source, {_UNESCAPED} AS title, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS published, CAST(page_id AS VARCHAR) AS post_id FROM pages WHERE page_id // 10 % 4 < 3")
def wp_json_map(spark, d):
    """Pages as WordPress lists of ten posts, a quarter of them cut short on the way."""
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    post = F.struct(F.col("page_id").alias("id"), F.col("url").alias("link"), at.alias("date_gmt"), F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("rendered")).alias("title"), F.struct(F.lit("x").alias("rendered")).alias("excerpt"))
    lists = _lists(spark, d, post, 10).select("id", F.to_json("entries").alias("json"))
    payloads = lists.select(F.when(F.col("id") % 4 < 3, F.col("json")).otherwise(F.left("json", F.length("json") - 5)).alias("body"))
    return feeds.wordpress_posts(payloads).select("url", "source", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.element_at("metadata", "id").alias("post_id"))


@query(r"""SELECT url, CASE WHEN page_id % 2 = 0 THEN 'T' || CAST(page_id AS VARCHAR) END AS title, CASE WHEN page_id % 2 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 100 AS INT)), '%Y-%m-%d') END AS published,
 CASE WHEN page_id % 3 = 0 THEN page_id / 4.0 ELSE CAST(length(lower(coalesce(CASE WHEN page_id % 2 = 0 THEN 'T' || CAST(page_id AS VARCHAR) || ' ' END, '') || url)) - length(replace(lower(coalesce(CASE WHEN page_id % 2 = 0 THEN 'T' || CAST(page_id AS VARCHAR) || ' ' END, '') || url), 'th', '')) AS DOUBLE) / 2 END :: DOUBLE AS relevance_score
 FROM pages WHERE page_id % 5 > 0 AND regexp_matches(url, '^https?://[^/?#]*example\.(com|org)([/?#]|$)') AND NOT regexp_matches(url, '/de/') AND (page_id % 2 = 1 OR page_id % 100 >= 20)""")
def discovery_seeder_rows(spark, d):
    """Pages as a seeder's lists of ten: every fifth invalid, every second with a title and dates, every third scored."""
    i = F.col("page_id")
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (i % 100) * 86400), "yyyy-MM-dd'T'HH:mm:ss")
    dates = F.array(F.struct(F.lit("bad").alias("datePublished")), F.struct(day.alias("datePublished")))
    head = F.when(i % 2 == 0, F.struct(F.concat(F.lit("T"), i.cast("string")).alias("title"), dates.alias("jsonld")))
    row = F.struct("url", F.when(i % 5 == 0, "not_valid").otherwise("valid").alias("status"), F.when(i % 3 == 0, i / 4.0).alias("relevance_score"), head.alias("head_data"))
    lists = _lists(spark, d, row, 10).select(F.to_json("entries").alias("body"))
    in_scope = U.host_in_scope(F.col("url"), "example.com") | U.host_in_scope(F.col("url"), "example.org")
    rows = D.seeder_rows(lists, in_scope, "th", [r"/de/"], since=F.lit("2024-01-21").cast("timestamp"))
    return rows.select("url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "relevance_score")


@query(r"""WITH e AS (SELECT DISTINCT url, min(page_id) AS i FROM pages GROUP BY url), t AS (SELECT url, i, CASE WHEN i % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(i % 60 AS INT)) END AS changed FROM e WHERE NOT regexp_matches(url, '/[a-d][^/]*/[^/]*$'))
SELECT url, CAST(length(lower(url)) - length(replace(lower(url), 'th', '')) AS DOUBLE) / 2 AS relevance_score, strftime(changed, '%Y-%m-%d') AS published FROM t WHERE changed IS NULL OR changed >= TIMESTAMP '2024-01-11' ORDER BY relevance_score DESC, url LIMIT 200""")
def discovery_sitemap_dates(spark, d):
    """Sitemap entries with real dates of change, a quarter without one and some that are none."""
    i = F.col("i")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (i % 60) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entries = _t(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("i")).select(F.col("url").alias("loc"), F.when(i % 4 > 0, at).when(i % 8 == 0, "soon").alias("lastmod"))
    rows = D.sitemap_strategy(entries, F.lit(True), "th", 200, listing=[r"/[a-d][^/]*/[^/]*$"], since=F.lit("2024-01-11").cast("timestamp"))
    return rows.select("url", "relevance_score", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query("""WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events), s AS (SELECT user_id, total // 2 AS last, total FROM u GROUP BY 1, 2, 3 HAVING total >= 4),
 l AS (SELECT s.user_id, k AS n, last FROM s, range(1, 121) t(x), LATERAL (SELECT last + x AS k) WHERE last + x <= total AND (last + x) % 13 > 0)
SELECT 'https://s.com/' || CAST(user_id AS VARCHAR) || '/p' AS prefix, '/' AS suffix, n, 'https://s.com/' || CAST(user_id AS VARCHAR) || '/p' || lpad(CAST(n AS VARCHAR), 4, '0') || '/' AS url FROM l
 WHERE n < last + coalesce((SELECT min(x) FROM range(1, 14) t(x) WHERE (last + x) % 13 = 0), 999)""")
def discovery_beyond_index(spark, d):
    """Each user's events as a numbered series of pages: the index lists the first half, and what lies beyond it is probed up to the first gap."""
    series = scan.numbered(_t(spark, d, "events").select("user_id", "event_id"), ["event_id"], ["user_id"], "n")
    url = F.concat(F.lit("https://s.com/"), F.col("user_id").cast("string"), F.lit("/p"), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("/"))
    total = series.groupBy("user_id").agg(F.max("n").alias("total")).where("total >= 4")
    rows = series.join(total, "user_id").withColumn("url", url)
    return D.beyond_index(rows.where(F.col("n") <= F.floor(F.col("total") / 2)).select("url"), rows.where((F.col("n") > F.floor(F.col("total") / 2)) & (F.col("n") % 13 > 0)).select("url"))


# ---- configuration and jobs ------------------------------------------------------------------

_ENTRIES = "c AS (SELECT c_custkey AS line, CASE c_custkey % 7 WHEN 0 THEN 'notaurl' WHEN 1 THEN NULL ELSE 'https://h' || CAST(c_custkey % 90 AS VARCHAR) || '.com' END AS url, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS label FROM customer)"
_REASONS = """k AS (SELECT *, coalesce(trim(url), '') = '' OR trim(label) = '' AS missing, NOT coalesce(regexp_matches(url, '^https?://'), false) AS bad FROM c),
 v AS (SELECT line, CASE WHEN missing THEN 'missing field' WHEN bad THEN 'invalid format' WHEN row_number() OVER (PARTITION BY url, missing, bad ORDER BY line) > 1 THEN 'duplicate in batch' WHEN url IN (SELECT 'https://h' || CAST(n_nationkey AS VARCHAR) || '.com' FROM nation) THEN 'duplicate' END AS reason FROM k)"""


def _validated(spark, d):
    i = F.col("c_custkey")
    url = F.when(i % 7 == 0, "notaurl").when(i % 7 > 1, F.concat(F.lit("https://h"), (i % 90).cast("string"), F.lit(".com")))
    rows = _t(spark, d, "customer").select(i.alias("line"), url.alias("url"), F.when(i % 11 == 0, " ").otherwise(F.col("c_name")).alias("label"))
    stored = _t(spark, d, "nation").select(F.concat(F.lit("https://h"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("url"))
    return sinks.validated(rows, stored, "url", ["url", "label"], "^https?://")


@query(f"WITH {_ENTRIES}, {_REASONS} SELECT line, reason FROM v")
def config_validate_split(spark, d):
    return _validated(spark, d).select("line", "reason")


@query(f"WITH {_ENTRIES}, {_REASONS} SELECT count(*) FILTER (WHERE reason IS NULL) AS added, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped, (SELECT string_agg('line ' || CAST(line AS VARCHAR) || ': ' || reason, '; ' ORDER BY line) FROM (SELECT * FROM v WHERE reason IS NOT NULL ORDER BY line LIMIT 5)) AS errors FROM v")
def config_summary(spark, d):
    return sinks.summary(_validated(spark, d)).withColumn("errors", F.array_join("errors", "; "))


@query("""WITH l AS (SELECT c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, * FROM customer)
SELECT n, line, 'https://' || c_name AS url, CASE WHEN c_custkey % 3 = 0 THEN 'https://' || c_name ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 3 = 1 THEN 'g' || CAST(c_custkey % 5 AS VARCHAR) ELSE 'general' END AS "group", CASE WHEN c_custkey % 3 = 2 THEN 'news' ELSE 'site' END AS type, 'en' AS language, CASE WHEN c_custkey % 3 = 2 THEN 'my note' ELSE '' END AS notes FROM l""")
def config_bulk_lines(spark, d):
    """Customers of each nation as lines of one text, bare, with a group, and with a type and notes; every second is followed by an empty line that has a number as well."""
    i = F.col("c_custkey")
    line = F.concat(F.lit("https://"), "c_name", F.when(i % 3 == 0, F.lit("")).when(i % 3 == 1, F.concat(F.lit(", "), "c_mktsegment", F.lit(" , g"), (i % 5).cast("string"))).otherwise(F.concat(F.lit(","), "c_mktsegment", F.lit(",,news,, my note "))))
    texts = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    each = texts.select("n", F.explode(F.array("text")).alias("text"))
    return D.bulk_lines(each, keep=["n"], group="general", type="site", language="en")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN ' ' || o_orderpriority || ' ' WHEN 1 THEN '  ' END AS keyword, CASE o_orderkey % 4 WHEN 3 THEN 'config' WHEN 2 THEN 'direct' ELSE 'search' END AS source_type, CASE o_orderkey % 5 WHEN 0 THEN 'https://a.com' WHEN 1 THEN '  ' END AS direct_urls FROM orders)
SELECT id, trim(coalesce(keyword, '')) AS keyword, CASE WHEN source_type = 'search' AND trim(coalesce(keyword, '')) = '' THEN 'keyword is required when source_type is ''search''' WHEN source_type = 'direct' AND trim(coalesce(direct_urls, '')) = '' THEN 'direct_urls field is required when source_type is ''direct''' END AS rejected FROM r""")
def job_submit(spark, d):
    i = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(i.alias("id"), F.when(i % 3 == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).when(i % 3 == 1, "  ").alias("keyword"), F.when(i % 4 == 3, "config").when(i % 4 == 2, "direct").otherwise("search").alias("source_type"), F.when(i % 5 == 0, "https://a.com").when(i % 5 == 1, "  ").alias("direct_urls"))
    return J.submitted(rows).select("id", "keyword", "rejected")


@query("""WITH g AS (SELECT CASE p_partkey % 40 WHEN 3 THEN 'china' WHEN 5 THEN 'myanmar' WHEN 7 THEN 'northeast_india' ELSE p_brand || '-' || p_type END AS key, CASE p_partkey % 40 WHEN 3 THEN 'Z' WHEN 5 THEN 'A' WHEN 7 THEN 'M' ELSE CASE WHEN length(p_type) % 2 = 0 THEN upper(p_name) ELSE p_name END END AS label FROM part), m AS (SELECT key, min(label) AS label FROM g GROUP BY key)
SELECT key, row_number() OVER (ORDER BY CASE key WHEN 'china' THEN 1 WHEN 'myanmar' THEN 2 WHEN 'northeast_india' THEN 3 ELSE 4 END, CASE WHEN key IN ('china', 'myanmar', 'northeast_india') THEN '' ELSE lower(label) END, label, key) AS place FROM m""")
def group_sorted(spark, d):
    k = F.col("p_partkey") % 40
    label = F.when(F.length("p_type") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    groups = _t(spark, d, "part").select(F.when(k == 3, "china").when(k == 5, "myanmar").when(k == 7, "northeast_india").otherwise(F.concat("p_brand", F.lit("-"), "p_type")).alias("key"), F.when(k == 3, "Z").when(k == 5, "A").when(k == 7, "M").otherwise(label).alias("label"))
    rows = groups.groupBy("key").agg(F.min("label").alias("label"))
    ordered = rows.select("key", *[c.alias(f"o{n}") for n, c in enumerate(R.group_order(F.col("key"), F.col("label")))])
    return scan.numbered(ordered, ["o0", "o1", "o2", "key"], name="place").select("key", "place")


# ---- expressions and scores ------------------------------------------------------------------


@query(f"SELECT event_id, {_rounded('x')} AS score FROM (SELECT event_id, value / 2 AS x FROM events)")
def score_rounding(spark, d):
    return _t(spark, d, "events").select("event_id", K.round_score(F.col("value") / 2).alias("score"))


_EXPRESSIONS = ("the AND que", '"de la" OR NOT ment', "(tion OR sch) AND NOT that", "the AND", "keit or", "NOT", "heit que", "(eau", "the AND-x", "NOT NOT ich", "")
_SQL_MATCHES = ("has('the') AND has('que')", "has('de la') OR NOT has('ment')", "(has('tion') OR has('sch')) AND NOT has('that')", "false", "has('keit')", "true", "has('heit')", "has('eau')", "has('the') AND has('-x')", "NOT has('not')", "false")
_SQL_TERMS = ("the,que", "de la,ment", "tion,sch,that", "the", "keit", "", "heit,que", "eau", "the,x", "ich", "")


@query("WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS expression, {m.replace('has(', 'contains(t, ')} AS matched, '{t}' AS terms FROM d" for e, m, t in zip(_EXPRESSIONS, _SQL_MATCHES, _SQL_TERMS)))
def boolean_expressions(spark, d):
    """Every document against expressions with groups, quotes, missing operands, and what follows a complete one."""
    found = F.array(*[F.struct(F.lit(e).alias("expression"), K.parse_boolean(e).match(F.col("text")).alias("matched"), F.lit(",".join(K.boolean_terms(e))).alias("terms")) for e in _EXPRESSIONS])
    return _t(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


# ---- fields of pages -------------------------------------------------------------------------

_HEADS = (
    '<meta name="description" content="About {0}"><meta property="og:image" content="/img/{0}.png"><script type="application/ld+json">{"@graph": [{"x": {"@type": ["Thing", "NewsArticle"], "author": [{"name": " Jane {0} "}], "datePublished": "2026-05-15T10:00:00Z"}}]}</script>',
    '<meta property="og:description" content=" Open {0} "><meta name="twitter:image" content="https://cdn.org/{0}.jpg"><meta property="article:published_time" content="2026-04-01"><meta name="author" content="Writer {0}">',
    '<link rel="image_src" href="../{0}.gif"><meta name="date" content="not one"><script type="application/ld+json">{"@type": "Article", "author": "Solo {0}"}</script><script type="application/ld+json">{broken</script>',
    "",
)
_BODIES = (
    '<figure><p><img src="a{0}.png" alt="alt" width="640px"></p><figcaption>cap <b>{0}</b></figcaption></figure><img data-src="/b.png"><img src="a{0}.png"><img>',
    '<time datetime="2026-03-02T01:02:03">then</time><div class="Byline">By  Some{0} One</div><img src="/logo.png"><img src="//c.org/x{0}.png">',
    '<iframe src="https://player.vimeo.com/{0}"></iframe><video poster="p.jpg"><source src="/v{0}.mp4"></video><embed src="e"><object></object>',
    '<h2>H{0} ¶</h2><h3>H{0} ¶</h3><ul><li>one</li><li>t{0}</li></ul><table><tr><th>a|b</th><td>{0}</td></tr><tr></tr></table><pre> x\n{0} </pre><blockquote>said {0}</blockquote><a rel="prev next" href="?page={0}">m</a>',
)


def _marked(text: str, at: Column) -> Column:
    return F.replace(F.lit(text), F.lit("{0}"), at.cast("string"))


_AT = r"regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_DIR = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '')"


@query(rf"""WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS i, url, page_id % 4 AS k, page_id // 4 % 4 AS b, {_AT} AS site, {_DIR} AS folder FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'About ' || i WHEN 1 THEN 'Open ' || i END AS description,
 CASE WHEN k = 0 THEN 'Jane ' || i WHEN k = 1 THEN 'Writer ' || i WHEN k = 2 THEN 'Solo ' || i WHEN b = 1 THEN 'Some' || i || ' One' ELSE 'Unknown' END AS author,
 CASE WHEN k = 1 THEN '2026-04-01' WHEN b = 1 THEN '2026-03-02' WHEN k = 0 THEN '2026-05-15' END AS published,
 CASE WHEN k = 0 THEN site || '/img/' || i || '.png' WHEN k = 1 THEN 'https://cdn.org/' || i || '.jpg' WHEN k = 2 THEN 'up' WHEN b = 0 THEN folder || '/a' || i || '.png' WHEN b = 1 THEN regexp_extract(url, '^[^:]+:') || '//c.org/x' || i || '.png' END AS image,
 CASE b WHEN 0 THEN folder || '/a' || i || '.png cap ' || i || ' 640; ' || site || '/b.png  -' WHEN 1 THEN site || '/logo.png  -; ' || regexp_extract(url, '^[^:]+:') || '//c.org/x' || i || '.png  -' ELSE '' END AS images,
 CASE b WHEN 2 THEN 'https://player.vimeo.com/' || i || ' vimeo ; ' || site || '/v' || i || '.mp4 html5 ' || folder || '/p.jpg; ' || folder || '/e iframe ' ELSE '' END AS videos,
 CASE b WHEN 3 THEN 'H' || i ELSE '' END AS heading, CASE b WHEN 3 THEN 'one,t' || i ELSE '' END AS list, CASE b WHEN 3 THEN 'a|b,' || i ELSE '' END AS cells, CASE b WHEN 3 THEN 'x' || chr(10) || i ELSE '' END AS code, CASE b WHEN 3 THEN 'said ' || i ELSE '' END AS quote,
 CASE b WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '?page=' || i END AS next_page FROM p""")
def page_marked_fields(spark, d):
    """Pages with marked heads and bodies of four kinds each: what is said about them, their media, lists, tables, code and next pages."""
    i = F.col("page_id")
    kinds = lambda texts, at: F.element_at(F.array(*[_marked(t, i) for t in texts]), (at + 1).cast("int"))
    page = F.concat(F.lit("<html><head><title>t</title>"), kinds(_HEADS, i % 4), F.lit("</head><body>"), kinds(_BODIES, F.floor(i / 4) % 4), F.lit("</body></html>"))
    e = html.extracted(page, F.col("url"))
    rows = _t(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.*")
    text = lambda *parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    sp = F.lit(" ")
    return rows.select(
        "page_id", "description", "author", "published", F.when(i % 4 == 2, F.when(F.col("image").endswith(".gif"), "up")).otherwise(F.col("image")).alias("image"),
        F.array_join(F.transform("images", lambda x: text(x["src"], sp, x["caption"], sp, x["width"])), "; ").alias("images"), F.array_join(F.transform("videos", lambda x: text(x["src"], sp, x["type"], sp, x["thumbnail"])), "; ").alias("videos"),
        F.array_join("headings", ",").alias("heading"), F.coalesce(F.array_join(F.get("lists", F.lit(0)), ","), F.lit("")).alias("list"), F.coalesce(F.array_join(F.flatten(F.get("tables", F.lit(0))), ","), F.lit("")).alias("cells"), first("code").alias("code"), first("quotes").alias("quote"), "next_page",
    )


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(u, '^http://', 'https://') ELSE u END AS forced, page_id % 4 < 2 OR regexp_matches(u, '\.(MP4|webm)([?#]|$)') AS video FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '//[^/?#]*', '//m.youtube.com') WHEN 1 THEN regexp_replace(url, '//[^/?#]*', '//youtu.be') WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 8 = 2 THEN '.MP4?x=1' ELSE '.webm#t' END ELSE regexp_replace(url, '//[^/?#]*', '//notvimeo.com') END AS u FROM pages)""")
def url_scheme_and_video(spark, d):
    i, host = F.col("page_id"), lambda name: F.regexp_replace("url", F.lit("//[^/?#]*"), F.lit(f"//{name}"))
    ended = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(i % 8 == 2, ".MP4?x=1").otherwise(".webm#t"))
    url = F.when(i % 4 == 0, host("m.youtube.com")).when(i % 4 == 1, host("youtu.be")).when(i % 4 == 2, ended).otherwise(host("notvimeo.com"))
    return _t(spark, d, "pages").select("page_id", U.force_https(url, i % 3 == 0).alias("forced"), U.is_video(url).alias("video"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN s_name WHEN s_suppkey % 4 = 2 THEN s_name || ', b' ELSE s_name || ', b (+2 more)' END AS shown, 'Group ' || CAST(s_suppkey AS VARCHAR) || ' Of Names' AS label FROM supplier""")
def keyword_and_group_labels(spark, d):
    i = F.col("s_suppkey")
    words = F.slice(F.array("s_name", F.lit("b"), F.lit("c"), F.lit("d")), F.lit(1), F.when(i % 4 == 3, 4).otherwise(i % 4).cast("int"))
    return _t(spark, d, "supplier").select("s_suppkey", T.keyword_display(words).alias("shown"), T.group_label(F.concat(F.lit("group_"), i.cast("string"), F.lit("_of_NAMES"))).alias("label"))


@query("SELECT url, (SELECT count(DISTINCT url) FROM pages) > 50 AS truncated FROM (SELECT DISTINCT url FROM pages) ORDER BY url LIMIT 50")
def candidates_capped(spark, d):
    rows, more = feeds.capped(_t(spark, d, "pages").select("url").distinct(), [F.col("url").asc()], 50)
    return rows.withColumn("truncated", F.lit(more))


@query(f"WITH {_STORED} SELECT id AS \"ID\", url AS \"URL\", coalesce(title, '') AS \"Title\", md5(coalesce(full_content, '')) AS content_md5, coalesce(occurrences, 0) AS \"Occurrences\" FROM r WHERE status = 'matched'")
def export_files_round_trip(spark, d):
    """Matched results exported as CSV parts and read back, texts with quotes, commas and line ends included."""
    import uuid

    from ..session import shared_folder

    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = R.export_rows(R.listed(_stored(spark, d), status="matched")).select("ID", "URL", "Title", F.col("Full Content").alias("content"), "Occurrences")
    sinks.export_parts(rows, folder, "csv")
    back = sinks.exported_parts(spark, folder, "csv", rows.schema)
    return back.select("ID", "URL", "Title", F.md5(F.col("content").cast("binary")).alias("content_md5"), "Occurrences")
