"""Queries of job states, listings, projections and filters, with their SQL.

Orders stand for jobs and events for their URLs. The SQL spells every fixed value out, so that a
wrong one in the engine does not agree with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import jobs as J
from ..operators import keywords as K
from ..sources import discovery as D
from ..sources import html, sinks
from . import records as R
from .catalog import _literal, _t, query

_NOW = "TIMESTAMP '2024-01-20 12:00:00'"
_JOBS = "j AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status FROM orders)"
_URLS = """u AS (SELECT event_id AS id, user_id AS search_id, CASE user_id % 5 WHEN 0 THEN 'https://www.cgtn.com/a/' WHEN 1 THEN 'https://news.globaltimes.cn/b/' WHEN 2 THEN 'https://example.cn.org/c/' WHEN 3 THEN 'https://notcgtn.com/d/' ELSE 'http://x.gov.cn/e/' END || CAST(event_id AS VARCHAR) AS url,
 CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'skipped' END AS status, CASE WHEN event_type = 'error' THEN 'boom' END AS error_message, ts, value FROM events)"""
_REGIONAL = "(regexp_matches(url, '^https?://(www\\.)?([^/?#]*\\.)?(chinadaily\\.com\\.cn|cgtn\\.com|globaltimes\\.cn|fmprc\\.gov\\.cn|stats\\.gov\\.cn)([/?#]|$)') OR regexp_matches(url, '^https?://[^/?#]*\\.cn([/?#]|$)'))"


def _now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


def _jobs(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("updated_at"))


def _crawl(spark, d) -> DataFrame:
    site = F.element_at(F.array(*map(F.lit, ("https://www.cgtn.com/a/", "https://news.globaltimes.cn/b/", "https://example.cn.org/c/", "https://notcgtn.com/d/", "http://x.gov.cn/e/"))), (F.col("user_id") % 5 + 1).cast("int"))
    kinds = F.create_map(*map(F.lit, ("purchase", "matched", "error", "failed", "signup", "pending")))
    status = F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("skipped"))
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("search_id"), F.concat(site, F.col("event_id").cast("string")).alias("url"), status.alias("status"), F.when(F.col("event_type") == "error", "boom").alias("error_message"), F.col("ts").cast("timestamp").alias("ts"), "value")


_SHOWN = ["id", "status", "error_message"]


@query(f"WITH {_JOBS}, m AS (SELECT max(id) AS n FROM j) SELECT id, owner, status FROM j UNION ALL SELECT n + row_number() OVER (ORDER BY id), owner, 'pending' FROM j, m WHERE id % 7 = 0 AND status = 'completed'")
def job_retry(spark, d):
    jobs = _jobs(spark, d)
    ids = jobs.where("id % 7 = 0 AND status = 'completed'").select("id")
    return J.retried(jobs, ids, jobs.agg(F.max("id")).first()[0] + 1).select("id", "owner", "status")


@query(f"WITH {_JOBS} SELECT l_orderkey AS search_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT id FROM j WHERE status <> 'pending') GROUP BY 1")
def job_delete_cascade(spark, d):
    jobs = _jobs(spark, d)
    _, children = J.without_jobs(jobs, {"urls": _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "search_id")}, jobs.where("status = 'pending'"))
    return children["urls"].groupBy("search_id").agg(F.count("*").alias("n"))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34) AND status NOT IN ('completed', 'failed', 'aborted') THEN 'aborted' ELSE status END AS status FROM j")
def job_stop(spark, d):
    return J.stopped(_jobs(spark, d), [1, 2, 3, 4, 5, 6, 7, 32, 33, 34], _now()).select("id", "status")


@query(f"WITH {_JOBS} SELECT id, CASE status WHEN 'processing' THEN 'failed' ELSE status END AS status, CASE status WHEN 'processing' THEN 'Recovered after server restart.' END AS error_message, CASE status WHEN 'processing' THEN '2024-01-20 12:00:00' END AS updated_at FROM j")
def job_recovery(spark, d):
    return J.recovered(_jobs(spark, d), _now()).select(*_SHOWN, F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(f"WITH {_URLS}, {_JOBS} SELECT u.id FROM u WHERE search_id NOT IN (SELECT id FROM j WHERE status = 'processing')")
def job_stopped_filter(spark, d):
    jobs = J._changed(_jobs(spark, d), F.col("status") == "processing", status=F.lit("aborted"))
    return J.of_running_jobs(_crawl(spark, d), jobs).select("id")


@query(f"WITH {_URLS} SELECT id, CASE WHEN search_id = 7 AND status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN search_id = 7 AND status = 'failed' THEN NULL ELSE error_message END AS error_message FROM u")
def url_reset(spark, d):
    return J.reset_urls(_crawl(spark, d), 7, "failed").select(_SHOWN)


@query(f"""WITH {_URLS} SELECT id, CASE WHEN status = 'pending' AND search_id IN (3, 4) THEN 'skipped' WHEN status = 'pending' AND search_id = 5 THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'pending' AND search_id IN (3, 4) THEN 'Crawl interrupted or skipped.' WHEN status = 'pending' AND search_id = 5 THEN 'Queue worker crash: no disk' ELSE error_message END AS error_message FROM u""")
def url_sweep(spark, d):
    return J.swept(J.swept(_crawl(spark, d), [3, 4]), [5], "no disk").select(_SHOWN)


@query(f"""WITH {_URLS} SELECT id, CASE WHEN status = 'pending' AND ts < {_NOW} - INTERVAL 45 SECOND THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'pending' AND ts < {_NOW} - INTERVAL 45 SECOND THEN 'Task exceeded maximum duration of 45 seconds.' ELSE error_message END AS error_message FROM u""")
def url_watchdog(spark, d):
    return J.timed_out(_crawl(spark, d).withColumnRenamed("ts", "started_at"), _now()).select(_SHOWN)


@query(f"""WITH {_URLS} SELECT id, CASE WHEN status = 'pending' AND search_id = 6 AND {_REGIONAL} THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'pending' AND search_id = 6 AND {_REGIONAL} THEN 'VPN routing failure: down' ELSE error_message END AS error_message FROM u""")
def url_routing_failure(spark, d):
    return J.routing_failed(_crawl(spark, d), 6, "down").select(_SHOWN)


@query(f"WITH {_URLS} SELECT CAST(CASE WHEN {_REGIONAL} THEN 1 ELSE 2 END AS BIGINT) AS phase, count(*) AS n, count(*) FILTER (WHERE status = 'pending') AS pending FROM u GROUP BY 1")
def url_phases(spark, d):
    return J.phases(_crawl(spark, d)).groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))


@query(f"""WITH {_JOBS}, s AS (SELECT user_id AS id, sum(CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END) c, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) m FROM events GROUP BY 1)
SELECT j.id, CAST(1 + coalesce(c, 0) AS BIGINT) AS total_urls_crawled, CAST(coalesce(m, 0) AS BIGINT) AS total_urls_matched FROM j LEFT JOIN s ON s.id = j.id""")
def job_counters(spark, d):
    reports = _crawl(spark, d).select("search_id", (F.col("status") != "pending").cast("bigint").alias("crawled"), (F.col("status") == "matched").cast("bigint").alias("matched"))
    jobs = _jobs(spark, d).withColumns({"total_urls_crawled": F.lit(1), "total_urls_matched": F.lit(None).cast("bigint")})
    return J.counted(jobs, reports).select("id", "total_urls_crawled", "total_urls_matched")


@query("""SELECT o_custkey AS search_query_id, o_orderpriority AS keyword, 'completed' AS status, count(*) AS articles_found FROM orders WHERE NOT (o_custkey = 4 AND o_orderpriority IN ('1-URGENT', '5-LOW')) GROUP BY 1, 2
UNION ALL SELECT 4, '1-URGENT', 'pending', 0 UNION ALL SELECT 4, '5-LOW', 'pending', 0 UNION ALL SELECT 4, 'new one', 'pending', 0""")
def keyword_progress_reset(spark, d):
    done = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("search_query_id"), F.col("o_orderpriority").alias("keyword")).agg(F.count("*").alias("articles_found"))
    done = done.select("search_query_id", "keyword", F.lit("completed").alias("status"), "articles_found", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return J.progress_reset(done, 4, ["1-URGENT", "5-LOW", "new one", "5-LOW"]).drop("started_at", "completed_at")


_SCHEDULES = "s AS (SELECT event_id AS id, event_type AS keyword, value > 5 AS active, ts AS next_run FROM events)"


def _schedules(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("keyword"), (F.col("value") > 5).alias("active"), F.lit(None).cast("timestamp").alias("last_run"), F.col("ts").cast("timestamp").alias("next_run"))


@query(f"WITH {_SCHEDULES} SELECT id, keyword FROM s WHERE active AND next_run <= {_NOW}")
def schedules_due(spark, d):
    return J.due(_schedules(spark, d), _now()).select("id", "keyword")


@query(f"""WITH {_SCHEDULES} SELECT id, active AND next_run <= {_NOW} AS started, strftime(CASE WHEN NOT (active AND next_run <= {_NOW}) THEN next_run WHEN next_run < {_NOW} - INTERVAL 12 HOUR THEN {_NOW} + INTERVAL 1 DAY ELSE next_run + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M:%S') AS next_run FROM s""")
def schedules_triggered(spark, d):
    jobs, after = J.triggered(_schedules(spark, d), _now(), lambda base: base + F.expr("INTERVAL 1 DAY"))
    started = jobs.select(F.col("schedule_id").alias("id"), F.lit(True).alias("started"))
    return after.join(started, "id", "left").select("id", F.coalesce("started", F.lit(False)).alias("started"), F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query(f"SELECT user_id AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS used_at FROM events WHERE ts >= {_NOW} - INTERVAL 3600 MINUTE GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 20")
def cache_live_entries(spark, d):
    entries = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("used_at"))
    return J.live_entries(entries, _now(), 216_000, 20).select("key", F.date_format("used_at", "yyyy-MM-dd HH:mm:ss").alias("used_at"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, coalesce(sum(o_orderkey % 5 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM orders) WHERE b < 10")
def early_stop(spark, d):
    rows = _t(spark, d, "orders").withColumn("size", F.col("o_orderkey") % 5 + 1)
    return J.enough(rows, "o_custkey", ["o_orderkey"], "size", 10).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id FROM events WHERE event_id % 2 = 1 UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0) AND false UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1)")
def replace_by_key(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id")
    return J.replaced(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id")


# ---- stored results --------------------------------------------------------------------------

_STORED = """r AS (SELECT doc_id AS id, doc_id % 9 AS search_id, 'https://' || source || '.org/' || CAST(doc_id AS VARCHAR) AS url, source AS domain, CASE WHEN doc_id % 4 > 0 THEN left(text, 40) END AS title, CASE WHEN doc_id % 5 > 0 THEN left(text, 90) END AS snippet,
 CASE WHEN doc_id % 6 > 0 THEN n_chars END AS occurrences, doc_id % 2 = 0 AS found_in_title, lang AS language, CASE WHEN doc_id % 3 > 0 THEN 'matched' ELSE '' END AS status, n_chars / 8.0 AS relevance_score, doc_id % 10 = 0 AS is_duplicate, text AS full_content,
 CASE doc_id % 3 WHEN 0 THEN '["a", "b c"]' WHEN 1 THEN 'plain' END AS matched_keywords, CASE WHEN doc_id % 8 = 0 THEN 'https://img/' || CAST(doc_id AS VARCHAR) END AS image_url, CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '2024-01-01' + to_seconds(CAST(doc_id AS BIGINT) * 61) END AS discovered_at FROM documents)"""


def _stored(spark, d) -> DataFrame:
    i = F.col("doc_id")
    no = lambda kind: F.lit(None).cast(kind)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + i * 61)
    return _t(spark, d, "documents").select(
        i.alias("id"), (i % 9).alias("search_id"), F.concat(F.lit("https://"), "source", F.lit(".org/"), i.cast("string")).alias("url"), F.col("source").alias("domain"), F.when(i % 4 > 0, F.left("text", F.lit(40))).alias("title"), F.when(i % 5 > 0, F.left("text", F.lit(90))).alias("snippet"),
        F.when(i % 6 > 0, F.col("n_chars")).alias("occurrences"), (i % 2 == 0).alias("found_in_title"), *[no("boolean").alias(c) for c in ("found_in_description", "found_in_body", "found_in_url")], F.col("lang").alias("language"), F.when(i % 3 > 0, "matched").otherwise("").alias("status"),
        (F.col("n_chars") / 8.0).alias("relevance_score"), (i % 10 == 0).alias("is_duplicate"), F.col("text").alias("full_content"), F.when(i % 3 == 0, '["a", "b c"]').when(i % 3 == 1, "plain").alias("matched_keywords"), F.when(i % 8 == 0, F.concat(F.lit("https://img/"), i.cast("string"))).alias("image_url"),
        F.when(i % 7 > 0, at).alias("discovered_at"), *[no("string").alias(c) for c in ("error_message", "content_hash", "description", "raw_html", "author", "image_links", "video_links")],
    )


@query(f"""WITH {_STORED} SELECT id, search_id, url, domain, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet, coalesce(occurrences, 0) AS occurrences, found_in_title, false AS found_in_description, false AS found_in_body, false AS found_in_url, language, CASE status WHEN '' THEN 'pending' ELSE status END AS status,
 CAST(NULL AS VARCHAR) AS error_message, CAST(relevance_score AS DOUBLE) AS relevance_score, is_duplicate, '' AS description, coalesce(full_content, '') AS full_content, '' AS raw_html, 'Unknown' AS author, image_url, strftime(discovered_at, '%Y-%m-%dT%H:%M:%S') AS discovered_at, coalesce(matched_keywords, '[]') AS matched_keywords FROM r""")
def result_rows(spark, d):
    return R.api_rows(_stored(spark, d))


@query(f"""WITH {_STORED} SELECT id AS "ID", search_id AS "Search ID", url AS "URL", domain AS "Domain", coalesce(title, '') AS "Title", coalesce(snippet, '') AS "Snippet", coalesce(occurrences, 0) AS "Occurrences", found_in_title AS "Found in Title", false AS "Found in Description", false AS "Found in Body", false AS "Found in URL",
 coalesce(language, '') AS "Language", CASE status WHEN '' THEN 'pending' ELSE status END AS "Status", '' AS "Error Message", CAST(relevance_score AS DOUBLE) AS "Relevance Score", is_duplicate AS "Is Duplicate", '' AS "Content Hash", '' AS "Description", coalesce(full_content, '') AS "Full Content", '' AS "Author", coalesce(image_url, '') AS "Image URL",
 '' AS "Image Links", '' AS "Video Links", coalesce(strftime(discovered_at, '%Y-%m-%dT%H:%M:%S'), '') AS "Discovered At", CASE id % 3 WHEN 0 THEN 'a, b c' WHEN 1 THEN 'plain' ELSE '' END AS "Matched Keywords" FROM r""")
def export_columns(spark, d):
    return R.export_rows(_stored(spark, d))


@query(f"""WITH {_STORED} SELECT url, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(language, 'en') AS language, CAST(CASE WHEN image_url IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_images, coalesce(image_url, '') AS src, CAST(CASE WHEN coalesce(snippet, '') = '' THEN 0 ELSE 1 END AS BIGINT) AS n_paragraphs, CAST(0 AS BIGINT) AS n_links, md5(coalesce(full_content, '')) AS markdown FROM r""")
def stored_nested_document(spark, d):
    size = lambda c: F.size(c).cast("bigint")
    data = "document.data."
    return R.nested_documents(_stored(spark, d)).select(
        "url", data + "metadata.title", data + "metadata.language", size(data + "images").alias("n_images"), F.coalesce(F.get(data + "images", F.lit(0))["src"], F.lit("")).alias("src"), size(data + "content.paragraphs").alias("n_paragraphs"), size(data + "links").alias("n_links"), F.md5(data + "markdown").alias("markdown")
    )


@query(f"""WITH {_STORED} SELECT url, CASE id % 3 WHEN 0 THEN 'a, b c' ELSE 'sea' END AS keyword, coalesce(nullif(title, ''), 'Untitled') AS title, domain AS source, 'Unknown' AS author, strftime(coalesce(discovered_at, {_NOW}), '%Y-%m-%d %H:%M:%S') AS published_date,
 left(coalesce(snippet, ''), 5000) AS summary, 'e60f4ab1' AS crawl, CASE status WHEN '' THEN 'matched' ELSE status END AS status, length(coalesce(full_content, '')) AS n_content FROM r""")
def sink_mapping(spark, d):
    rows = R.sink_rows(_stored(spark, d), "sea", T.uuid5_dns(F.lit("search_query_7")), _now())
    return rows.select("url", "keyword", "title", "source", "author", F.date_format("published_date", "yyyy-MM-dd HH:mm:ss").alias("published_date"), "summary", F.left("crawl_id", F.lit(8)).alias("crawl"), "status", F.length("content").cast("bigint").alias("n_content"))


@query(f"WITH {_STORED} SELECT id, row_number() OVER (ORDER BY occurrences DESC NULLS LAST, discovered_at DESC NULLS LAST, id) AS place FROM r WHERE NOT is_duplicate AND status = 'matched' AND (contains(lower(coalesce(title, '')), 'the') OR contains(lower(url), 'the') OR contains(lower(domain), 'the')) ORDER BY place LIMIT 200")
def export_sorted(spark, d):
    return _placed(R.listed(_stored(spark, d), " The ", "matched", True), R.export_order("occurrences"), 200)


def _placed(rows, order, n):
    """The first n ids of an order with their places; what is numbered is the page, n rows."""
    first = rows.orderBy(*order).limit(n)
    return first.select("id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query(f"WITH {_STORED} SELECT id, row_number() OVER (ORDER BY relevance_score, id) AS place FROM r WHERE NOT is_duplicate AND (contains(lower(coalesce(title, '')), 'an') OR contains(lower(url), 'an')) ORDER BY place LIMIT 100")
def view_sorted(spark, d):
    return _placed(R.listed(_stored(spark, d), "AN", exclude_duplicates=True, fields=("title", "url")), R.view_order("relevance", descending=False), 100)


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders ORDER BY place LIMIT 100")
def history_sorted(spark, d):
    return _placed(R.history(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))), [F.col("created_at").desc(), F.col("id").desc()], 100)


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey DESC LIMIT 15")
def history_latest(spark, d):
    return R.history(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 15)


@query(f"WITH {_URLS} SELECT id, status, 'N/A' AS title, CASE WHEN length(url) > 63 THEN left(url, 60) || '...' ELSE url END AS url, error_message FROM u WHERE search_id = 12 AND status = 'failed' ORDER BY id LIMIT 50")
def url_terminal_listing(spark, d):
    return R.url_listing(_inspectable(spark, d), 12, "failed")


@query(f"WITH {_URLS} SELECT id, url, '' AS domain, status, CAST(value AS DOUBLE) AS relevance_score, error_message FROM u WHERE search_id = 11")
def inspector_export(spark, d):
    return R.inspected(_inspectable(spark, d), 11).select("id", "url", "domain", "status", "relevance_score", "error_message")


def _inspectable(spark, d):
    return _crawl(spark, d).withColumns({"domain": F.lit(""), "title": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string"), "relevance_score": F.col("value"), "matched_keywords": F.lit(None).cast("string"), "discovered_at": F.col("ts")})


# ---- filters and functions -------------------------------------------------------------------

_PAGE_URLS = "p AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES ('https://e.com/Research/x'), ('https://e.com/a/searching/'), ('https://e.com/results-2024'), ('https://e.com/page/3/?Q=a'), ('https://e.com/x?keys='), ('https://e.com/x?termx=1'), ('https://e.com/finder'), ('https://e.com/site-search')) AS t(url))"
_MORE_URLS = [("https://e.com/Research/x",), ("https://e.com/a/searching/",), ("https://e.com/results-2024",), ("https://e.com/page/3/?Q=a",), ("https://e.com/x?keys=",), ("https://e.com/x?termx=1",), ("https://e.com/finder",), ("https://e.com/site-search",)]


def _more_urls(spark, d):
    return _t(spark, d, "pages").select("url").unionByName(_literal(spark, _MORE_URLS, "url"))


@query(rf"""WITH {_PAGE_URLS} SELECT url, regexp_matches(lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)), '/search|/find/|/results|/site-search|/query') OR regexp_matches('?' || regexp_extract(url, '\?([^#]*)', 1), '(?i)[?&](q|s|query|search|keyword|keywords|find|keys|searchword|term)=') AS is_search FROM p""")
def url_search_listing(spark, d):
    return _more_urls(spark, d).select("url", U.is_search_listing(F.col("url")).alias("is_search"))


@query(rf"WITH {_PAGE_URLS} SELECT url FROM p WHERE starts_with(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/a')")
def url_scope_prefix(spark, d):
    return _more_urls(spark, d).where(U.in_path_scope(F.col("url"), "/a"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'keit') OR contains(lower(text), 'que a')")
def doc_any_keyword(spark, d):
    return _t(spark, d, "documents").where(K.any_keyword(F.col("text"), ["Keit", "QUE a"])).select("doc_id")


@query("SELECT event_id, strftime(make_timestamp(event_id * 86400123 * 1000), '%Y-%m-%d %H:%M:%S') AS at, md5('https://' || CAST(event_id AS VARCHAR)) AS record_id FROM events")
def record_ids(spark, d):
    i = F.col("event_id")
    return _t(spark, d, "events").select("event_id", T.time_text(T.from_epoch_ms(i * 86400123)).alias("at"), T.record_id(F.concat(F.lit("https://"), i.cast("string"))).alias("record_id"))


_FIELD = r"regexp_extract(html, '{0}', 1)"


@query(rf"""SELECT page_id, left(coalesce(nullif(replace(replace(replace(replace(trim(regexp_replace({_FIELD.format('<title>([^<]*)</title>')}, '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ''), 'Untitled'), 200) AS title, nullif({_FIELD.format('<html lang="([A-Za-z]+)')}, '') AS lang, 'Unknown' AS author FROM pages""")
def page_head_fields(spark, d):
    e = html.extracted(F.col("html"), F.col("url"))
    return _t(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.title", "e.lang", "e.author")


# ---- discovery and configuration -------------------------------------------------------------


@query("SELECT event_id AS id, 'https://s.com/x/y/' || CAST(event_id AS VARCHAR) AS url FROM events WHERE event_id BETWEEN (SELECT max(event_id) FROM events) - 189 AND (SELECT max(event_id) FROM events) AND event_id % 3 > 0 AND (event_id % 5 = 0 OR ts >= TIMESTAMP '2024-01-10')")
def discovery_id_walk(spark, d):
    events = _t(spark, d, "events")
    landed = events.where("event_id % 3 > 0").select(F.concat(F.lit("https://s.com/x/y/"), F.col("event_id").cast("string")).alias("url"), F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("timestamp")).alias("published_at"))
    newest = events.agg(F.max("event_id")).first()[0] + 10
    return D.id_walk(spark, landed, "https://s.com/x/y/{id}", newest, since=F.lit("2024-01-10").cast("timestamp")).select("id", "url")


_SERIES = "s AS (SELECT 'https://n.com/' || CAST(c_nationkey AS VARCHAR) || '/news/' || lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') AS url, c_nationkey, c_custkey % 50 AS n FROM customer)"


@query(f"WITH {_SERIES}, m AS (SELECT c_nationkey, max(n) n FROM s GROUP BY 1) SELECT 'https://n.com/' || CAST(c_nationkey AS VARCHAR) || '/news/' || lpad(CAST(n + i AS VARCHAR), 3, '0') AS url, n + i AS n FROM m, (SELECT unnest(generate_series(1, 120)) i)")
def discovery_tail_probes(spark, d):
    url = F.concat(F.lit("https://n.com/"), F.col("c_nationkey").cast("string"), F.lit("/news/"), F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "0"))
    return D.tail_probes(_t(spark, d, "customer").select(url.alias("url"))).select("url", "n")


@query(r"SELECT url, CAST((length(url) - length(replace(url, 'a', ''))) AS DOUBLE) AS relevance_score FROM (SELECT DISTINCT url FROM pages) WHERE NOT regexp_matches(url, '/[a-m][^/]*/[^/]*$') ORDER BY relevance_score DESC, url LIMIT 25")
def discovery_sitemap_strategy(spark, d):
    entries = _t(spark, d, "pages").select(F.col("url").alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    return D.sitemap_strategy(entries, F.lit(True), "a", 25, listing=[r"/[a-m][^/]*/[^/]*$"]).select("url", "relevance_score")


@query("SELECT page_id, link, CAST(min(pos) AS BIGINT) AS pos FROM (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos, CASE WHEN starts_with(unnest(hrefs), '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || unnest(hrefs) ELSE unnest(hrefs) END AS link FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) hrefs FROM pages)) WHERE regexp_matches(link, '/[A-Z]') GROUP BY 1, 2")
def discovery_topic_search(spark, d):
    from . import pages as P

    return D.topic_search(P.links(_t(spark, d, "pages")).select("page_id", "pos", "link"), F.lit(True), ["/[A-Z]"])


@query("""WITH t AS (SELECT user_id AS search, CAST(floor(event_id / 400) AS BIGINT) AS page, event_id AS pos, 'https://r.com/' || CAST(event_id % 40 AS VARCHAR) AS url FROM events), l AS (SELECT search, page, list(url ORDER BY pos) urls FROM t GROUP BY 1, 2),
 e AS (SELECT *, row_number() OVER w nth, lag(urls) OVER w prev FROM l WINDOW w AS (PARTITION BY search ORDER BY page)), k AS (SELECT *, sum(CASE WHEN urls = prev THEN 1 ELSE 0 END) OVER (PARTITION BY search ORDER BY page) ended FROM e),
 u AS (SELECT search, page, unnest(urls) url, generate_subscripts(urls, 1) i FROM k WHERE ended = 0 AND nth <= 5), f AS (SELECT search, url, min(page * 1000000 + i) o FROM u GROUP BY 1, 2)
 SELECT search, url, place FROM (SELECT search, url, row_number() OVER (PARTITION BY search ORDER BY o, url) place FROM f) WHERE place <= 200""")
def discovery_search_loop(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("search"), F.floor(F.col("event_id") / 400).alias("page"), F.col("event_id").alias("pos"), F.concat(F.lit("https://r.com/"), (F.col("event_id") % 40).cast("string")).alias("url"))
    return D.search_loop(rows)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'N' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 7 > 0")
def config_update_delete(spark, d):
    nation = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changes = nation.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("n_name"))
    return sinks.removed(sinks.updated(nation, "n_nationkey", changes), "n_nationkey", nation.where("n_nationkey % 7 = 0"))


@query(f"WITH {_STORED} SELECT md5(url) AS record_id, domain AS source_name, url, coalesce(title, '') AS title, 'sea, navy' AS keywords, 'sea, navy' AS tags, '' AS pdf_link, coalesce(image_url, '') AS image_links, domain AS organization, '2024-01-20T12:00:00' AS scraped_date FROM r")
def archive_records(spark, d):
    rows = _stored(spark, d).select("url", F.col("domain").alias("source_name"), F.coalesce("title", F.lit("")).alias("title"), "author", "language", F.col("full_content").alias("full_text"), F.array_compact(F.array("image_url", "image_url")).alias("image_urls"), F.array().cast("array<string>").alias("video_urls"))
    return R.archive_rows(rows, ["sea", "navy"], _now()).select("record_id", "source_name", "url", "title", "keywords", "tags", "pdf_link", "image_links", "organization", "scraped_date")


@query(f"WITH {_STORED} SELECT id, coalesce(title, 'T' || CAST(id AS VARCHAR)) AS title, 'someone' AS author FROM r")
def metadata_enriched(spark, d):
    rows = _stored(spark, d).select("id", "title", "author")
    second = rows.select("id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.lit("someone").alias("author"))
    return R.enriched(rows, second, "id", ["title", "author"])


@query()
def page_clean_text(spark, d):
    c = html.clean_text(F.col("html"))
    return _t(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", "c.*")
