"""Jobs, their URLs and schedules: state changes as rewrites of whole tables.

A table goes in and the table after the change comes out, so that every step is a plan that can be
run again; the caller writes it. Jobs have id, status, error_message and updated_at; URLs have id,
search_id, url, status and error_message. ``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import in_domains
from .scan import numbered, running

# fixed values: states that a job does not leave, texts of errors, answers that no second try mends, and default regional sources
FINAL = ("completed", "failed", "aborted")
RESTARTED, INTERRUPTED, CRASHED, TIMED_OUT, ROUTING = "Recovered after server restart.", "Crawl interrupted or skipped.", "Queue worker crash: ", "Task exceeded maximum duration of 45 seconds.", "VPN routing failure: "
KEYWORD_NEEDED, URLS_NEEDED = "keyword is required when source_type is 'search'", "direct_urls field is required when source_type is 'direct'"
NOT_RETRIED = (404, 410, 401, 403)
REGIONAL_DOMAINS, REGIONAL_ENDINGS = ("chinadaily.com.cn", "cgtn.com", "globaltimes.cn", "fmprc.gov.cn", "stats.gov.cn"), (".cn",)
LONGEST_TASK, TRIES, LATE_HOURS = 45, 2, 12


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _changed(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with some columns replaced where a condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()})


def submitted(requests: DataFrame) -> DataFrame:
    """Requests (keyword, source_type, direct_urls and what else they have) as pending jobs; ``rejected`` says why one is none."""
    reason = F.when((F.col("source_type") == "search") & _blank(F.col("keyword")), KEYWORD_NEEDED).when((F.col("source_type") == "direct") & _blank(F.col("direct_urls")), URLS_NEEDED)
    return requests.withColumns({"keyword": F.trim(F.coalesce("keyword", F.lit(""))), "rejected": reason, "status": F.when(reason.isNull(), "pending")})


def retried(jobs: DataFrame, ids: DataFrame, next_id: int) -> DataFrame:
    """jobs and a pending copy of each of ids, numbered on from next_id in the order of the old ids. Every setting is copied."""
    copies = jobs.join(ids.select("id").distinct(), "id", "left_semi")
    copies = numbered(copies, ["id"], name="_number", start=next_id)
    fresh = {"id": F.col("_number").cast("bigint"), "status": F.lit("pending"), "error_message": F.lit(None).cast("string"), "updated_at": F.lit(None).cast(jobs.schema["updated_at"].dataType)}
    return jobs.unionByName(copies.withColumns(fresh).drop("_number"))


def without_jobs(jobs: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """jobs without ids, and each child table (search_id) without their rows."""
    gone = ids.select("id").distinct()
    return jobs.join(gone, "id", "left_anti"), {n: c.join(gone.withColumnRenamed("id", "search_id"), "search_id", "left_anti") for n, c in children.items()}


def stopped(jobs: DataFrame, ids: Sequence[int], now: Column) -> DataFrame:
    """jobs with those of ids aborted that are not over."""
    return _changed(jobs, F.col("id").isin(list(ids)) & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False)), status=F.lit("aborted"), updated_at=now)


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs with those failed that were in work when the service went down."""
    return _changed(jobs, F.col("status") == "processing", status=F.lit("failed"), error_message=F.lit(RESTARTED), updated_at=now)


def of_running_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows (search_id) whose job is not aborted: what each stage reads before it works on."""
    return rows.join(jobs.where("status = 'aborted'").select(F.col("id").alias("search_id")), "search_id", "left_anti")


def reset_urls(urls: DataFrame, search_id: int, status: str, target: str = "pending") -> DataFrame:
    """urls with those of a job and a status put back, their errors cleared."""
    return _changed(urls, (F.col("search_id") == search_id) & (F.col("status") == status), status=F.lit(target), error_message=F.lit(None).cast("string"))


def swept(urls: DataFrame, search_ids: Sequence[int], crash: str | None = None) -> DataFrame:
    """urls with the pending ones of jobs closed: skipped at a job's end, failed after a crash."""
    pending = F.col("search_id").isin(list(search_ids)) & (F.col("status") == "pending")
    return _changed(urls, pending, status=F.lit("skipped" if crash is None else "failed"), error_message=F.lit(INTERRUPTED if crash is None else CRASHED + crash))


def timed_out(urls: DataFrame, now: Column) -> DataFrame:
    """urls with those failed that are pending and were started (started_at) over 45 seconds ago."""
    late = F.unix_micros(now) - F.unix_micros("started_at") > LONGEST_TASK * 1_000_000
    return _changed(urls, (F.col("status") == "pending") & late, status=F.lit("failed"), error_message=F.lit(TIMED_OUT))


def is_regional(url: Column, domains: Sequence[str] = REGIONAL_DOMAINS, endings: Sequence[str] = REGIONAL_ENDINGS, more: Sequence[str] = ()) -> Column:
    """Whether a URL's authority, without www., is one of the regional sources, lies under one, or ends like one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")
    out = in_domains(host, [*domains, *more])
    for e in endings:
        out = out | host.endswith(e) | (host == e.lstrip("."))
    return F.coalesce(url.startswith("http") & out, F.lit(False))


def routing_failed(urls: DataFrame, search_id: int, error: str) -> DataFrame:
    """urls with the pending regional ones of a job failed, since their route is down."""
    return _changed(urls, (F.col("search_id") == search_id) & (F.col("status") == "pending") & is_regional(F.col("url")), status=F.lit("failed"), error_message=F.lit(ROUTING + error))


def phases(urls: DataFrame) -> DataFrame:
    """Adds phase: regional URLs are fetched in phase 1, by their own route, others in phase 2."""
    return urls.withColumn("phase", F.when(is_regional(F.col("url")), 1).otherwise(2).cast("bigint"))


def counted(jobs: DataFrame, increments: DataFrame) -> DataFrame:
    """jobs with their totals raised by what pages have reported (search_id, crawled, matched), in any order and number."""
    sums = increments.groupBy(F.col("search_id").alias("id")).agg(F.sum("crawled").alias("_c"), F.sum("matched").alias("_m"))
    raised = {n: (F.coalesce(n, F.lit(0)) + F.coalesce(x, F.lit(0))).cast("bigint") for n, x in (("total_urls_crawled", "_c"), ("total_urls_matched", "_m"))}
    return jobs.join(sums, "id", "left").withColumns(raised).drop("_c", "_m")


def progress_reset(progress: DataFrame, search_id: int, keywords: Sequence[str]) -> DataFrame:
    """progress (search_query_id, keyword, status, articles_found, started_at, completed_at) with a fresh row for each keyword of a job."""
    wanted = progress.sparkSession.createDataFrame([(search_id, k) for k in dict.fromkeys(keywords)], "search_query_id bigint, keyword string")
    fresh = wanted.select("search_query_id", "keyword", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("articles_found"), *[F.lit(None).cast(progress.schema[c].dataType).alias(c) for c in ("started_at", "completed_at")])
    return progress.join(F.broadcast(wanted), ["search_query_id", "keyword"], "left_anti").select(progress.columns).unionByName(fresh)


def outcomes(attempts: DataFrame) -> DataFrame:
    """id, tries, status and waited of each URL from its attempts (id, attempt from 1, ok, code): a second
    try follows an answer that may be mended, after a second, and twice that for each further one."""
    ends = F.col("ok") | F.col("code").isin(*NOT_RETRIED) | (F.col("attempt") >= TRIES)
    last = F.min(F.when(F.coalesce(ends, F.lit(False)), F.struct("attempt", "ok")))
    found = attempts.groupBy("id").agg(last.alias("last"), F.max("attempt").alias("seen"))
    tries = F.coalesce("last.attempt", "seen")
    status = F.when(F.col("last").isNull(), "pending").when(F.col("last.ok"), "fetched").otherwise("failed")
    return found.select("id", tries.cast("bigint").alias("tries"), status.alias("status"), (F.pow(F.lit(2.0), tries - 1) - 1).alias("waited"))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules that are active and whose time has come."""
    return schedules.where(F.col("active") & (F.col("next_run") <= now))


def triggered(schedules: DataFrame, now: Column, advance) -> tuple[DataFrame, DataFrame]:
    """The pending jobs that due schedules start, and all schedules after that.

    advance gives the next run of a row from a reference time: the planned one, so that runs do not
    drift, or now where the planned one is over twelve hours past.
    """
    is_due = F.col("active") & (F.col("next_run") <= now)
    reference = F.when(F.col("next_run") < now - F.expr(f"INTERVAL {LATE_HOURS} HOURS"), now).otherwise(F.col("next_run"))
    jobs = schedules.where(is_due).select(F.col("id").alias("schedule_id"), "keyword", F.lit("pending").alias("status"))
    return jobs, _changed(schedules, is_due, last_run=now, next_run=advance(reference))


def live_entries(entries: DataFrame, now: Column, seconds: float, most: int | None = None) -> DataFrame:
    """Cache entries (key, used_at) that are not older than a time to live; of those the most recently used ``most``."""
    fresh = entries.where((F.unix_micros(now) - F.unix_micros("used_at")) <= seconds * 1_000_000)
    latest = fresh.groupBy("key").agg(F.max("used_at").alias("used_at"))
    return latest.orderBy(F.col("used_at").desc(), "key").limit(most) if most is not None else latest


def enough(rows: DataFrame, group: str, order: Sequence[str], size: str, wanted: int) -> DataFrame:
    """Rows of each group up to the one with which the sum of ``size`` reaches ``wanted``: what an early stop would have read. A group of any size lies over several tasks."""
    return running(rows, F.col(size), order, [group], "_before").where(F.col("_before") < wanted).drop("_before")


def replaced(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of every key that new has replaced by new's."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))
