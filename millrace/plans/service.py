"""The service's operations over a stored database: jobs, their URLs, results, configuration and schedules.

A table is a folder of versions. An operation reads the newest whole version, applies one of the
plans of ``operators`` and writes the next; what it has read stays readable until it is pruned. Writers of one table take turns:
of two that write the same version the second fails and can run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import next_run
from ..operators import jobs as J
from ..operators import scan
from ..sources import sinks, sites
from . import pages as P
from . import records as R

#: Columns of the tables, as an empty database has them.
TABLES = {
    "jobs": "id bigint, keyword string, source_type string, direct_urls string, status string, error_message string, total_urls_crawled bigint, total_urls_matched bigint, created_at timestamp, updated_at timestamp",
    "urls": "id bigint, search_id bigint, url string, domain string, title string, snippet string, occurrences bigint, found_in_title boolean, found_in_description boolean, found_in_body boolean, found_in_url boolean, language string, status string, error_message string, relevance_score double, is_duplicate boolean, content_hash string, description string, full_content string, raw_html string, author string, image_url string, image_links string, video_links string, discovered_at timestamp, matched_keywords string",
    "progress": "search_query_id bigint, keyword string, status string, articles_found bigint, started_at timestamp, completed_at timestamp",
    "sources": "line bigint, url string, label string, grp string",
    "schedules": "id bigint, keyword string, frequency string, active boolean, next_run timestamp, last_run timestamp",
}
#: Versions of a table that are kept, so that readers of earlier ones can finish.
KEPT = 3


class Service:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- tables ----

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, table: str) -> list[int]:
        fs, path = self._path(table)
        if not fs.exists(path):
            return []
        found = sorted(int(f.getPath().getName().removeprefix("v=")) for f in fs.listStatus(path) if f.getPath().getName().startswith("v="))
        return [n for n in found if fs.exists(self._path(f"{table}/v={n}/_SUCCESS")[1])]

    def table(self, name: str) -> DataFrame:
        done = self.versions(name)
        if not done:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v={done[-1]}")

    def _write(self, name: str, rows: DataFrame) -> None:
        done = self.versions(name)
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns]).write.parquet(f"{self.folder}/{name}/v={(done or [0])[-1] + 1}")
        for n in done[: 1 - KEPT]:
            fs, path = self._path(f"{name}/v={n}")
            fs.delete(path, True)

    def _next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    # ---- jobs ----

    def submit(self, requests: DataFrame, now: Column) -> DataFrame:
        """Store requests (keyword, source_type, direct_urls) as pending jobs; gives those that are rejected, with the reason."""
        checked = J.submitted(requests)
        fresh = scan.numbered(checked.where("rejected is null"), ["keyword", "source_type"], name="id", start=self._next_id("jobs"))
        jobs = self.table("jobs")
        added = fresh.withColumns({"created_at": now, "total_urls_crawled": F.lit(0).cast("bigint"), "total_urls_matched": F.lit(0).cast("bigint")})
        self._write("jobs", jobs.unionByName(added.select(*[c for c in jobs.columns if c in added.columns]), allowMissingColumns=True))
        return checked.where("rejected is not null").select("keyword", "source_type", "rejected")

    def history(self, most: int | None = None) -> DataFrame:
        return R.history(self.table("jobs"), most) if most else R.history(self.table("jobs"))

    def stop(self, ids: Sequence[int], now: Column) -> None:
        self._write("jobs", J.stopped(self.table("jobs"), ids, now))

    def recover(self, now: Column) -> None:
        """After a restart: what was in work has failed."""
        self._write("jobs", J.recovered(self.table("jobs"), now))

    def retry(self, ids: Sequence[int]) -> None:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        self._write("jobs", J.retried(self.table("jobs"), wanted, self._next_id("jobs")))

    def delete(self, ids: Sequence[int]) -> None:
        """Jobs with their URLs and progress; children first, so that a stop half way leaves none without a job."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        children = {"urls": self.table("urls"), "progress": self.table("progress").withColumnRenamed("search_query_id", "search_id")}
        jobs, rest = J.without_jobs(self.table("jobs"), children, wanted)
        self._write("urls", rest["urls"])
        self._write("progress", rest["progress"].withColumnRenamed("search_id", "search_query_id"))
        self._write("jobs", jobs)

    # ---- URLs and results ----

    def enqueue(self, candidates: DataFrame) -> DataFrame:
        """Store what jobs have not met of candidates (search_id, url) as pending; gives all that are to be worked on, failed and pending ones of before included."""
        urls = self.table("urls")
        queue = sites.frontier(J.of_running_jobs(candidates, self.table("jobs")), urls)
        fresh = scan.numbered(queue.where("queued = 'new'"), ["search_id", "url"], name="id", start=self._next_id("urls"))
        self._write("urls", urls.unionByName(fresh.select("id", "search_id", "url", "domain", "status"), allowMissingColumns=True))
        return queue

    def report(self, results: DataFrame) -> None:
        """Results (id and what of the columns of urls they have) replace those columns; the jobs' totals are counted anew."""
        own = [c for c in results.columns if c != "id"]
        urls, new = self.table("urls"), results.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in own])
        joined = urls.join(new, "id", "left")
        self._write("urls", joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in urls.columns]))
        done = self.table("urls").groupBy(F.col("search_id").alias("id")).agg(F.count_if(F.col("status") != "pending").alias("_c"), F.count_if(F.col("status") == "matched").alias("_m"))
        jobs = self.table("jobs").join(done, "id", "left")
        self._write("jobs", jobs.withColumns({"total_urls_crawled": F.coalesce("_c", F.lit(0)), "total_urls_matched": F.coalesce("_m", F.lit(0))}).drop("_c", "_m"))

    def status(self, search_id: int) -> DataFrame:
        """A job's URLs by status."""
        return self.table("urls").where(F.col("search_id") == search_id).groupBy("status").agg(F.count("*").alias("n"))

    def results(self, search_id: int, page: int = 1, limit: int = 100, q: str = "", status: str = "", exclude_duplicates: bool = False) -> DataFrame:
        """One page of a job's results as the API gives them, best first, with the number of all."""
        rows = R.listed(self.table("urls").where(F.col("search_id") == search_id), q, status, exclude_duplicates)
        shown = P.results_page(rows, [*R.view_order("relevance"), F.col("id").asc()], page, limit)
        total = shown.select("id", "total")
        return R.api_rows(shown.drop("total")).join(total, "id")

    def export(self, search_id: int, path: str, kind: str, q: str = "", status: str = "", exclude_duplicates: bool = False, by: str = "relevance_score", descending: bool = True) -> None:
        rows = R.listed(self.table("urls").where(F.col("search_id") == search_id), q, status, exclude_duplicates)
        sinks.export(R.export_rows(rows.orderBy(*R.export_order(by, descending))), path, kind)

    def reset(self, search_id: int, status: str) -> None:
        self._write("urls", J.reset_urls(self.table("urls"), search_id, status))

    # ---- configuration and schedules ----

    def add_sources(self, rows: DataFrame) -> DataFrame:
        """Add config rows (line, url, label, grp) that are whole, well formed and new; gives how many and the first errors."""
        stored = self.table("sources")
        checked = sinks.validated(rows, stored, "url", ["url", "label"], "^https?://")
        summary = sinks.summary(checked).collect()
        self._write("sources", stored.unionByName(checked.where("reason is null").select(*stored.columns)))
        return self.spark.createDataFrame(summary, "added bigint, skipped bigint, errors array<string>")

    def schedule(self, rows: DataFrame, now: Column) -> None:
        """Store schedules (keyword, frequency), their first run one period from now."""
        none = F.lit(None).cast("int")
        fresh = scan.numbered(rows, ["keyword", "frequency"], name="id", start=self._next_id("schedules"))
        added = fresh.select("id", "keyword", "frequency", F.lit(True).alias("active"), next_run(F.col("frequency"), now, none, none, none, none).alias("next_run"))
        self._write("schedules", self.table("schedules").unionByName(added, allowMissingColumns=True))

    def trigger(self, now: Column) -> int:
        """Start the jobs of due schedules and advance these; how many were started."""
        none = F.lit(None).cast("int")
        started, after = J.triggered(self.table("schedules"), now, lambda at: next_run(F.col("frequency"), at, none, none, none, none))
        n = started.count()
        if n:
            self.submit(started.select("keyword", F.lit("search").alias("source_type"), F.lit(None).cast("string").alias("direct_urls")), now)
            self._write("schedules", after)
        return n
