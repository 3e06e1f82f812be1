"""The service's operations one after the other, as its clients call them."""

import csv
from datetime import datetime

from millrace.plans.service import KEPT, Service
from pyspark.sql import functions as F


def at(text):
    return F.lit(text).cast("timestamp")


def test_a_job_from_request_to_export(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/db")
    requests = spark.createDataFrame([(" sea ", "search", None), ("", "search", None), ("x", "direct", " "), ("navy", "direct", "https://a.org")], "keyword string, source_type string, direct_urls string")
    rejected = service.submit(requests, at("2026-01-01 10:00:00")).collect()
    assert len(rejected) == 2 and all(r.rejected for r in rejected)
    jobs = {r.keyword: r for r in service.table("jobs").collect()}
    assert {(k, r.id, r.status) for k, r in jobs.items()} == {("navy", 1, "pending"), ("sea", 2, "pending")}
    candidates = spark.createDataFrame([(2, f"https://www.e{k % 3}.org/{k}") for k in range(12)] + [(1, "https://x.org/1")], "search_id bigint, url string")
    assert service.enqueue(candidates).where("queued = 'new'").count() == 13
    assert service.table("urls").count() == 13 and service.enqueue(candidates).count() == 13 and service.table("urls").count() == 13
    ids = {r.url: r.id for r in service.table("urls").where("search_id = 2").collect()}
    results = [(i, ("matched", "failed", "skipped")[k % 3], float(k % 5), f"Title {k}", k % 4 == 0) for k, i in enumerate(sorted(ids.values()))]
    service.report(spark.createDataFrame(results, "id bigint, status string, relevance_score double, title string, is_duplicate boolean"))
    job = service.table("jobs").where("id = 2").first()
    assert (job.total_urls_crawled, job.total_urls_matched) == (12, 4)
    assert {r.status: r.n for r in service.status(2).collect()} == {"matched": 4, "failed": 4, "skipped": 4}
    page = service.results(2, page=1, limit=3, status="matched", exclude_duplicates=True).collect()
    wanted = sorted((r for r in results if r[1] == "matched" and not r[4]), key=lambda r: (-r[2], r[0]))
    assert {r.id for r in page} == {r[0] for r in wanted[:3]} and page[0].total == len(wanted)
    service.export(2, str(tmp_path / "out.csv"), "csv", status="matched")
    with open(tmp_path / "out.csv", encoding="utf-8-sig", newline="") as f:
        assert sorted(int(r["ID"]) for r in csv.DictReader(f)) == sorted(r[0] for r in results if r[1] == "matched")
    service.reset(2, "failed")
    assert service.enqueue(candidates).where("search_id = 2").count() == 4
    service.stop([2], at("2026-01-02 00:00:00"))
    assert service.enqueue(candidates).select("search_id").distinct().collect() == [(1,)]  # an aborted job takes no more
    service.retry([2])
    assert sorted((r.id, r.keyword, r.status) for r in service.history().collect()) == [(1, "navy", "pending"), (2, "sea", "aborted"), (3, "sea", "pending")]
    service.delete([2])
    assert service.table("urls").where("search_id = 2").count() == 0 and service.table("jobs").count() == 2 and service.table("urls").count() == 1
    assert len(service.versions("urls")) <= KEPT


def test_configuration_and_schedules(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([(1, "https://a.org", "A", "g"), (2, "no", "B", "g"), (3, "https://a.org", "C", "g"), (4, "https://b.org", "", "g")], "line bigint, url string, label string, grp string")
    first = service.add_sources(rows).first()
    assert (first.added, first.skipped, first.errors) == (1, 3, ["line 2: invalid format", "line 3: duplicate in batch", "line 4: missing field"])
    assert tuple(service.add_sources(rows.where("line = 1")).first()) == (0, 1, ["line 1: duplicate"]) and service.table("sources").count() == 1
    service.schedule(spark.createDataFrame([("sea", "daily"), ("navy", "weekly")], "keyword string, frequency string"), at("2026-01-01 08:00:00"))
    assert service.trigger(at("2026-01-01 09:00:00")) == 0
    assert service.trigger(at("2026-01-02 08:30:00")) == 1 and [r.keyword for r in service.table("jobs").collect()] == ["sea"]
    planned = {r.keyword: r.next_run for r in service.table("schedules").collect()}
    assert planned == {"sea": datetime(2026, 1, 3, 8), "navy": datetime(2026, 1, 8, 8)}
    service.recover(at("2026-01-02 09:00:00"))
    assert service.table("jobs").first().status == "pending"
