"""Landed pages to analysed results: the flagship plan and what is built on its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.keywords import analysis
from ..session import written

EXPORT = {"doc_id": "ID", "url": "URL", "domain": "Domain", "title": "Title", "occurrences": "Occurrences", "relevance_score": "Relevance Score", "status": "Status"}


def regex_fields(pages: DataFrame) -> DataFrame:
    """page_id, url, title, lang, description and body of pages by patterns that Catalyst runs without Python.

    For pages of one template; sources.html.extracted reads any page.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), r"<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return pages.select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([A-Za-z]+)', 1).alias("lang"), F.lit("").alias("description"), F.trim(text).alias("body"))


def ranked(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Analysed pages that match, best first. They are written before they are sorted: a sort's range exchange reads its input twice."""
    found = analysis(regex_fields(pages), terms).where("matched")
    rows = found.select("page_id", "url", urls.domain(F.col("url")).alias("domain"), "title", "lang", "occurrences", F.array_join("matched_keywords", ", ").alias("keywords"), "relevance_score")
    return written(rows, "ranked").orderBy(F.col("relevance_score").desc(), "page_id")


def links(pages: DataFrame) -> DataFrame:
    """page_id, position and absolute URL of the links of pages, by pattern."""
    out = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("pos", "href"))
    return out.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "href", F.coalesce(urls.absolutize(F.col("href"), urls.origin(F.col("url"))), F.col("href")).alias("link"))


def status_of(value: Column, matched: str = "purchase", failed: str = "error", pending: str = "signup") -> Column:
    return F.when(value == matched, "matched").when(value == failed, "failed").when(value == pending, "pending").otherwise("skipped")


def results_page(rows: DataFrame, order: list[Column], page: int = 1, limit: int = 100, where: Column | None = None) -> DataFrame:
    """One page of results with the number of all of them: TakeOrdered for the page, a partial count for the total."""
    found = rows.where(where) if where is not None else rows
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))
