"""Stored results as API rows, exports, nested documents, archive and sink records, and their listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators.classify import content_type, country_region, language_name, sentiment, source_type, subject_theme

# fixed values: the names of export columns by column, what an empty one holds, and groups that lists begin with
EXPORT_NAMES = {
    "id": "ID", "search_id": "Search ID", "url": "URL", "domain": "Domain", "title": "Title", "snippet": "Snippet", "occurrences": "Occurrences", "found_in_title": "Found in Title", "found_in_description": "Found in Description",
    "found_in_body": "Found in Body", "found_in_url": "Found in URL", "language": "Language", "status": "Status", "error_message": "Error Message", "relevance_score": "Relevance Score", "is_duplicate": "Is Duplicate",
    "content_hash": "Content Hash", "description": "Description", "full_content": "Full Content", "author": "Author", "image_url": "Image URL", "image_links": "Image Links", "video_links": "Video Links", "discovered_at": "Discovered At",
    "matched_keywords": "Matched Keywords",
}
API_FIELDS = ("id", "search_id", "url", "domain", "title", "snippet", "occurrences", "found_in_title", "found_in_description", "found_in_body", "found_in_url", "language", "status", "error_message", "relevance_score", "is_duplicate", "description", "full_content", "raw_html", "author", "image_url", "discovered_at", "matched_keywords")
INSPECTED = ("id", "url", "domain", "status", "title", "snippet", "relevance_score", "matched_keywords", "error_message", "discovered_at")
FIXED_GROUPS = ("china", "myanmar", "northeast_india")
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


def _text(name: str, value: str = "") -> Column:
    """The column, or a value where it is null or empty."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))


def keyword_names(stored: Column) -> Column:
    """A stored JSON list as names with commas between; other text as it is."""
    return F.coalesce(F.array_join(F.from_json(stored, "array<string>"), ", "), stored, F.lit(""))


def api_rows(rows: DataFrame) -> DataFrame:
    """The 23 fields of a stored result that the API returns, none of them missing."""
    flags = {c: _or(c, False) for c in ("found_in_title", "found_in_description", "found_in_body", "found_in_url", "is_duplicate")}
    texts = {c: _or(c, "") for c in ("title", "snippet", "description", "full_content", "raw_html")}
    other = {"occurrences": _or("occurrences", 0), "status": _text("status", "pending"), "relevance_score": _or("relevance_score", 0.0).cast("double"), "author": _text("author", "Unknown"), "discovered_at": F.date_format("discovered_at", _ISO), "matched_keywords": _text("matched_keywords", "[]")}
    return rows.withColumns(flags | texts | other).select(*API_FIELDS)


def export_rows(rows: DataFrame) -> DataFrame:
    """The 25 export columns, named for readers."""
    flags = {c: _or(c, False) for c in ("found_in_title", "found_in_description", "found_in_body", "found_in_url", "is_duplicate")}
    texts = {c: _or(c, "") for c in ("title", "snippet", "language", "error_message", "content_hash", "description", "full_content", "author", "image_url", "image_links", "video_links")}
    other = {"occurrences": _or("occurrences", 0), "status": _text("status", "pending"), "relevance_score": _or("relevance_score", 0.0).cast("double"), "discovered_at": F.coalesce(F.date_format("discovered_at", _ISO), F.lit("")), "matched_keywords": keyword_names(F.col("matched_keywords"))}
    ready = rows.withColumns(flags | texts | other)
    return ready.select(*[F.col(c).alias(n) for c, n in EXPORT_NAMES.items()])


def nested_documents(rows: DataFrame) -> DataFrame:
    """url and document of stored results, in the structure of scraped ones; what is not stored is empty."""
    none = lambda kind: F.array().cast(kind)
    meta = F.struct(_text("title", "Untitled").alias("title"), _or("description", "").alias("description"), _text("language", "en").alias("language"), F.col("url").alias("sourceURL"), F.lit(200).alias("statusCode"))
    image = F.struct(F.col("image_url").alias("src"), F.lit("lead image").alias("alt"), F.lit("").alias("caption"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    given = lambda name, value: F.when(_text(name) == "", F.array_except(F.array(value), F.array(value))).otherwise(F.array(value))
    content = F.struct(none("array<string>").alias("headings"), given("snippet", F.col("snippet")).alias("paragraphs"), none("array<array<string>>").alias("lists"), none("array<array<array<string>>>").alias("tables"), none("array<string>").alias("codeBlocks"), none("array<string>").alias("quotes"))
    data = F.struct(_or("full_content", "").alias("markdown"), _or("raw_html", "").alias("html"), meta.alias("metadata"), none("array<string>").alias("links"), given("image_url", image).alias("images"), none("array<string>").alias("videos"), content.alias("content"))
    return rows.select("url", F.struct(F.lit(True).alias("success"), data.alias("data")).alias("document"))


def sink_rows(rows: DataFrame, keyword: str, crawl_id: Column, now: Column) -> DataFrame:
    """Stored results as rows of the news table: classified, with defaults, and cut to its columns' widths."""
    names = F.coalesce(F.array_join(F.from_json("matched_keywords", "array<string>"), ", "), F.lit(""))
    return rows.where(_text("url") != "").select(
        F.coalesce(F.nullif(names, F.lit("")), F.lit(keyword or "Unknown")).alias("keyword"), _text("title", "Untitled").alias("title"), "url", _text("domain", "Unknown").alias("source"), _text("author", "Unknown").alias("author"),
        F.coalesce("discovered_at", now).alias("published_date"), now.alias("scraped_date"), F.left(language_name(F.col("language")), F.lit(20)).alias("language"), F.left(country_region(F.col("title"), F.col("full_content")), F.lit(50)).alias("country"),
        F.left(F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("snippet"), F.lit("")), F.lit(5000)).alias("summary"), _or("full_content", "").alias("content"), sentiment(F.col("title"), F.col("full_content")).alias("sentiment"),
        F.left(subject_theme(F.col("title"), F.col("full_content")), F.lit(100)).alias("category"), "image_url", crawl_id.alias("crawl_id"), _text("status", "matched").alias("status"), now.alias("created_at"), now.alias("updated_at"),
    )


def archive_rows(rows: DataFrame, keywords: Sequence[str], now: Column) -> DataFrame:
    """The 19 fields of an archived page, from url, source_name, title, author, language, full_text, image_urls and video_urls."""
    names = F.lit(", ".join(keywords))
    text = F.col("full_text")
    return rows.select(
        F.md5("url").alias("record_id"), "source_name", source_type(F.col("url")).alias("source_type"), "title", "url", F.date_format(now, _ISO).alias("publication_date"), "author", content_type(F.col("url"), F.col("title")).alias("content_type"),
        subject_theme(F.col("title"), text).alias("subject_theme"), country_region(F.col("title"), text).alias("country_region"), language_name(F.col("language")).alias("language"), names.alias("keywords"), "full_text", names.alias("tags"),
        F.when(F.lower("url").endswith(".pdf"), F.col("url")).otherwise("").alias("pdf_link"), F.array_join(F.array_distinct("image_urls"), ", ").alias("image_links"), F.array_join(F.array_distinct("video_urls"), ", ").alias("video_links"), F.col("source_name").alias("organization"), F.date_format(now, _ISO).alias("scraped_date"),
    )


def enriched(rows: DataFrame, second: DataFrame, key: str, fields: Sequence[str] = ("author", "title", "description", "published")) -> DataFrame:
    """rows with fields that are missing filled from a second extractor's."""
    other = second.select(key, *[F.col(f).alias(f"_second_{f}") for f in fields])
    joined = rows.join(other, key, "left")
    return joined.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_second_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


def listed(rows: DataFrame, q: str = "", status: str = "", exclude_duplicates: bool = False, fields: Sequence[str] = ("title", "url", "domain")) -> DataFrame:
    """Rows with q in one of the fields, in any case, with the status, and without duplicates where asked."""
    if q.strip():
        held = F.lit(False)
        for f in fields:
            held = held | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(q.strip().lower()))
        rows = rows.where(held)
    if status.strip():
        rows = rows.where(F.col("status") == status.strip())
    return rows.where(~_or("is_duplicate", False)) if exclude_duplicates else rows


def export_order(by: str = "relevance_score", descending: bool = True) -> list[Column]:
    """Order of exports: occurrences or relevance, then the latest first."""
    c = F.col("occurrences" if by == "occurrences" else "relevance_score")
    return [c.desc() if descending else c.asc(), F.col("discovered_at").desc(), F.col("id")]


def view_order(by: str = "relevance", descending: bool = True) -> list[Column]:
    """Order of the result view: relevance, occurrences or none, then by id."""
    names = {"relevance": "relevance_score", "occurrences": "occurrences"}
    if by not in names:
        return [F.col("id")]
    c = F.coalesce(F.col(names[by]), F.lit(0))
    return [c.desc() if descending else c.asc(), F.col("id")]


def history(jobs: DataFrame, latest: int | None = None) -> DataFrame:
    """Jobs, the latest first; or the last few by id."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()) if latest is None else jobs.orderBy(F.col("id").desc()).limit(latest)


def group_order(key: Column, label: Column) -> list[Column]:
    """Order of groups: the fixed ones first, as listed, then others by label."""
    fixed = F.array_position(F.array(*map(F.lit, FIXED_GROUPS)), key)
    return [F.when(fixed > 0, fixed).otherwise(len(FIXED_GROUPS) + 1), F.when(fixed > 0, "").otherwise(F.lower(label)), label]


def url_listing(urls: DataFrame, search_id: int, status: str = "", limit: int = 50) -> DataFrame:
    """A job's URLs for a terminal: the first by id, with long titles, URLs and errors cut."""
    rows = inspected(urls, search_id, status).orderBy("id").limit(limit)
    return rows.select("id", "status", truncated(F.coalesce(F.nullif("title", F.lit("")), F.lit("N/A")), 23, 20).alias("title"), truncated(F.col("url"), 63, 60).alias("url"), truncated(F.col("error_message"), 23, 20).alias("error_message"))


def inspected(urls: DataFrame, search_id: int, status: str = "") -> DataFrame:
    """The ten columns of a job's URLs that the inspector exports."""
    rows = urls.where(F.col("search_id") == search_id)
    return (rows.where(F.col("status") == status) if status else rows).select(*INSPECTED)

