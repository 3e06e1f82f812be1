"""URL algebra as Column functions. Nothing here parses with parse_url, which rejects non-ASCII paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names and endings by which URLs are told apart
SEARCH_PARAMETERS = ("q", "query", "search", "s", "keyword", "keywords", "k", "keys", "searchword", "search_api_views_fulltext", "text", "term", "find", "sr", "search_query", "search_keyword", "buscar", "suche")
SEARCH_SEGMENTS = ("search", "find", "results", "searchresults", "search-results", "site-search", "query")
PAGED_SEARCH_PARAMETERS = ("q", "s", "query", "search", "keyword", "keywords", "find", "keys", "searchword", "term")
NO_RESULTS = r"(?i)no[_-]?results|0[_-]?results|not[_-]?found|noresult"
STATIC_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".css", ".js", ".xml")
SKIPPED_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".zip", ".tar", ".gz", ".css", ".js", ".xml", ".json", ".mp4", ".mp3", ".wav", ".avi", ".mov", ".ico", ".woff", ".woff2", ".ttf", ".eot")
EXCLUDED_DOMAINS = ("google.com", "google.co.in", "google.co.uk", "google.ad", "google.ae", "youtube.com", "youtu.be", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "pinterest.com", "duckduckgo.com", "bing.com", "yahoo.com", "search.yahoo.com", "microsoft.com", "wikipedia.org", "w3.org", "schema.org")
INDEX_FILES = ("index.html", "index.shtml", "index.htm", "default.html", "default.shtml")
PAGE_PARAMETERS = ("page", "p", "pg", "paged", "start", "offset", "from")
SEARCH_ENDPOINTS = ("/search", "/find/", "/results", "/site-search", "/query")
LISTING_PARAMETERS = ("q", "s", "query", "search", "keyword", "keywords", "find", "keys", "searchword", "term")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com")
VIDEO_ENDINGS = (".mp4", ".webm", ".mov", ".m3u8")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Authority in lower case without a leading ``www.``; keeps port and user."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def segments(url: Column) -> Column:
    """Path segments, none for an empty path."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def file_ending(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"(\.[A-Za-z0-9]+)$", 1))


def page_number(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)[?&](?:" + "|".join(PAGE_PARAMETERS) + r")=(\d+)", 1).try_cast("bigint")


def force_https(url: Column, flag: Column) -> Column:
    return F.when(flag, F.regexp_replace(url, "^http://", "https://")).otherwise(url)


def absolutize(link: Column, base: Column) -> Column:
    """Protocol-relative and root-relative links made absolute; other relative links are null."""
    return F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(base, link)).when(link.rlike("^https?://"), link)


def trailing_number(url: Column) -> tuple[Column, Column, Column]:
    """What stands before the last number of a URL, the number, and what follows it."""
    pattern = r"^(.*?)(\d+)(/?(?:\?.*)?)$"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 3)


def _names(params: Column) -> Column:
    return F.transform(F.split(params, "&"), lambda p: F.lower(F.coalesce(F.try_url_decode(F.split(p, "=")[0]), F.lit(""))))


def has_search_parameter(url: Column) -> Column:
    q = query(url)
    return (q != "") & F.arrays_overlap(_names(q), F.array(*map(F.lit, SEARCH_PARAMETERS)))


def is_search_page(url: Column) -> Column:
    """A listing of search results: by path, by parameter name, paged with a search parameter, or empty-handed."""
    by_path = path(url).rlike(r"(?i)/(?:" + "|".join(SEARCH_SEGMENTS) + r")(?:/|$)")
    paged = path(url).rlike(r"(?i)/page/\d+") & F.concat(F.lit("?"), query(url)).rlike(r"(?i)[?&](?:" + "|".join(PAGED_SEARCH_PARAMETERS) + ")=")
    return F.coalesce(url.startswith("http") & (by_path | has_search_parameter(url) | paged | url.rlike(NO_RESULTS)), F.lit(False))


def is_search_listing(url: Column) -> Column:
    """The detector's own test: an endpoint's name anywhere in the path, or a search parameter."""
    by_path = F.lower(path(url)).rlike("|".join(SEARCH_ENDPOINTS))
    return F.coalesce(by_path | F.concat(F.lit("?"), query(url)).rlike(r"(?i)[?&](?:" + "|".join(LISTING_PARAMETERS) + ")="), F.lit(False))


def in_path_scope(url: Column, prefix: str) -> Column:
    """Whether a URL's path begins with a prefix; an empty one holds all."""
    return path(url).startswith(prefix)


def _ends_with_any(value: Column, endings: Sequence[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | value.endswith(e)
    return out


def in_domains(host: Column, domains: Sequence[str]) -> Column:
    """Host equals one of the domains or lies under it."""
    out = host.isin(list(domains))
    for d in domains:
        out = out | host.endswith("." + d)
    return out


def is_valid_result(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://") & ~_ends_with_any(F.lower(path(url)), STATIC_ENDINGS) & ~in_domains(domain(url), EXCLUDED_DOMAINS), F.lit(False))


def is_skippable(url: Column) -> Column:
    """Fragment only, a static file, no path, or a numbered page."""
    return url.startswith("#") | _ends_with_any(F.lower(path(url)), SKIPPED_ENDINGS) | (F.size(segments(url)) == 0) | url.rlike(r"(?i)[?&](?:" + "|".join(PAGE_PARAMETERS) + r")=\d+")


def is_article(url: Column) -> Column:
    """Whether a URL looks like an article rather than a front page or an index."""
    p = F.lower(path(url))
    clean = F.regexp_replace(p, "^/+|/+$", "")
    n = F.size(F.split(clean, "/"))
    digits = F.element_at(F.split(clean, "/"), -1).rlike("[0-9]")
    dated = p.rlike(r"/\d{4}[-/]?\d{2}[-/]?\d{2}/|/\d{6}/|/page/\d{6}/|/a/\d{6}/")
    return (
        F.when((clean == "") | clean.isin(list(INDEX_FILES)), False)
        .when(dated | p.rlike(r"t\d{8}_"), True)
        .when((n <= 2) & ~digits, False)
        .when((n >= 2) & (digits | _ends_with_any(clean, (".html", ".shtml", ".htm"))), True)
        .otherwise(False)
    )


def date_from_url(url: Column) -> Column:
    """The date that a path carries, as a date; the first form that holds a real date wins."""
    p = F.lower(path(url))
    forms = ((r"/(\d{4})[-/](\d{2})[-/](\d{2})/", True), (r"/(\d{4})[-/](\d{2})/", False), (r"/(\d{4})(\d{2})/", False), (r"/a/(\d{4})(\d{2})/", False), (r"t(\d{4})(\d{2})(\d{2})_", True))
    part = lambda pattern, k: F.nullif(F.regexp_extract(p, pattern, k), F.lit(""))
    return F.coalesce(*[F.concat_ws("-", part(f, 1), part(f, 2), part(f, 3) if day else F.when(part(f, 1).isNotNull(), "01")).try_cast("date") for f, day in forms])


def host_in_scope(url: Column, own: str, allowed: Sequence[str] = ()) -> Column:
    """Host matches one of the shell patterns; without patterns, it is the profile's domain or under it."""
    host = domain(url)
    if not allowed:
        return (host == own) | host.endswith("." + own)
    out = F.lit(False)
    for glob in allowed:
        out = out | host.rlike(glob_pattern(glob)) | F.lower(authority(url)).rlike(glob_pattern(glob))
    return out


def glob_pattern(glob: str) -> str:
    special = set(".^$+{}()|\\")
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in special else c) for c in glob) + "$"


def listing_or_article(url: Column, listing: Sequence[str], article: Sequence[str]) -> Column:
    """False for a listing (which wins), true for an article, null where neither is known."""
    hit = lambda patterns: F.lit(False) if not patterns else url.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(hit(listing), False).when(hit(article), True)


def domain_wanted(host: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Raw suffix test: ``notbbc.com`` ends with ``bbc.com``."""
    out = _ends_with_any(host, include) if include else F.lit(True)
    return out & ~_ends_with_any(host, exclude) if exclude else out


def is_video(url: Column) -> Column:
    return in_domains(domain(url), VIDEO_HOSTS) | _ends_with_any(F.lower(path(url)), VIDEO_ENDINGS)


def unwrap_redirect(url: Column) -> Column:
    """The target of a search engine's redirect link."""
    target = F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/RU=([^/]+)", 1), F.lit("")))
    return F.coalesce(F.try_url_decode(target), url)


def search_url(template: Column, keyword: Column, page: Column) -> Column:
    """Template with {keyword}, quoted as in a form, and {page}."""
    quoted = F.replace(F.replace(F.url_encode(keyword), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(F.replace(template, F.lit("{keyword}"), quoted), F.lit("{page}"), page.cast("string"))
