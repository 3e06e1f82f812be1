"""Error pages, soft failures, and the filters between extraction and storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import authority, date_from_url, is_article

# fixed values: phrases of error pages and of challenge pages
ERROR_PHRASES = ("504 gateway time-out", "504 gateway timeout", "502 bad gateway", "503 service unavailable", "503 service temporarily unavailable", "500 internal server error", "403 forbidden", "404 not found", "database error", "database connection error", "error establishing a database connection", "site is down", "maintenance mode", "access denied", "gateway time-out", "gateway timeout", "bad gateway")
CHALLENGE_SIGNALS = ("ray id", "security check", "ddos protection", "verify you are human", "checking your browser", "enable cookies", "enable javascript", "captcha", "turnstile", "unusual traffic", "browser validation")
CHALLENGE_NAME = "cloudflare"


def is_error_page(html: Column, title: Column, body: Column) -> Column:
    """Whether a page reports a failure or asks for proof instead of having content; empty pages do."""
    empty = F.trim(F.coalesce(html, F.lit(""))) == ""
    refresh = html.rlike(r"""(?is)<meta[^>]*http-equiv\s*=\s*["']?refresh[^>]*url=""") & (F.length(F.coalesce(body, F.lit(""))) < 2000)
    bound = F.struct(F.lower(F.trim(F.coalesce(title, F.lit("")))).alias("name"), F.lower(F.coalesce(body, F.lit(""))).alias("low"), F.length(F.coalesce(body, F.lit(""))).alias("n"))
    return F.coalesce(empty | let(bound, lambda s: _reports_failure(s["name"], s["low"], s["n"])) | refresh, F.lit(True))


def _reports_failure(name: Column, low: Column, n: Column) -> Column:
    phrases = F.array(*map(F.lit, ERROR_PHRASES))
    in_title = F.exists(phrases, lambda p: F.contains(name, p)) & (F.length(name) < 120)
    early = (n < 1200) & F.exists(phrases, lambda p: (F.position(p, low) > 0) & (F.position(p, low) <= 120))
    tiny = (n < 250) & F.exists(phrases, lambda p: F.contains(low, p))
    signals = F.size(F.filter(F.array(*map(F.lit, CHALLENGE_SIGNALS)), lambda s: F.contains(low, s)))
    challenge = (F.contains(low, F.lit(CHALLENGE_NAME)) | F.contains(name, F.lit(CHALLENGE_NAME))) & ((signals >= 2) | ((n < 1500) & (signals >= 1)))
    return in_title | early | tiny | challenge


def language_allowed(lang: Column, wanted: list[str]) -> Column:
    """True without a filter, and for pages whose language is not known."""
    return F.lit(True) if not wanted else lang.isNull() | F.lower(lang).isin([w.lower() for w in wanted])


def date_allowed(published: Column, as_of: Column, start: Column | None = None, end: Column | None = None, days: int = 90) -> Column:
    """Inclusive bounds; the start is ``days`` before as_of unless given; unknown dates pass."""
    lower = start if start is not None else as_of - F.expr(f"INTERVAL {days} DAYS")
    inside = published >= lower
    if end is not None:
        inside = inside & (published <= end)
    return F.coalesce(inside, F.lit(True))


# fixed values: where a maintenance page is and how long, signs of a challenge, and why pages are left out
MAINTENANCE_PATH, MAINTENANCE_HOST, MAINTENANCE_SIZE, MAINTENANCE_SLACK = "mfa.gov.cn/web/system/", "mfa.gov.cn", 55990, 500
CHALLENGE_MARKERS = ("Just a moment", "cf-chl-", "challenges.cloudflare.com", "Checking your browser")
LANDING, UNDATED, OLD = "Skipped: Homepage or category/index landing page content.", "Skipped: Unable to verify article publication date.", "Skipped: Article published more than 3 months ago ("


def response_verdict(url: Column, size: Column, mitigated: Column, status: Column, body: Column) -> Column:
    """``maintenance`` or ``challenge`` for responses that stand for a page, else null. url is the final one, size
    the bytes of the body, mitigated the cf-mitigated header."""
    drift = F.contains(F.lower(authority(url)), F.lit(MAINTENANCE_HOST)) & (F.abs(size - MAINTENANCE_SIZE) < MAINTENANCE_SLACK)
    head = F.left(F.coalesce(body, F.lit("")), F.lit(4000))
    asked = status.isin(403, 503) & F.exists(F.array(*map(F.lit, CHALLENGE_MARKERS)), lambda m: F.contains(head, m))
    return F.when(F.contains(url, F.lit(MAINTENANCE_PATH)) | drift, "maintenance").when(F.contains(F.lower(F.coalesce(mitigated, F.lit(""))), F.lit("challenge")) | asked, "challenge")


def keyword_free_verdict(url: Column, published: Column, as_of: Column, days: int = 90) -> Column:
    """status and error_message of a page of a configured source without keywords: articles of the last 90 days match."""
    day = F.coalesce(published, date_from_url(url))
    reason = F.when(~is_article(url), LANDING).when(day.isNull(), UNDATED).when(day < F.date_sub(as_of, days), F.concat(F.lit(OLD), F.date_format(day, "yyyy-MM-dd"), F.lit(").")))
    return F.struct(F.when(reason.isNull(), "matched").otherwise("skipped").alias("status"), reason.alias("error_message"))
