"""Text and date functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: headings after which a page has no article text
STOP_PATTERNS = (
    r"^more\s+(?:.*\s+)?(?:news|articles|stories|headlines)$", r"^related\s+(?:.*\s+)?(?:stories|articles|posts|news|content)$", r"^you\s+may\s+also\s+like$",
    r"^recommended\s+for\s+you$", r"^read\s+next$", r"^sponsored\s+(?:.*\s+)?content$", r"^latest\s+(?:.*\s+)?(?:stories|news|headlines|articles)$",
    r"^popular\s+(?:.*\s+)?(?:stories|articles|posts)$", r"^top\s+stories$", r"^trending\s+(?:.*\s+)?(?:stories|news|topics)$", r"^comments$", r"^discussion$",
    r"^share\s+this\s+article$", r"^follow\s+us$", r"^newsletter$", r"^more\s+from\s+",
)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.md5(squeeze(F.lower(text)))


def truncated(text: Column, n: int, keep: int | None = None) -> Column:
    """Texts longer than n end in ``...`` after ``keep`` characters."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(keep or n)), F.lit("..."))).otherwise(text)


def count_of(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def whole_word_count(text: Column, term: str, case_sensitive: bool = False) -> Column:
    special = set("\\^$.|?*+()[]{}")
    quoted = "".join("\\" + c if c in special else c for c in term)
    return F.regexp_count(text, F.lit(("(?U)" if case_sensitive else "(?iU)") + r"\b" + quoted + r"\b")).cast("bigint")


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s_]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "_"), "_+", "_"), "^_|_$", "")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with the terms of two or more characters marked, whatever their case."""
    out = html_escape(text)
    special = set("\\^$.|?*+()[]{}")
    known = ["".join("\\" + c if c in special else c for c in t) for t in terms if len(t) >= 2]
    return F.regexp_replace(out, "(?i)(" + "|".join(known) + ")", "<mark>$1</mark>") if known else out


def author_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^(by|posted by)\s+", "")


def group_label(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def file_name(text: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9 _-]", "")), F.lit(" "), F.lit("_"))


def keyword_display(keywords: Column, n: int = 2) -> Column:
    """The first n keywords and how many more there are."""
    return F.concat(F.array_join(F.slice(keywords, 1, n), ", "), F.when(F.size(keywords) > n, F.concat(F.lit(" (+"), (F.size(keywords) - n).cast("string"), F.lit(" more)"))).otherwise(""))


def lenient_timestamp(text: Column) -> Column:
    """ISO text as a timestamp; else its first ten characters as a date; else null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("yyyy-MM-dd")))


def trim_at_stop_line(text: Column, longest: int = 80, patterns=STOP_PATTERNS) -> Column:
    """The lines before the first short line that matches a stop pattern."""
    stop = "(?i)" + "|".join(f"(?:{p})" for p in patterns)

    def cut(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda s: (F.length(F.trim(s)) < longest) & F.trim(s).rlike(stop)), True)
        return let(at, lambda k: F.array_join(F.when(k > 0, F.slice(lines, F.lit(1), (k - 1).cast("int"))).otherwise(lines), "\n"))

    return let(F.split(text, "\n"), cut)


def retention(cleaned: Column, original: Column) -> Column:
    """Share of the text, white space aside, that cleaning kept."""
    size = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    return F.when(size(original) > 0, size(cleaned) / size(original)).otherwise(1.0)


def uuid5_dns(name: Column) -> Column:
    """Name-based UUID, version 5, in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def next_run(frequency: Column, base: Column, hour: Column, minute: Column, weekday: Column, day: Column) -> Column:
    """The next time of a schedule strictly after base; weekday 0 is Sunday, a day beyond the month is its last.

    Without hour or minute: one day, 7 days or 30 days later. Null or unknown frequencies count as daily.
    """
    at = lambda d: F.make_timestamp(F.year(d), F.month(d), F.day(d), hour, minute, F.lit(0))
    later = lambda c, unit, n: c + F.expr(f"INTERVAL {n} {unit}")
    today = at(base)
    plain = F.when(frequency == "weekly", later(base, "DAYS", 7)).when(frequency == "monthly", later(base, "DAYS", 30)).otherwise(later(base, "DAYS", 1))
    daily = F.when(today > base, today).otherwise(later(today, "DAYS", 1))
    ahead = F.pmod(weekday - (F.dayofweek(base) - 1) + 7, F.lit(7)).cast("int")
    weekly_at = at(F.date_add(base, ahead))
    weekly = F.when(weekday.isNull(), F.when(today > base, today).otherwise(later(today, "DAYS", 7))).otherwise(F.when(weekly_at > base, weekly_at).otherwise(later(weekly_at, "DAYS", 7)))
    in_month = lambda d: at(F.date_add(F.trunc(d, "month"), (F.least(F.coalesce(day, F.lit(1)), F.day(F.last_day(d))) - 1).cast("int")))
    this, following = in_month(base), in_month(F.add_months(F.trunc(base, "month"), 1))
    monthly = F.when(this > base, this).otherwise(following)
    timed = F.when(frequency == "daily", daily).when(frequency == "weekly", weekly).when(frequency == "monthly", monthly).otherwise(later(base, "DAYS", 1))
    return F.when(hour.isNull() | minute.isNull(), plain).otherwise(timed)


def run_reference(expected: Column, now: Column) -> Column:
    """What the next run counts from: now, if the expected time is over 12 hours past."""
    return F.when(expected < now - F.expr("INTERVAL 12 HOURS"), now).otherwise(expected)


def from_epoch_ms(value: Column) -> Column:
    """The time of a number of milliseconds since 1970."""
    return F.timestamp_millis(value)


def time_text(value: Column) -> Column:
    """A time to the second; years past 9999 have their digits alone, without the sign that a date format gives them."""
    return F.regexp_replace(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), r"^\+", "")


def record_id(url: Column) -> Column:
    return F.md5(url)
