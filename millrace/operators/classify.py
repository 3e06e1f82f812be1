"""Rule-based labels: source, content type, theme, geography, language name and sentiment.

Taxonomies are arguments; the defaults are the fixed values below. Tests are of raw substrings
unless stated, so a short word also hits inside longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import domain

# fixed values: word lists of the labels
JOURNAL_WORDS = ("journal", "springer", "ieee", "sciencedirect", "nature", "academic", "researchgate")
THINK_TANK_WORDS = ("thinktank", "brookings", "rand", "csis", "chathamhouse", "cfr", "rusi", "sipri", "iiss", "lowyinstitute")
BRIEF_WORDS = ("policy", "brief", "memo", "advisory", "recommendation")
CONTENT_WORDS = {
    "Podcast": ("podcast", "audio", "listen", "soundcloud"),
    "Video": ("video", "youtube", "vimeo", "watch", "broadcast", "clip"),
    "Event": ("event", "webinar", "conference", "summit", "workshop", "seminar"),
    "Book": ("book", "monograph", "novel"),
}
THEMES = {
    "Maritime": ("sea", "port", "vessel", "ship", "maritime", "ocean", "naval", "shipping", "harbor", "strait", "submarine"),
    "Defence": ("army", "weapon", "missile", "military", "defence", "defense", "soldier", "navy", "war", "combat", "arsenal", "ammunition"),
    "Security": ("security", "cyber", "threat", "intelligence", "police", "attack", "terrorism", "espionage", "surveillance"),
    "Politics": ("politics", "election", "government", "parliament", "vote", "senate", "congress", "policy", "regime", "geopolitics", "diplomatic"),
    "Economy": ("economy", "trade", "gdp", "finance", "fiscal", "inflation", "market", "tariff", "economic", "business", "commerce"),
}
COUNTRIES = ("India", "China", "United States", "USA", "Pakistan", "Myanmar", "Burma", "Russia", "Japan", "Taiwan", "Iran", "North Korea", "South Korea", "Vietnam", "Philippines", "Indonesia", "Malaysia", "Singapore", "Thailand", "Bangladesh", "Sri Lanka", "Maldives", "Australia", "Ukraine", "United Kingdom", "UK")
REGIONS = ("Indo-Pacific", "Asia-Pacific", "South Asia", "Southeast Asia", "Middle East", "Europe", "Africa", "Americas")
LANGUAGES = {"en": "English", "ur": "Urdu", "my": "Burmese", "hi": "Hindi", "zh": "Chinese", "ru": "Russian", "es": "Spanish", "fr": "French", "de": "German", "ja": "Japanese", "ar": "Arabic"}
POSITIVE = ("positive", "success", "growth", "win", "alliance", "cooperation", "support", "benefit", "strengthen", "advance", "develop")
NEGATIVE = ("negative", "fail", "crisis", "threat", "conflict", "warn", "clash", "tension", "dispute", "protest", "risk", "damage")


def _any(words, *texts: Column) -> Column:
    out = F.lit(False)
    for w in words:
        for t in texts:
            out = out | F.contains(t, F.lit(w))
    return out


def source_type(url: Column) -> Column:
    host, low = domain(url), F.lower(url)
    return F.when(F.contains(host, F.lit(".gov")), "Government").when(_any((".edu", ".ac."), host), "Research Institute").when(_any(JOURNAL_WORDS, host, low), "Journal").when(_any(THINK_TANK_WORDS, host, low), "Think Tank").otherwise("News")


def content_type(url: Column, title: Column) -> Column:
    low, name = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    out = F.when(F.contains(low, F.lit("pdf")), F.when(_any(BRIEF_WORDS, low, name), "Policy Brief").otherwise("Report"))
    for label, words in CONTENT_WORDS.items():
        out = out.when(_any(words, low, name), label)
    return out.when(source_type(url) == "Journal", "Journal").otherwise("Article")


def _text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def subject_theme(title: Column, content: Column, themes=None) -> Column:
    named = lambda text: F.array_join(F.array_compact(F.array(*[F.when(_any(words, text), F.lit(k)) for k, words in (themes or THEMES).items()])), ", ")
    return let(let(F.lower(_text(title, content)), named), lambda found: F.when(found == "", "General").otherwise(found))


def country_region(title: Column, content: Column, countries=COUNTRIES, regions=REGIONS) -> Column:
    """Names found as whole words; US or U.S. before a word character, in capitals, adds the United States."""

    def places(raw: Column, low: Column) -> Column:
        # a plain search first: hardly any text comes to the pattern of a name
        named = lambda names: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n.lower())) & low.rlike(r"(?U)\b" + n.lower() + r"\b"), F.lit(n)) for n in names]))
        states = _any(("US", "U.S."), raw) & raw.rlike(r"(?U)\bUS\b|\bU\.S\.\b")
        own = let(named(countries), lambda found: F.concat(found, F.when(states & ~F.array_contains(found, "United States"), F.array(F.lit("United States"))).otherwise(F.array().cast("array<string>"))))
        return F.array_join(F.concat(own, named(regions)), ", ")

    text = _text(title, content)
    found = let(F.struct(text.alias("raw"), F.lower(text).alias("low")), lambda s: places(s["raw"], s["low"]))
    return let(found, lambda names: F.when(names == "", "Global").otherwise(names))


def language_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(code, F.lit("en")))), F.lit("English"))


def sentiment(title: Column, content: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """Whether more distinct positive or more distinct negative words occur."""

    def mood(text: Column) -> Column:
        count = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        return let(count(positive) - count(negative), lambda n: F.when(n > 0, "positive").when(n < 0, "negative").otherwise("neutral"))

    return let(F.lower(_text(title, content)), mood)
