"""Landed discovery payloads as DataFrames: sitemaps, feeds, WordPress JSON, OAI-PMH, link graphs."""

from __future__ import annotations

import zlib
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import arrow_udf
from ..session import written

LOC = r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*(https?://[^<\]\s]+)"


def is_sitemap(body: Column) -> Column:
    return F.substring(body, 1, 2000).rlike(r"(?i)<(?:urlset|sitemapindex)\b")


def is_feed(body: Column) -> Column:
    return F.substring(body, 1, 1000).rlike(r"(?i)<(?:rss|feed|rdf:RDF)\b")


def locations(body: Column) -> Column:
    """Absolute URLs of all loc elements, CDATA or not."""
    return F.regexp_extract_all(body, F.lit(LOC), 1)


def feed_links(body: Column) -> Column:
    """Links of RSS items and Atom entries, by pattern: malformed feeds give what they have."""
    rss = F.regexp_extract_all(body, F.lit(r"(?is)<item\b.*?<link>\s*(?:<!\[CDATA\[)?\s*(https?://[^<\]\s]+)"), 1)
    atom = F.regexp_extract_all(body, F.lit(r"""(?is)<entry\b.*?<link\b[^>]*?href=["'](https?://[^"']+)"""), 1)
    return F.concat(rss, atom)


@arrow_udf("struct<kind:string,entries:array<struct<loc:string,lastmod:string,news_date:string,news_title:string>>>")
def sitemap(data: pd.Series) -> pd.DataFrame:
    """Kind (urlset, sitemapindex or unknown) and entries of sitemap bytes, gzipped or not, in any name space."""
    return pd.DataFrame([parse_sitemap(d) for d in data], columns=["kind", "entries"])


#: Bytes that a packed sitemap may unpack to; larger ones are unknown.
MOST_SITEMAP = 64 << 20


def parse_sitemap(data: bytes | None) -> tuple[str, list[dict]]:
    try:
        raw = data or b""
        if raw[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            raw = unpack.decompress(raw, MOST_SITEMAP)
            if unpack.unconsumed_tail:
                return "unknown", []
        root = ET.fromstring(raw)
    except (ET.ParseError, OSError, EOFError, ValueError, zlib.error):
        return "unknown", []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    kind = local(root) if local(root) in ("urlset", "sitemapindex") else "unknown"
    out = []
    for entry in root if kind != "unknown" else ():
        text = {local(e): (e.text or "").strip() for e in entry.iter()}
        if text.get("loc"):
            out.append({"loc": text["loc"], "lastmod": text.get("lastmod"), "news_date": text.get("publication_date"), "news_title": text.get("title")})
    return kind, out


def sitemap_urls(payloads: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """url and depth of pages reached from seed sitemaps through nested indexes; payloads has url and body."""
    edges = written(payloads.select(F.col("url").alias("src"), is_sitemap(F.col("body")).alias("map"), F.explode(locations(F.col("body"))).alias("dst")), "sitemap-edges")
    return breadth_first(edges.select("src", "dst"), seeds.select("url"), depth)


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """url and the least number of links (src, dst) from a seed, up to a depth. Each round is written out."""
    edges = written(edges.select("src", "dst"), "links")  # every round reads them
    seen = written(seeds.distinct().select("url", F.lit(0).cast("bigint").alias("depth")), "seen")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        frontier = written(step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(d).cast("bigint").alias("depth")), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


WP_SCHEMA = "array<struct<id:bigint,link:string,date_gmt:string,title:struct<rendered:string>,excerpt:struct<rendered:string>>>"


def wordpress_posts(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Discovered URLs from WordPress post lists; broken payloads give none."""
    from ..functions.text import lenient_timestamp
    from .html import html_unescaped

    posts = payloads.select(F.explode(F.from_json(body, WP_SCHEMA)).alias("p"))
    return posts.where("p.link is not null").select(F.col("p.link").alias("url"), F.lit("wp_api").alias("source"), html_unescaped(F.col("p.title.rendered")).alias("title"), lenient_timestamp(F.col("p.date_gmt")).alias("published_at"), F.create_map(F.lit("id"), F.col("p.id").cast("string")).alias("metadata"))


def oai_records(payloads: DataFrame, keyword: str = "", body: str = "body") -> DataFrame:
    """Identifier, title and description of the live OAI-PMH records that mention the keyword."""
    record = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<record>.*?</record>)"), 1))
    field = lambda n: F.regexp_extract("r", rf"(?s)<dc:{n}[^>]*>(.*?)</dc:{n}>", 1)
    rows = payloads.select(record.alias("r")).where(~F.col("r").rlike(r"""<header[^>]*status=["']deleted"""))
    rows = rows.select(field("identifier").alias("url"), field("title").alias("title"), field("description").alias("description"), field("date").alias("published"))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "description")), F.lit(keyword.lower())))


def json_records(body: Column, schema: str) -> Column:
    """The record list of an unknown JSON envelope: a list itself, or under a usual key, one level down too."""
    keys = ("content", "list", "data", "results", "items")
    paths = [f"$.{k}" for k in keys] + [f"$.{a}.{b}" for a in keys for b in keys]
    return F.coalesce(F.from_json(F.when(body.rlike(r"^\s*\["), body), schema), *[F.from_json(F.when(F.get_json_object(body, p).rlike(r"^\s*\["), F.get_json_object(body, p)), schema) for p in paths])


def capped(rows: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, bool]:
    """The first n rows of an order, and whether there are more; rows are sorted once."""
    some = written(rows.orderBy(*order).limit(n + 1), "capped")
    return some.orderBy(*order).limit(n), some.count() > n


STRATEGIES: dict = {}


def register(name: str):
    """Decorator: a builder of discovered URLs under a name that site profiles use."""

    def add(builder):
        STRATEGIES[name] = builder
        return builder

    return add


register("wp_api")(wordpress_posts)
register("oai_pmh")(oai_records)
register("sitemap")(sitemap_urls)


def hosts_pattern(names: list[str]) -> str:
    return "|".join(re.escape(n) for n in names)
