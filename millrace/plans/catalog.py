"""The registered queries and, for each that SQL can express, the same in DuckDB SQL.

Both sides name every output column alike and give bigint, double, string or boolean values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import classify as C
from ..operators import dedup as D
from ..operators import keywords as K
from ..operators import quality as Q
from ..operators.scan import numbered
from ..sources import feeds, html
from ..streaming import progress as S
from . import pages as P

TERMS = ("the", "que", "ment")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import derived, landed, lifecycle  # noqa: F401  add their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import derived, landed, lifecycle  # noqa: F401  add their queries

    return dict(ORACLE)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows: list[tuple], columns: str) -> str:
    """A literal table, the same text for both engines."""
    cell = lambda v: "CAST(NULL AS VARCHAR(99))" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    kinds = [next(("bigint" if isinstance(r[i], int) else "string" for r in rows if r[i] is not None), "string") for i in range(len(rows[0]))]
    return spark.createDataFrame(rows, ", ".join(f"{c.strip()} {k}" for c, k in zip(columns.split(","), kinds)))


# ---- flagship --------------------------------------------------------------------------------

_PAGE = r"""p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) title, regexp_extract(html, '<html lang="([A-Za-z]+)', 1) lang,
 trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) body FROM pages)"""
_DOMAIN = r"regexp_replace(lower(regexp_extract({0}, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract({0}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"


def _counts(column: str, terms=TERMS) -> str:
    return " + ".join(_COUNT.format(f"lower({column})", t, len(t)) for t in terms)


def _rounded(score: str) -> str:
    """One decimal by the exact binary value, ties to even, of a double column of a subquery."""
    s, e = f"({score} * 16 + {score} * 4)", f"(({score} * 16 - ((({score} * 16 + {score} * 4)) - (({score} * 16 + {score} * 4) - {score} * 16))) + ({score} * 4 - (({score} * 16 + {score} * 4) - {score} * 16)))"
    half = f"floor(({s} - 1) / 2)"
    return f"CASE WHEN {s} % 2 = 1 THEN {half} + CASE WHEN {e} > 0 THEN 1 WHEN {e} < 0 THEN 0 ELSE {half} % 2 END ELSE floor(({s} + 1) / 2) END / 10.0"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return P.ranked(_t(spark, d, "pages"), list(TERMS))


_WORDS = r"len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> ''))"
_SCORE = f"(CASE WHEN nt > 0 THEN 35.0 ELSE 0.0 END + CASE WHEN nu > 0 THEN 10.0 ELSE 0.0 END + CASE WHEN {_WORDS} > 0 THEN least(40.0, CAST(nb AS DOUBLE) / {_WORDS} * 2000) ELSE 0.0 END)"


@query(f"""WITH {_PAGE}, c AS (SELECT *, {_counts('title')} nt, {_counts('body')} nb, {_counts('url')} nu FROM p)
SELECT page_id, url, {_DOMAIN.format('url')} AS domain, title, lang, CAST(nt + nb + CASE WHEN nu > 0 THEN 1 ELSE 0 END AS BIGINT) occurrences,
 array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(title || chr(10) || body || chr(10) || url), '{t}') THEN '{t}' END" for t in TERMS)}], lambda x: x IS NOT NULL), ', ') keywords,
 {_rounded('x')} AS relevance_score FROM (SELECT *, CAST({_SCORE} AS DOUBLE) x FROM c) WHERE nt + nb + nu > 0""")
def page_keyword_rank(spark, d):
    return flagship(spark, d)


# ---- URLs ------------------------------------------------------------------------------------

# fixed values, as SQL compares them
_SQL_PARAMETERS = "q query search s keyword keywords k keys searchword search_api_views_fulltext text term find sr search_query search_keyword buscar suche".split()
_SQL_STATIC = ".pdf .jpg .jpeg .png .gif .svg .zip .css .js .xml".split()
_SQL_SKIPPED = ".pdf .jpg .jpeg .png .gif .svg .webp .zip .tar .gz .css .js .xml .json .mp4 .mp3 .wav .avi .mov .ico .woff .woff2 .ttf .eot".split()
_SQL_EXCLUDED = "google.com google.co.in google.co.uk google.ad google.ae youtube.com youtu.be facebook.com twitter.com instagram.com linkedin.com pinterest.com duckduckgo.com bing.com yahoo.com search.yahoo.com microsoft.com wikipedia.org w3.org schema.org".split()

URLS = [
    ("https://example.com/search?q=war",), ("https://example.com/page/2/?s=x",), ("https://example.com/?s=navy",), ("https://example.com/?Q=",), ("https://example.com/search/",), ("https://example.com/results?query=a",),
    ("https://example.com/find?keyword=b",), ("https://example.com/research/paper-1",), ("https://example.com/findings/2024",), ("https://example.com/news/page/2/",), ("https://example.com/article?id=123&ref=homepage",),
    ("https://www.example.com/a/202607/27/1234.html",), ("https://example.com/2024/05/17/story",), ("https://example.com/2024-13-40/x/2024/07/",), ("http://gov.example.org/t20260727_11234567.shtml",), ("https://example.com/",),
    ("https://example.com/world",), ("https://example.com/index.html",), ("https://example.com/news/2024/story-9.html",), ("ftp://example.com/x",), ("https://example.com/no_results",), ("https://m.youtube.com/watch?v=1",),
    ("https://example.com/a.PDF",), ("https://notbbc.com/x",), ("https://www.bbc.com/news/world-1",), ("//cdn.example.com/a",), ("/local/path",), ("https://ex.com/listing/55?p=3",), ("https://www.google.com/l/?uddg=https%3A%2F%2Ftarget.org%2Fa&x=1",), ("https://r.yahoo.com/_y/RU=https%3a%2f%2ft.net%2fb/RK=0",),
]
_URLS = f"u AS (SELECT url FROM pages UNION ALL SELECT url FROM {_values(URLS, 'url')})"


def _urls(spark, d):
    return _t(spark, d, "pages").select("url").unionByName(_literal(spark, URLS, "url"))


@query(f"SELECT {_DOMAIN.format('url')} AS domain, count(*) AS n FROM pages GROUP BY 1")
def url_domain_counts(spark, d):
    return _t(spark, d, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_SEARCH = rf"""coalesce(starts_with(url, 'http') AND (regexp_matches({_PATH.format('url')}, '(?i)/(?:search|find|results|searchresults|search-results|site-search|query)(?:/|$)')
 OR ({_QUERY} <> '' AND list_has_any(list_transform(string_split({_QUERY}, '&'), lambda x: lower(url_decode(string_split(x, '=')[1]))), {_SQL_PARAMETERS}))
 OR (regexp_matches({_PATH.format('url')}, '(?i)/page/\d+') AND regexp_matches('?' || {_QUERY}, '(?i)[?&](?:q|s|query|search|keyword|keywords|find|keys|searchword|term)='))
 OR regexp_matches(url, '(?i)no[_-]?results|0[_-]?results|not[_-]?found|noresult')), false)"""


@query(f"WITH {_URLS} SELECT url, {_SEARCH} AS is_search FROM u")
def url_search_page_flag(spark, d):
    return _urls(spark, d).select("url", U.is_search_page(F.col("url")).alias("is_search"))


@query(f"WITH {_URLS} SELECT url FROM u WHERE NOT {_SEARCH}")
def url_candidate_filter(spark, d):
    return _urls(spark, d).where(~U.is_search_page(F.col("url")))


_CLEAN = f"regexp_replace(lower({_PATH.format('url')}), '^/+|/+$', '', 'g')"


@query(rf"""WITH {_URLS} SELECT url, CASE WHEN c = '' OR c IN ('index.html', 'index.shtml', 'index.htm', 'default.html', 'default.shtml') THEN false
 WHEN regexp_matches(p, '/\d{{4}}[-/]?\d{{2}}[-/]?\d{{2}}/|/\d{{6}}/|/page/\d{{6}}/|/a/\d{{6}}/') OR regexp_matches(p, 't\d{{8}}_') THEN true
 WHEN n <= 2 AND NOT g THEN false WHEN n >= 2 AND (g OR ends_with(c, '.html') OR ends_with(c, '.shtml') OR ends_with(c, '.htm')) THEN true ELSE false END AS is_article
 FROM (SELECT url, lower({_PATH.format('url')}) p, {_CLEAN} c, len(string_split({_CLEAN}, '/')) n, regexp_matches(string_split({_CLEAN}, '/')[-1], '[0-9]') g FROM u)""")
def url_article_flag(spark, d):
    return _urls(spark, d).select("url", U.is_article(F.col("url")).alias("is_article"))


def _date(pattern: str, day: str) -> str:
    part = lambda k: f"regexp_extract(p, '{pattern}', {k})"
    return f"TRY_CAST(CASE WHEN {part(1)} <> '' THEN {part(1)} || '-' || {part(2)} || '-' || {day or part(3)} END AS DATE)"


@query(rf"""WITH {_URLS} SELECT url, CAST(coalesce({_date(r'/(\d{4})[-/](\d{2})[-/](\d{2})/', '')}, {_date(r'/(\d{4})[-/](\d{2})/', "'01'")}, {_date(r'/(\d{4})(\d{2})/', "'01'")},
 {_date(r'/a/(\d{4})(\d{2})/', "'01'")}, {_date(r't(\d{4})(\d{2})(\d{2})_', '')}) AS VARCHAR) AS published FROM (SELECT url, lower({_PATH.format('url')}) p FROM u)""")
def url_date(spark, d):
    return _urls(spark, d).select("url", U.date_from_url(F.col("url")).cast("string").alias("published"))


@query(rf"""WITH {_URLS} SELECT url, regexp_matches(url, '^https?://') AND NOT ({' OR '.join(f"ends_with(lower({_PATH.format('url')}), '{e}')" for e in _SQL_STATIC)})
 AND NOT ({_DOMAIN.format('url')} IN {tuple(_SQL_EXCLUDED)} OR len(list_filter({_SQL_EXCLUDED}, lambda x: ends_with({_DOMAIN.format('url')}, '.' || x))) > 0) AS valid FROM u""")
def url_valid_result(spark, d):
    return _urls(spark, d).select("url", U.is_valid_result(F.col("url")).alias("valid"))


@query(r"SELECT regexp_replace(url, '#.*$', '') AS canonical, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def url_canonical_dedup(spark, d):
    return _t(spark, d, "pages").groupBy(U.strip_fragment(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(rf"""SELECT url, h = 'example.com' OR ends_with(h, '.example.com') AS in_scope, regexp_matches(h, '^blog\..*\.example\.net$') AS in_glob, ends_with(h, 'le.com') AS raw_suffix
 FROM (SELECT url, {_DOMAIN.format('url')} h FROM pages)""")
def host_scope_filter(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("url", U.host_in_scope(u, "example.com").alias("in_scope"), U.host_in_scope(u, "", ["blog.*.example.net"]).alias("in_glob"), U.domain_wanted(U.domain(u), ["le.com"], []).alias("raw_suffix"))


@query(rf"WITH {_URLS} SELECT url, h AS domain FROM (SELECT url, {_DOMAIN.format('url')} h FROM u) WHERE (ends_with(h, 'bbc.com') OR ends_with(h, 'example.com')) AND NOT ends_with(h, 'spam-farm.example.org')")
def domain_include_exclude(spark, d):
    rows = _urls(spark, d).select("url", U.domain(F.col("url")).alias("domain"))
    return rows.where(U.domain_wanted(F.col("domain"), ["bbc.com", "example.com"], ["spam-farm.example.org"]))


@query(rf"""WITH {_URLS} SELECT url, CASE WHEN regexp_matches(url, '/world$|/page/') THEN false WHEN regexp_matches(url, '\d{{3,}}') THEN true END AS is_article FROM u""")
def url_listing_tristate(spark, d):
    return _urls(spark, d).select("url", U.listing_or_article(F.col("url"), [r"/world$", r"/page/"], [r"\d{3,}"]).alias("is_article"))


@query(rf"""WITH {_URLS} SELECT url, CASE WHEN starts_with(url, '//') THEN 'https:' || url WHEN starts_with(url, '/') THEN 'https://base.org' || url WHEN regexp_matches(url, '^https?://') THEN url END AS absolute,
 coalesce(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1), '') AS origin, TRY_CAST(regexp_extract(url, '(?i)[?&](?:page|p|pg|paged|start|offset|from)=(\d+)', 1) AS BIGINT) AS page_no,
 CAST(len(list_filter(string_split({_PATH.format('url')}, '/'), lambda x: x <> '')) AS BIGINT) AS n_segments, lower(regexp_extract({_PATH.format('url')}, '(\.[A-Za-z0-9]+)$', 1)) AS ending FROM u""")
def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", U.absolutize(u, F.lit("https://base.org")).alias("absolute"), U.origin(u).alias("origin"), U.page_number(u).alias("page_no"), F.size(U.segments(u)).cast("bigint").alias("n_segments"), U.file_ending(u).alias("ending"))


@query(rf"WITH {_URLS} SELECT url, coalesce(url_decode(coalesce(nullif(regexp_extract(url, '[?&]uddg=([^&]+)', 1), ''), nullif(regexp_extract(url, '/RU=([^/]+)', 1), ''))), url) AS target FROM u")
def url_unwrap_redirect(spark, d):
    return _urls(spark, d).select("url", U.unwrap_redirect(F.col("url")).alias("target"))


@query(rf"""WITH {_URLS} SELECT url, starts_with(url, '#') OR {' OR '.join(f"ends_with(lower({_PATH.format('url')}), '{e}')" for e in _SQL_SKIPPED)}
 OR len(list_filter(string_split({_PATH.format('url')}, '/'), lambda x: x <> '')) = 0 OR regexp_matches(url, '(?i)[?&](?:page|p|pg|paged|start|offset|from)=\d+') AS skip FROM u""")
def url_skippable(spark, d):
    return _urls(spark, d).select("url", U.is_skippable(F.col("url")).alias("skip"))


@query(r"""SELECT prefix, suffix, max(CAST(num AS BIGINT)) AS highest FROM (SELECT regexp_extract(url, '^(.*?)(\d+)(/?(?:\?.*)?)$', 1) prefix, regexp_extract(url, '^(.*?)(\d+)(/?(?:\?.*)?)$', 2) num, regexp_extract(url, '^(.*?)(\d+)(/?(?:\?.*)?)$', 3) suffix FROM pages) WHERE num <> '' GROUP BY 1, 2""")
def numeric_tail_max(spark, d):
    prefix, number, suffix = U.trailing_number(F.col("url"))
    return _t(spark, d, "pages").select(prefix.alias("prefix"), number.alias("num"), suffix.alias("suffix")).where("num <> ''").groupBy("prefix", "suffix").agg(F.max(F.col("num").cast("bigint")).alias("highest"))


# ---- keywords on documents -------------------------------------------------------------------


@query("SELECT doc_id, " + ", ".join(f"CAST({_COUNT.format('lower(text)', t, len(t))} AS BIGINT) AS n_{t}" for t in TERMS) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), ',') AS matched FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in TERMS))
def doc_phrase_match(spark, d):
    text = F.col("text")
    rows = _t(spark, d, "documents").select("doc_id", *[K.occurrences(text, t).alias(f"n_{t}") for t in TERMS])
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in TERMS])), ",")
    return rows.withColumn("matched", named).where("matched <> ''")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x = 'the')) AS BIGINT) AS n_the FROM documents")
def doc_exact_word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.whole_word_count(F.col("text"), "the").alias("n_the"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND (contains(lower(text), 'que') OR contains(lower(text), 'sch')) AND NOT contains(lower(text), 'ciado')")
def doc_boolean_match(spark, d):
    return _t(spark, d, "documents").where(K.parse_boolean("the AND (que OR sch) AND NOT ciado").match(F.col("text"))).select("doc_id")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""WITH f AS (SELECT doc_id, {_FLAT} t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') ws FROM f), h AS (SELECT *, len(ws) n, CAST(list_position(list_transform(ws, lambda x: contains(lower(x), 'que')), true) AS BIGINT) - 1 i FROM w)
SELECT doc_id, CASE WHEN i IS NULL OR i < 0 THEN CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END
 ELSE CASE WHEN i > 10 THEN '... ' ELSE '' END || array_to_string(ws[greatest(i - 10, 0) + 1 : least(i + 10, n)], ' ') || CASE WHEN least(i + 10, n) < n THEN ' ...' ELSE '' END END AS snippet FROM h""")
def doc_snippet(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.snippet(F.col("text"), ["que"]).alias("snippet"))


_NWORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, {_rounded('x')} AS score FROM (SELECT doc_id, CAST(CASE WHEN {_NWORDS} > 0 THEN least(40.0, CAST({_counts('text')} AS DOUBLE) / {_NWORDS} * 2000) ELSE 0.0 END AS DOUBLE) x FROM documents)")
def doc_relevance(spark, d):
    hits = sum((K.occurrences(F.col("text"), t) for t in TERMS[1:]), K.occurrences(F.col("text"), TERMS[0]))
    no = F.lit(False)
    return _t(spark, d, "documents").select("doc_id", K.round_score(K.relevance(no, no, no, hits, F.col("text"))).alias("score"))


@query(f"SELECT doc_id, ({_counts('text', ('ther', 'tion'))}) / 2.0 AS tf FROM documents")
def doc_tf_score(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.term_frequency(F.col("text"), "ther tion").alias("tf"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE (lang IS NULL OR lang IN ('en', 'fr')) AND length(text) >= 200")
def doc_language_filter(spark, d):
    return _t(spark, d, "documents").where(Q.language_allowed(F.col("lang"), ["en", "fr"]) & (F.length("text") >= html.LEAST_BODY)).select("doc_id", "lang", "n_chars")


# ---- duplicates ------------------------------------------------------------------------------

_HASH = f"md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, {_HASH} AS content_hash FROM documents")
def doc_content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {_HASH} AS content_hash, row_number() OVER (PARTITION BY {_HASH} ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def doc_exact_dups(spark, d):
    return D.exact_duplicates(_t(spark, d, "documents")).select("doc_id", "content_hash", "is_duplicate")


@query()
def doc_simhash(spark, d):
    return _t(spark, d, "documents").select("doc_id", D.simhash_text(D.simhash(F.col("text"))).alias("simhash"))


@query()
def doc_simhash_near_pairs(spark, d):
    return D.near_links(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), D.simhash(F.col("text")).alias("simhash")))


@query()
def doc_near_dup_leaders(spark, d):
    return D.first_kept(_t(spark, d, "documents"))


# eight customers share a fingerprint in which the k-th of them has its own k bits flipped
_PRINT = "xor(CAST(('0x' || substr(md5(CAST(c_custkey // 8 AS VARCHAR)), 1, 15)) AS BIGINT), ((CAST(1 AS BIGINT) << CAST(c_custkey % 8 AS INT)) - 1) << 13)"


@query(f"SELECT a.c_custkey AS a, b.c_custkey AS b, CAST(bit_count(xor(a.p, b.p)) AS BIGINT) AS distance FROM (SELECT c_custkey, {_PRINT} p FROM customer) a JOIN (SELECT c_custkey, {_PRINT} p FROM customer) b ON a.c_custkey < b.c_custkey AND bit_count(xor(a.p, b.p)) <= 3")
def hamming_pairs(spark, d):
    value = F.conv(F.substring(F.md5(F.expr("CAST(c_custkey DIV 8 AS STRING)")), 1, 15), 16, 10).cast("bigint").bitwiseXOR(F.expr("shiftleft(shiftleft(1L, CAST(c_custkey % 8 AS INT)) - 1L, 13)"))
    return D.near_pairs(_t(spark, d, "customer").select(F.col("c_custkey").alias("id"), value.alias("simhash")))


# ---- text ------------------------------------------------------------------------------------

LINES = [("Body line one\nBody two\nRelated stories\nnoise",), ("Only body",), ("A\nMore from our site\nB",), ("Comments\nx",)]
# fixed values: lines at which an article ends, as SQL compares them
_STOPS = r"(?i)(?:^more\s+(?:.*\s+)?(?:news|articles|stories|headlines)$)|(?:^related\s+(?:.*\s+)?(?:stories|articles|posts|news|content)$)|(?:^you\s+may\s+also\s+like$)|(?:^recommended\s+for\s+you$)|(?:^read\s+next$)|(?:^sponsored\s+(?:.*\s+)?content$)|(?:^latest\s+(?:.*\s+)?(?:stories|news|headlines|articles)$)|(?:^popular\s+(?:.*\s+)?(?:stories|articles|posts)$)|(?:^top\s+stories$)|(?:^trending\s+(?:.*\s+)?(?:stories|news|topics)$)|(?:^comments$)|(?:^discussion$)|(?:^share\s+this\s+article$)|(?:^follow\s+us$)|(?:^newsletter$)|(?:^more\s+from\s+)"


@query(f"""SELECT s, array_to_string(CASE WHEN hit > 0 THEN ls[1 : hit - 1] ELSE ls END, chr(10)) AS kept FROM (SELECT s, ls, coalesce(list_position(list_transform(ls, lambda x: length(trim(x)) < 80 AND regexp_matches(trim(x), '{_STOPS}')), true), 0) hit FROM
 (SELECT s, string_split(s, chr(10)) ls FROM (SELECT s FROM {_values(LINES, 's')} UNION ALL SELECT text FROM documents)))""")
def doc_stop_pattern_trim(spark, d):
    rows = _literal(spark, LINES, "s").unionByName(_t(spark, d, "documents").select(F.col("text").alias("s")))
    return rows.select("s", T.trim_at_stop_line(F.col("s")).alias("kept"))


SLUGS = [("Hello, World!",), ("  a_b  C--d ",), ("Ünïcode x",)]


@query(rf"""SELECT s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\s_]', '', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug, replace(trim(regexp_replace(s, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_') AS file FROM
 (SELECT s FROM {_values(SLUGS, 's')} UNION ALL SELECT p_name FROM part)""")
def slugify(spark, d):
    rows = _literal(spark, SLUGS, "s").unionByName(_t(spark, d, "part").select(F.col("p_name").alias("s")))
    return rows.select("s", T.slug(F.col("s")).alias("slug"), T.file_name(F.col("s")).alias("file"))


@query("""SELECT o_orderkey, strftime(CASE WHEN t > b THEN t ELSE t + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') AS daily,
 strftime(CASE WHEN wk > b THEN wk ELSE wk + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M') AS weekly,
 strftime(CASE WHEN m1 > b THEN m1 ELSE m2 END, '%Y-%m-%d %H:%M') AS monthly, strftime(b + INTERVAL 30 DAY, '%Y-%m-%d %H:%M') AS plain FROM
 (SELECT o_orderkey, b, date_trunc('day', b) + INTERVAL 390 MINUTE t, date_trunc('day', b) + to_days(CAST((3 - dayofweek(b) + 7) % 7 AS INTEGER)) + INTERVAL 390 MINUTE wk,
  date_trunc('month', b) + to_days(CAST(least(31, day(last_day(b))) - 1 AS INTEGER)) + INTERVAL 390 MINUTE m1,
  date_trunc('month', b) + INTERVAL 1 MONTH + to_days(CAST(least(31, day(last_day(date_trunc('month', b) + INTERVAL 1 MONTH))) - 1 AS INTEGER)) + INTERVAL 390 MINUTE m2
  FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) b FROM orders))""")
def next_run(spark, d):
    base = F.col("b")
    rows = _t(spark, d, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 24) * 3600).alias("b"))
    run = lambda kind, hour=6: F.date_format(T.next_run(F.lit(kind), base, F.lit(hour).cast("int"), F.lit(30), F.lit(3), F.lit(31)), "yyyy-MM-dd HH:mm")
    return rows.select("o_orderkey", run("daily").alias("daily"), run("weekly").alias("weekly"), run("monthly").alias("monthly"), run("monthly", None).alias("plain"))


# ---- labels ----------------------------------------------------------------------------------


def _like(words, *columns) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words for c in columns) + ")"


_SOURCE = f"CASE WHEN contains(h, '.gov') THEN 'Government' WHEN {_like(('.edu', '.ac.'), 'h')} THEN 'Research Institute' WHEN {_like(('journal', 'springer', 'ieee', 'sciencedirect', 'nature', 'academic', 'researchgate'), 'h', 'u')} THEN 'Journal' WHEN {_like(('thinktank', 'brookings', 'rand', 'csis', 'chathamhouse', 'cfr', 'rusi', 'sipri', 'iiss', 'lowyinstitute'), 'h', 'u')} THEN 'Think Tank' ELSE 'News' END"


def _geo(names) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(x, '\\b{n.lower()}\\b') THEN '{n}' END" for n in names)


_MOODS = {"p": ("tion", "ment", "ther"), "n": ("que", "sch", "ciado", "sea")}
_TOPICS = {"Alpha": ("ciado", "osció"), "Beta": ("sch", "keit"), "Gamma": ("sea", "thion")}


@query(f"SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN th = '' THEN 'General' ELSE th END AS theme FROM (SELECT doc_id, {', '.join(' + '.join(f'''CAST(contains(lower(text), '{w}') AS INT)''' for w in ws) + f' {k}' for k, ws in _MOODS.items())}, array_to_string(list_filter([{', '.join(f'''CASE WHEN {_like(w, 'lower(text)')} THEN '{k}' END''' for k, w in _TOPICS.items())}], lambda z: z IS NOT NULL), ', ') th FROM documents)")
def doc_sentiment_theme(spark, d):
    none = F.lit(None).cast("string")
    return _t(spark, d, "documents").select("doc_id", C.sentiment(none, F.col("text"), _MOODS["p"], _MOODS["n"]).alias("sentiment"), C.subject_theme(none, F.col("text"), _TOPICS).alias("theme"))


@query(f"SELECT page_id, {_SOURCE} AS source_type FROM (SELECT page_id, lower(url) u, {_DOMAIN.format('url')} h FROM pages)")
def page_source_type(spark, d):
    return _t(spark, d, "pages").select("page_id", C.source_type(F.col("url")).alias("source_type"))


# ---- pages -----------------------------------------------------------------------------------

_LINKS = r"""l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 pos FROM pages),
 k AS (SELECT page_id, url, CAST(pos AS BIGINT) pos, href, coalesce(CASE WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href WHEN regexp_matches(href, '^https?://') THEN href END, href) link FROM l)"""


@query(f"WITH {_LINKS} SELECT page_id, pos, href, link FROM k")
def page_links(spark, d):
    return P.links(_t(spark, d, "pages")).select("page_id", "pos", "href", "link")


@query(f"""WITH {_LINKS} SELECT page_id, link FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) n FROM k WHERE {_DOMAIN.format('link')} = {_DOMAIN.format('url')}
 AND NOT ({' OR '.join(f"ends_with(lower({_PATH.format('link')}), '{e}')" for e in _SQL_STATIC)})) WHERE n <= 100""")
def link_expansion_top100(spark, d):
    rows = P.links(_t(spark, d, "pages"))
    same = (U.domain(F.col("link")) == U.domain(F.col("url"))) & ~U._ends_with_any(F.lower(U.path(F.col("link"))), U.STATIC_ENDINGS)
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.where(same).withColumn("n", nth).where("n <= 100").select("page_id", "link")


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<p>([^<]*)</p>', 1))) AS paragraph FROM pages")
def page_paragraphs(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1))).alias("paragraph"))


@query()
def page_extract(spark, d):
    e = html.extracted(F.col("html"), F.col("url"))
    return _t(spark, d, "pages").select("page_id", e.alias("e")).select("page_id", "e.title", "e.lang", F.length("e.body").cast("bigint").alias("body_chars"), F.size("e.links").cast("bigint").alias("n_links"), F.size("e.paragraphs").cast("bigint").alias("n_paragraphs"), F.length("e.markdown").cast("bigint").alias("markdown_chars"))


@query()
def page_nested_document(spark, d):
    e = html.extracted(F.col("html"), F.col("url"))
    meta = F.struct("e.title", "e.description", F.col("e.lang").alias("language"), F.col("url").alias("sourceURL"), F.lit(200).alias("statusCode"))
    content = F.struct("e.headings", "e.paragraphs", "e.lists", "e.tables", F.col("e.code").alias("codeBlocks"), "e.quotes")
    doc = F.struct(F.lit(True).alias("success"), F.struct("e.markdown", "html", meta.alias("metadata"), "e.links", "e.images", "e.videos", content.alias("content")).alias("data"))
    return _t(spark, d, "pages").select("page_id", "url", "html", e.alias("e")).select("page_id", F.to_json(doc).alias("document"))


# ---- joins, sets, windows --------------------------------------------------------------------


@query("SELECT url FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def frontier_new_urls(spark, d):
    pages = _t(spark, d, "pages")
    return pages.where("page_id % 2 = 0").select("url").join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti").distinct()


@query("SELECT url, min(seq) AS seq FROM (SELECT url, page_id * 2 AS seq FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id * 2 + 1 AS seq FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def candidate_union_dedup(spark, d):
    pages = _t(spark, d, "pages")
    both = pages.where("page_id % 2 = 0").select("url", (F.col("page_id") * 2).alias("seq")).unionByName(pages.where("page_id % 3 = 0").select("url", (F.col("page_id") * 2 + 1).alias("seq")))
    return both.groupBy("url").agg(F.min("seq").alias("seq"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_matched(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT l.doc_id, CAST(l.quality AS BIGINT) AS quality, d.source FROM labels l JOIN documents d USING (doc_id)")
def join_foreign_key(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").cast("bigint").alias("quality"), "source")


_KW = [("ther", "g1"), ("keit", "g2"), ("ciado", "g3")]


@query(f"SELECT keyword, label, count(*) AS n FROM documents JOIN {_values(_KW, 'keyword, label')} ON contains(lower(text), keyword) GROUP BY 1, 2")
def keyword_page_matrix(spark, d):
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(k)), F.lit(k)) for k, _ in _KW]))
    found = _t(spark, d, "documents").select(F.explode(hits).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(_literal(spark, _KW, "keyword, label")), "keyword").select("keyword", "label", "n")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'skipped' END"


@query(f"SELECT coalesce({_STATUS}, 'total') AS status, count(*) AS n FROM events GROUP BY ROLLUP ({_STATUS})")
def status_breakdown(spark, d):
    rows = _t(spark, d, "events").select(P.status_of(F.col("event_type")).alias("s"))
    return rows.rollup("s").agg(F.count("*").alias("n")).select(F.coalesce("s", F.lit("total")).alias("status"), "n")


@query("SELECT CASE WHEN length(m) > 63 THEN left(m, 60) || '...' ELSE m END AS reason, count(*) AS n FROM (SELECT coalesce(CASE WHEN value > 50 THEN repeat('x', 64) || CAST(user_id % 3 AS VARCHAR) WHEN value > 20 THEN props END, 'Unknown Error') m FROM events WHERE event_type = 'error') GROUP BY 1")
def failure_reasons(spark, d):
    message = F.coalesce(F.when(F.col("value") > 50, F.concat(F.repeat(F.lit("x"), 64), (F.col("user_id") % 3).cast("string"))).when(F.col("value") > 20, F.col("props")), F.lit("Unknown Error"))
    rows = _t(spark, d, "events").where("event_type = 'error'").select(T.truncated(message, 63, 60).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type <> 'signup') AS crawled, count(*) FILTER (WHERE event_type = 'purchase') AS matched FROM events GROUP BY user_id")
def job_progress(spark, d):
    status = P.status_of(F.col("event_type"))
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(status != "pending").alias("crawled"), F.count_if(status == "matched").alias("matched"))


@query("SELECT count(*) AS runs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed, count(DISTINCT o_custkey) AS owners FROM orders")
def dashboard_totals(spark, d):
    return _t(spark, d, "orders").agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.countDistinct("o_custkey").alias("owners"))


@query(f"SELECT doc_id, s AS score, total FROM (SELECT doc_id, {_counts('text', ('the',))} s, count(*) OVER () total FROM documents WHERE {_counts('text', ('the',))} >= 2) ORDER BY s DESC, doc_id LIMIT 50 OFFSET 50")
def results_page(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", K.occurrences(F.col("text"), "the").alias("score"))
    return P.results_page(rows, [F.col("score").desc(), F.col("doc_id")], page=2, limit=50, where=F.col("score") >= 2)


@query("""SELECT doc_id AS "ID", source AS "Domain", left(text, 200) AS "Title", n_chars AS "Occurrences", upper(lang) AS "Language" FROM documents WHERE contains(lower(text), 'the') AND source <> 'src3'""")
def export_projection(spark, d):
    rows = _t(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("the")) & (F.col("source") != "src3"))
    return rows.select(F.col("doc_id").alias("ID"), F.col("source").alias("Domain"), F.left("text", F.lit(200)).alias("Title"), F.col("n_chars").alias("Occurrences"), F.upper("lang").alias("Language"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_id % 2 = 1), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events WHERE event_id % 2 = 0)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(o.event_id, n.event_id) AS created_at FROM (SELECT * FROM n WHERE r = 1) n FULL JOIN (SELECT * FROM o WHERE r = 1) o ON n.user_id = o.user_id""")
def upsert_latest(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("created_at"))
    old = D.latest_per_key(events.where("created_at % 2 = 0"), "user_id", [F.col("created_at")])
    return D.upsert(old, events.where("created_at % 2 = 1"), key="user_id", keep="created_at", order=[F.col("created_at").desc()])


@query("SELECT r_name AS grp, array_to_string(list_sort(list(n_name)), ',') AS members, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_collect(spark, d):
    rows = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("grp")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"), F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, CAST(sum(CASE WHEN text = prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) stops FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) prev FROM conversations)) WHERE stops = 0")
def repeat_page_stop(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumn("same", F.coalesce((F.col("text") == F.lag("text").over(w)).cast("int"), F.lit(0)))
    return rows.withColumn("stops", F.sum("same").over(w)).where("stops = 0").select("conv_id", "turn")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * CAST(1 AS DOUBLE) AS wait FROM events")
def domain_spacing(spark, d):
    rows = numbered(_t(spark, d, "events").select("event_id", "user_id"), ["event_id"], ["user_id"], "nth", 0)
    return rows.select("event_id", "user_id", (F.col("nth") * F.lit(1.0)).cast("double").alias("wait"))


@query("SELECT event_id FROM events WHERE value > 10 AND (ts IS NULL OR (ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-20'))")
def date_range_filter(spark, d):
    as_of = F.lit("2024-01-20").cast("timestamp")
    return _t(spark, d, "events").where((F.col("value") > 10) & Q.date_allowed(F.col("ts").cast("timestamp"), as_of, end=as_of, days=10)).select("event_id")


# ---- discovery -------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_EDGES = "e AS (SELECT CAST(o_custkey AS VARCHAR) src, CAST(o_custkey + 1 + o_orderkey % 97 AS VARCHAR) dst FROM orders GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_EDGES}, r(url, depth) AS (SELECT '1', CAST(0 AS BIGINT) UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def bfs_depth(spark, d):
    edges = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("src"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 97).cast("string").alias("dst")).distinct()
    return feeds.breadth_first(edges, spark.createDataFrame([("1",)], "url string"), 4)


# ---- streams, as the batch plans they must equal ---------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_progress_tumbling(spark, d):
    rows = S.progress(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT user_id, count(*) AS n_sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM
 (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END g FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def stream_sessions(spark, d):
    rows = S.sessions(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return S.first_events(_t(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])
