"""Target-distribution importance resampling, in DataFrame functions alone.

Words of a text give runs of 1 to ``orders`` words; a run's bucket is its crc32 modulo ``buckets``. A
bucket's gain says how much likelier the target makes it than the raw documents do. A document
weighs the mean gain of its runs, gets a fixed Gumbel noise from its id, and the highest sums are
drawn. Ranks come from one range exchange: a row's place in its partition plus the rows of the
partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 10_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The lower bits of a generated id count the rows of a partition.
_PLACE = (1 << 33) - 1


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none where it is null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _runs(own: str, orders: int) -> Column:
    if orders == 1:
        return F.col(own)
    of = lambda n: f"transform(if(size({own}) >= {n}, sequence(1, size({own}) - {n} + 1), array()), i -> array_join(slice({own}, cast(i as int), {n}), ' '))"
    return F.expr("concat(" + ", ".join([own, *(of(n) for n in range(2, orders + 1))]) + ")")


def features(docs: DataFrame, orders: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, n_words, and the bucket of each run of each text."""
    cut = docs.select(*keep, words(F.col("text")).alias("_words"))
    return cut.select(*keep, F.size("_words").cast("long").alias("n_words"), F.transform(_runs("_words", orders), lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")).alias("buckets"))


def _counted(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain for every bucket, from tables with the column ``buckets``."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_counted(raw, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("None")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def weighted(docs: DataFrame, target: DataFrame, seed: int, orders: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; rows of one id are kept apart by ``row``."""
    found = materialize(features(docs, orders, buckets, ("doc_id",)).withColumn("row", F.monotonically_increasing_id()), "features")
    table = gains(found, features(target, orders, buckets), buckets)
    # runs of one row are next to each other, so they are summed before the exchange
    sums = found.select("row", F.explode("buckets").alias("bucket")).join(F.broadcast(table), "bucket").groupBy("row").agg(F.sum("gain").alias("total"))
    rows = found.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features")).join(sums, "row", "left")
    weight = F.expr("case when n_features > 0 then (total - pmod(total, n_features)) div n_features else 0 end")
    return rows.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("total")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with ``rank`` 1, 2, 3... in the given order, which must tell all rows apart."""
    sorted_rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    at = sorted_rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit(_PLACE))).drop("_id")
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition of the exchange
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, seed: int = 2024, percent: int = 10, least_words: int = 20, orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text) against target (text).

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores
    are drawn and ranked, ties to the smaller doc_id (null first); rank is null elsewhere. Null and empty texts have no
    words and weight 0; a null id's noise is that of the text ``None``; repeated rows are drawn as rows of their own; an empty
    table gives no rows, and an empty target is one with no counts; other columns are ignored.
    """
    rows = weighted(docs, target, seed, orders, buckets)
    long_enough = F.col("n_words") >= least_words
    # short rows sort behind all others, so ranks of the others are not moved
    ranked = numbered(rows.withColumn("short", ~long_enough), F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc())
    drawn = ranked.agg(F.floor(F.coalesce(F.sum(long_enough.cast("long")), F.lit(0)) * percent / 100).cast("long").alias("drawn"))
    return ranked.crossJoin(F.broadcast(drawn)).select("doc_id", "n_features", "weight", "score", F.when(long_enough & (F.col("rank") <= F.col("drawn")), F.col("rank")).alias("rank"))


#: DuckDB SQL of resample() with its defaults. crc32 goes byte by byte over the distinct words.
RESAMPLE_SQL = r"""
WITH RECURSIVE steps AS (SELECT range AS v, 0 AS k, range::BIGINT AS c FROM range(256)
    UNION ALL SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS crcs FROM steps WHERE k = 8),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bench_words AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
raw AS (SELECT doc_id, unnest(ws) AS w FROM doc_words),
target AS (SELECT unnest(ws) AS w FROM bench_words),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM raw UNION SELECT w FROM target)),
crc AS (SELECT w, h, 0 AS k, 4294967295::BIGINT AS c FROM vocabulary
    UNION ALL SELECT w, h, k + 1, xor(crcs[(xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255) + 1], c >> 8) FROM crc, crc_table WHERE 2 * k < length(h)),
bucket_of AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * k = length(h)),
s AS (SELECT bucket, count(*) AS s FROM raw JOIN bucket_of USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN bucket_of USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM raw)::DOUBLE AS all_s, (SELECT count(*) FROM target)::DOUBLE AS all_t),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM raw JOIN bucket_of USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM doc_words d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
