"""Exact and near duplicates of page texts: content hash, 64-bit SimHash, and first-kept-wins resolution."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lazy import arrow_udf
from ..functions.text import content_hash
from ..session import released, written

BITS, NEAR = 64, 3
#: Blocks of the fingerprint. Three differing bits leave three of six blocks alike, so each choice of
#: three blocks is a table with keys of about 32 bits, and buckets stay small at any size.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


#: Words of so many characters vote alone where they are enough; shorter ones join as long as they are not.
_LONG = 5
_MARKS = regex.compile(r"\p{P}")


def _voters(text: str) -> list[str]:
    """The alphanumeric words that vote: of the greatest least length, up to _LONG, that leaves half as many as there are bits; else all."""
    words = [w for w in _MARKS.sub(" ", text).split() if w.isalnum()]
    if not words:
        return words
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at_least = np.bincount(np.minimum(lengths, _LONG), minlength=_LONG + 1)[::-1].cumsum()[::-1]  # words by least length
    enough = np.flatnonzero(2 * at_least >= BITS)
    return [words[i] for i in np.flatnonzero(lengths >= enough[-1])] if len(enough) else words


def simhash_values(texts: list[str | None]) -> list[int | None]:
    """Fingerprints as signed 64-bit numbers; null below 30 characters or without words. Each distinct word of the texts is hashed once."""
    number: dict[str, int] = {}
    votes = [[number.setdefault(w, len(number)) for w in _voters(t)] if t and len(t.strip()) >= 30 else [] for t in texts]
    digests = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest() for w in number)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
    out: list[int | None] = []
    for own in votes:
        # a bit is set if at least half of the votes have it
        out.append(int.from_bytes(np.packbits(2 * bits[own].sum(axis=0, dtype=np.int64) >= len(own)).tobytes(), "big", signed=True) if own else None)
    return out


@arrow_udf("bigint")
def simhash(text: pd.Series) -> pd.Series:
    texts, found = text.tolist(), []
    for lo in range(0, len(texts), 512):
        found += simhash_values(texts[lo : lo + 512])
    return pd.Series(found, dtype="Int64")


def simhash_text(value: Column) -> Column:
    """The fingerprint as unpadded hex; empty where there is none."""
    return F.coalesce(F.lower(F.hex(value)), F.lit(""))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 999 where a fingerprint is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def block_tables(value: str) -> list[Column]:
    """The struct (t, v) of each table of blocks: number and key of a fingerprint column."""

    def block(start: int, width: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(F.col(value), 64 - start - width), 64 - width)

    return [F.struct(F.lit(k).alias("t"), sum((block(*BLOCKS[b]) * (1 << 11 * i) for i, b in enumerate(c)), F.lit(0).cast("bigint")).alias("v")) for k, c in enumerate(itertools.combinations(range(6), 3))]


def near_pairs(prints: DataFrame, value: str = "simhash", key: str = "id", most: int = NEAR) -> DataFrame:
    """Pairs a < b of rows whose fingerprints differ in at most three bits: complete, by equi-joins on blocks."""
    # written once: both sides of the join, and each table, would compute the fingerprints again
    known = written(prints.select(F.col(key).alias("id"), F.col(value).alias(value)), "prints")
    rows = known.where(F.col(value).isNotNull()).select("id", F.col(value).alias("p")).select("id", "p", F.explode(F.array(*block_tables("p"))).alias("x")).select("id", "p", "x.t", "x.v")
    other = rows.select(F.col("id").alias("b"), F.col("p").alias("q"), "t", "v")
    differ = F.col("p").bitwiseXOR(F.col("q"))
    # of the tables that a pair shares, the first gives it: the one of the three first blocks that are alike
    alike = F.filter(F.array(*[F.when(F.shiftrightunsigned(F.shiftleft(differ, 64 - start - width), 64 - width) == 0, F.lit(k)) for k, (start, width) in enumerate(BLOCKS)]), lambda k: k.isNotNull())
    numbers = F.create_map(*[F.lit(x) for k, c in enumerate(itertools.combinations(range(6), 3)) for x in ("".join(map(str, c)), k)])
    first = F.element_at(numbers, F.array_join(F.slice(alike, 1, 3), ""))
    # by a shuffle: the plan takes a side for as small as its file, and would send its twenty rows for each fingerprint through the driver
    found = rows.withColumnRenamed("id", "a").hint("merge").join(other, ["t", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= most) & (F.col("t") == first))
    return found.select("a", "b", F.bit_count(differ).cast("bigint").alias("distance"))


def near_links(prints: DataFrame, value: str = "simhash", key: str = "id", most: int = NEAR) -> DataFrame:
    """The near pairs of rows with a fingerprint, as links: each row to the first row of its fingerprint
    (distance 0), and the first rows of near fingerprints to each other. Rows are near if their first rows
    are the same or linked, so nothing is lost, and equal rows cost one link each, not one for each pair.
    """
    known = written(prints.select(F.col(key).alias("id"), F.col(value).alias(value)).where(F.col(value).isNotNull()), "prints")
    firsts = written(known.groupBy(value).agg(F.min("id").alias("first")), "firsts")
    members = known.join(firsts, value).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("distance"))
    return near_pairs(firsts, value, "first", most).unionByName(members)


def exact_duplicates(rows: DataFrame, text: str = "text", order: str = "doc_id", scope: list[str] | None = None) -> DataFrame:
    """Adds content_hash and is_duplicate: an earlier row of the scope has the same hash."""
    hashed = rows.withColumn("content_hash", content_hash(F.col(text)))
    first = hashed.groupBy(*(scope or []), "content_hash").agg(F.min(order).alias("_first"))
    return hashed.join(first, [*(scope or []), "content_hash"]).withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")


def first_kept(rows: DataFrame, text: str = "text", order: str = "doc_id", print_column: str | None = None) -> DataFrame:
    """order, content_hash, simhash and is_duplicate by the sequential rule: a row is a duplicate if an
    earlier *kept* row has its hash or a fingerprint within three bits.

    Rows equal in hash and fingerprint share the fate of their first, or repeat it. Among those firsts, a round asks of each
    fingerprint and each hash for its first kept and its first undecided row, and near fingerprints, as distinct values, exchange what they know; so rows of one
    fingerprint are never paired. A row with an earlier kept one is dropped, one without an earlier undecided one is kept, the others wait for the next round.
    """
    value = F.col(print_column) if print_column else simhash(F.col(text))
    hashed = written(rows.select(F.col(order).alias("id"), content_hash(F.col(text)).alias("content_hash"), value.alias("simhash")), "prints")
    same = F.struct("content_hash", F.coalesce(F.col("simhash").cast("string"), F.lit("")))
    waiting = written(hashed.groupBy(same.alias("k")).agg(F.min("id").alias("id"), F.first("content_hash").alias("content_hash"), F.first("simhash").alias("simhash")).drop("k"), "firsts")
    values = waiting.where("simhash is not null").select("simhash").distinct()
    pairs = near_pairs(values.select("simhash", F.col("simhash").alias("id"))).select("a", "b")
    near = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(values.select(F.col("simhash").alias("a"), F.col("simhash").alias("b"))), "near")
    kept = waiting.sparkSession.createDataFrame([], waiting.schema)
    while True:
        none = F.lit(None).cast(waiting.schema["id"].dataType)
        both = waiting.withColumns({"open": F.col("id"), "kept": none}).unionByName(kept.withColumns({"open": none, "kept": F.col("id")}))
        firsts = [F.min("open").alias("open"), F.min("kept").alias("kept")]
        own = both.where("simhash is not null").groupBy(F.col("simhash").alias("b")).agg(*firsts)
        by_print = near.join(own, "b").groupBy(F.col("a").alias("simhash")).agg(F.min("open").alias("open_near"), F.min("kept").alias("kept_near"))
        by_hash = both.groupBy("content_hash").agg(*firsts)
        known = waiting.join(by_hash, "content_hash").join(by_print, "simhash", "left")
        dropped, open_before = (F.coalesce(F.least(a, b) < F.col("id"), F.lit(False)) for a, b in (("kept", "kept_near"), ("open", "open_near")))
        state = written(known.select("id", "content_hash", "simhash", F.when(dropped, F.lit("dropped")).when(open_before, F.lit("waiting")).otherwise(F.lit("kept")).alias("fate")), "state")
        kept = kept.unionByName(written(state.where("fate = 'kept'").drop("fate"), "kept"))
        rest = written(state.where("fate = 'waiting'").drop("fate"), "waiting")
        released(state, waiting)
        waiting = rest
        if waiting.isEmpty():
            break
    released(near)
    decided = kept.select("id", F.lit(True).alias("_kept"))
    return hashed.join(decided, "id", "left").select(F.col("id").alias(order), "content_hash", "simhash", F.col("_kept").isNull().alias("is_duplicate"))


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that comes first in the order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", at).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str = "url", keep: str = "created_at", order: list[Column] | None = None) -> DataFrame:
    """Keyed overwrite: new rows replace old ones but keep their ``keep`` column; the last of several new rows wins."""
    latest = latest_per_key(new, key, order or [F.col(keep).desc()])
    old = existing.select(key, F.col(keep).alias("_old"))
    merged = latest.join(old, key, "left").withColumn(keep, F.coalesce("_old", keep)).drop("_old")
    return existing.join(latest.select(key), key, "left_anti").unionByName(merged.select(*existing.columns))
