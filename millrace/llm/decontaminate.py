"""Benchmark decontamination: Wu-Manber search for the word windows of test items.

A text is a sequence of words. Every window of 13 consecutive words of an item is a pattern (an
item with fewer words is one shorter pattern). For each pattern length the search keeps a shift
table over blocks of two words, which skips positions where no pattern can end; a block that ends
some pattern selects a bucket, keyed by the block and checked by the hash of the pattern's first
words, and a word-by-word comparison confirms the occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, texts_of

WINDOW = 13
#: Patterns of so many bytes of item text are broadcast at once; larger benchmarks are searched in blocks.
BLOCK_BYTES = 16 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return text.translate(_WORDS).split()


class _Group:
    """Patterns of one length."""

    def __init__(self, length: int):
        self.length, self.width = length, min(2, length)
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        self.shift: dict = {}
        self.buckets: dict = {}

    def build(self) -> None:
        m, b = self.length, self.width
        for p in self.items:
            for end in range(b, m + 1):
                block = p[end - b : end] if b == 2 else p[end - 1]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            last = p[m - b :] if b == 2 else p[m - 1]
            self.buckets.setdefault(last, {}).setdefault(hash(p[:2]), []).append((list(p), tuple(self.items[p])))

    def search(self, words: list[bytes], found: list) -> None:
        """Appends (start, end, items) of every occurrence."""
        m, b, n, i = self.length, self.width, len(words), self.length
        shift, most = self.shift, self.length - self.width + 1
        head = min(2, m)
        while i <= n:
            block = (words[i - 2], words[i - 1]) if b == 2 else words[i - 1]
            s = shift.get(block, most)
            if s:
                i += s
                continue
            start = i - m
            for p, items in self.buckets[block].get(hash((*words[start : start + head],)), ()):
                if words[start:i] == p:
                    found.append((start, i, items))
            i += 1


class WuManber:
    """Patterns of all lengths, from (item id, text) pairs."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        groups: dict[int, _Group] = {}
        for item, text in items:
            words = words_of(text or b"")
            if item is None or not words:
                continue
            length = min(window, len(words))
            group = groups.setdefault(length, _Group(length))
            for i in range(len(words) - length + 1):
                group.items[tuple(words[i : i + length])].add(item)
        self.groups = [groups[k] for k in sorted(groups)]
        for g in self.groups:
            g.build()

    def search(self, words: list[bytes]) -> tuple[int, set]:
        """Number of words inside any occurrence, and the items that occur."""
        found: list = []
        for g in self.groups:
            g.search(words, found)
        return covered([(a, b) for a, b, _ in found]), {x for _, _, items in found for x in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in merged(spans))


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of a checked size."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    The benchmark is searched in blocks of about ``block_bytes``; each block is collected and
    broadcast on its own, and the spans found so far travel with the documents, so neither
    side's size is bounded. Null and empty texts have no words; items with null id or text have
    no windows; repeated rows give repeated results; extra columns are ignored.
    """
    rows = _searched(docs.select(F.struct("doc_id").alias("row"), "text"), benchmark, window, block_bytes)
    return rows.select("row.doc_id", *_JUDGED)


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """row, and what the whole benchmark finds in each text, for rows (row, text)."""
    rows = rows.withColumn("found", F.lit(None).cast("array<struct<a:long,b:long>>")).withColumn("items", F.lit(None).cast("array<string>"))
    blocks = _blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):
        rows = _search_block(rows, [(r[0], (r[1] or "").encode()) for r in block.collect()], window, k + 1 == len(blocks))
        if k + 1 < len(blocks):
            rows = materialize(rows, "decontaminate")
    return rows


_JUDGED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_RESULT = T.StructType([T.StructField(n, k) for n, k in zip(_JUDGED, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()))])
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _search_block(rows: DataFrame, items: list, window: int, last: bool) -> DataFrame:
    """Adds what one block of items finds to found and items; the last block gives the result."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        patterns = WuManber(shared.value, window)
        for batch in batches:
            found, ids = batch.column("found").to_pylist(), batch.column("items").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for k, text in enumerate(texts_of(batch.column("text"))):
                hits: list = []
                words = words_of(text)
                for g in patterns.groups:
                    g.search(words, hits)
                spans, own = [(x["a"], x["b"]) for x in found[k] or ()], set(ids[k] or ())
                if hits:
                    spans = merged(spans + [(a, b) for a, b, _ in hits])
                    own |= {str(x) for _, _, some in hits for x in some}
                if last:
                    hit, names = covered(spans), sorted(own)
                    for c, v in zip(out, (len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= len(words))):
                        c.append(v)
                else:
                    found[k], ids[k] = [{"a": a, "b": b} for a, b in spans], sorted(own)
            if last:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, out, kinds)], names=["row", *_JUDGED])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(found, _SPANS), pa.array(ids, pa.list_(pa.string()))], names=["row", "text", "found", "items"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *_RESULT]) if last else rows.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs, all columns, that are not contaminated by the rule of contamination()."""
    spark, blocks = docs.sparkSession, _blocks(benchmark, block_bytes)
    if len(blocks) > 1:  # the rule adds up hits of all blocks, so each row travels whole
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
        return _searched(rows, benchmark, window, block_bytes).where("not contaminated").select("row.*")
    shared = spark.sparkContext.broadcast([(r[0], (r[1] or "").encode()) for r in blocks[0].collect()])

    def run(batches):
        patterns = WuManber(shared.value, window)
        for batch in batches:
            keep = []
            for text in texts_of(batch.column("text")):
                words = words_of(text)
                hit, _ = patterns.search(words)
                keep.append(not (hit > 0 and 20 * hit >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
