"""Chunks of documents that exchange what they hold with buckets of keys.

Corpus-wide statistics of words or word sequences are found in three steps: each chunk of some
hundred documents sends its distinct keys, packed, to the buckets that own them; a bucket answers
every chunk in the order it was asked; the chunk, computed again from the same documents, reads the
answers. Nothing repeated inside a chunk is sent twice, so a key that a third of all documents
hold costs a bucket one entry for each chunk at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

CHUNK_DOCS = 512
#: There is a bucket for so many documents, so what one holds does not grow with the input, but so many at least.
LEAST_BUCKETS = 256


def chunked(docs: DataFrame, size: int | None = None) -> tuple[DataFrame, int, int]:
    """doc_id, text and chunk of each row, and how many chunks and buckets there are. Rows of one doc_id with different texts may be in different chunks."""
    rows = docs.select("doc_id", "text")
    total = rows.count()
    n, least = max(1, -(-total // (size or CHUNK_DOCS))), -(-total // CHUNK_DOCS)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n, max(LEAST_BUCKETS, least)


def documents_of(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """The documents of a chunk in a fixed order: by doc_id (null first), then text."""
    found = zip(table.column("doc_id").to_pylist(), texts_of(table.column("text").combine_chunks()))
    return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def by_bucket(keys: Iterable[bytes], n: int) -> dict[int, list[bytes]]:
    """Keys by bucket, in the given order."""
    out: dict[int, list[bytes]] = {}
    for k in keys:
        out.setdefault(zlib.crc32(k) % n, []).append(k)
    return out
