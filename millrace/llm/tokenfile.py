"""Token files: ids of whole texts in ascending doc_id order, coded by the range coder.

A file is Parquet, so that any store Spark knows can hold it, with a row for each segment: which
part and place it has in the order, its documents and their lengths, and its coded blocks, each
with a checksum and a model of its own. What is coded are the ids of a segment's distinct phrases
(words, as the encoder cuts them), the most frequent first, then the number of each phrase in the
order of the texts. A segment is read without any other.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blob, ragged, scratch_dir, slices
from .rangecoder import MOST_BITS, decode_blocks, encode_blocks
from .tokens import default_vocabulary, encoder, forget_pieces

END = 0
#: Documents of a part, parts of a table at most (their sizes are collected and broadcast; larger tables have larger parts), and bytes of text after which a segment closes.
PART_DOCS, MOST_PARTS, SEGMENT_BYTES = 6144, 1 << 16, 20 << 20
#: Phrases that are looked up at once, and documents that leave a reading task at once.
_STEP, _ROWS = 1 << 20, 1024
_NULL_ID = -(1 << 63)
_SCHEMA = "part int, segment int, start long, n_ids long, doc_ids binary, lengths binary, sizes binary, n_coded long, blocks array<binary>, checks array<long>"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))


def _bits(phrases: int) -> int:
    return max(16, phrases.bit_length())


def _expanded(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the numbered phrases."""
    out, at = np.empty(n, "<u4"), 0
    for lo in range(0, len(numbers), _STEP):
        own = ids.take(ragged(sizes, numbers[lo : lo + _STEP]))
        out[at : at + len(own)] = own
        at += len(own)
    return out


def code_segment(phrases: list[bytes], numbers: np.ndarray, most: int = 1 << MOST_BITS) -> tuple[np.ndarray, int, list[bytes], list[int]]:
    """How many ids each phrase has, how many values are coded, and their blocks and checksums.

    A segment of so many phrases or more is coded by its ids, a phrase for each.
    """
    sizes, ids = np.array(list(map(len, phrases)), np.int64) // 4, np.frombuffer(b"".join(phrases), "<u4")
    if len(phrases) >= most:
        ids, numbers = np.unique(_expanded(ids, sizes, numbers, int(sizes[numbers].sum())), return_inverse=True)
        sizes = np.ones(len(ids), np.int64)
    order = np.argsort(-np.bincount(numbers, minlength=len(sizes)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    stream = np.concatenate([ids.take(ragged(sizes, order)), rank.take(numbers)]).astype(np.uint32)
    blocks, checks = encode_blocks(stream, _bits(len(sizes)))
    return sizes[order].astype(np.int32), len(stream), blocks, checks


def decode_segment(sizes: np.ndarray, n_coded: int, blocks: list[bytes], checks: list[int], n_ids: int) -> np.ndarray:
    """The ids of a segment."""
    stream, sizes = decode_blocks(blocks, n_coded, checks, _bits(len(sizes))), sizes.astype(np.int64)
    first = int(sizes.sum())
    return _expanded(stream[:first], sizes, stream[first:], n_ids)


def write_tokens(docs: DataFrame, path: str, end: int = END, vocabulary: str | None = None) -> None:
    """Write the ids of docs (doc_id, text), each with the end id, into token files below path; ids are below 65536.

    Documents are sorted by doc_id, null first, then text; null texts are the end id alone.
    """
    rows = docs.select("doc_id", "text")
    parts = min(MOST_PARTS, max(1, -(-rows.count() // PART_DOCS)))
    tail, vocabulary = end.to_bytes(4, "little"), vocabulary or default_vocabulary()

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        state = {"segment": 0, "start": 0, "size": 0}

        def close():
            docs, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            held.clear()
            phrases, numbers, counts = enc.phrases(texts.fill_null(""))
            del texts
            pa.default_memory_pool().release_unused()
            numbers = np.insert(numbers, np.cumsum(counts), len(phrases))
            phrases.append(tail)
            ends = np.cumsum(np.array(list(map(len, phrases)), np.int64)[numbers] // 4)[np.cumsum(counts + 1) - 1]
            sizes, coded, blocks, checks = code_segment(phrases, numbers)
            row = [part, state["segment"], state["start"], int(ends[-1]), blob(docs.cast(pa.int64()).fill_null(_NULL_ID).to_numpy()), blob(np.diff(ends, prepend=0)), blob(sizes), coded, blocks, checks]
            state.update(segment=state["segment"] + 1, start=state["start"] + int(ends[-1]), size=0)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _KINDS)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for lo, hi in slices(lengths, SEGMENT_BYTES):
                held.append(batch.slice(lo, hi - lo))
                state["size"] += int(lengths[lo:hi].sum())
                if state["size"] >= SEGMENT_BYTES:
                    yield close()
        if held:
            yield close()

    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) from token files."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first = dict(zip([p for p, _ in sizes], np.concatenate(([0], np.cumsum([n for _, n in sizes], dtype=np.int64)))[:-1].tolist() if sizes else []))
    shared = spark.sparkContext.broadcast(first)

    def run(batches):
        forget_pieces()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = decode_segment(np.frombuffer(row["sizes"], np.int32), row["n_coded"], row["blocks"], row["checks"], row["n_ids"])
                docs, ends = np.frombuffer(row["doc_ids"], np.int64), np.cumsum(np.concatenate(([0], np.frombuffer(row["lengths"], np.int64))))
                for lo in range(0, len(docs), _ROWS):
                    own, at = docs[lo : lo + _ROWS], ends[lo : lo + _ROWS + 1]
                    data = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(4 * (at - at[0])), pa.py_buffer(ids[at[0] : at[-1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == _NULL_ID), pa.array(shared.value[row["part"]] + row["start"] + at[:-1]), data.cast(pa.binary())], names=["doc_id", "start", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def token_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of docs, from token files written and read back.

    Null and empty texts are the end id alone; a null doc_id comes first; repeated rows follow each
    other; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary=vocabulary)

    found = read_tokens(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
