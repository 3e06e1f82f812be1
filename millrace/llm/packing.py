"""Sequence packing: bounded-space online best-fit.

Documents become token ids plus an end id; those beyond the capacity are cut so that only their
first piece is shorter. Short pieces meet a fixed number of open bins, kept in a bitset keyed by
free space: a piece goes to the bin with the least free space that takes it; where none does and
all bins are in use, the fullest bin closes.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, strings_of
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Open bins of a packing task.
OPEN_BINS = 1024
#: Pieces that one packing task takes about.
PIECES_A_TASK = 100_000
END = 2


class BestFit:
    """Open bins by free space. ``add`` gives (bin, offset) of a piece."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.mask, self.by_space, self.count, self.next = 0, [deque() for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        own = self.by_space[space]
        out = own.popleft()
        if not own:
            self.mask &= ~(1 << space)
        self.count -= 1
        return out

    def add(self, size: int) -> tuple[int, int]:
        fits = self.mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.count >= self.most:  # the fullest closes
                self._take((self.mask & -self.mask).bit_length() - 1)
            space, chosen = self.capacity, self.next
            self.next += 1
        left = space - size
        if left:
            self.by_space[left].append(chosen)
            self.mask |= 1 << left
            self.count += 1
        return chosen, self.capacity - space


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    path = vocabulary or default_vocabulary()
    tail = end.to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, own in zip(batch.column("doc_id").to_pylist(), enc.each(strings_of(batch.column("text")))):
                ids = own + tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity)
                    for c, v in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt by a hash, so each task gets a like mix of lengths; a task's last open bins
    are the only ones that may stay badly filled. Null and empty texts are the end id alone;
    repeated rows are packed once each; an empty table gives no rows; extra columns are ignored.
    """
    pieces = materialize(pieces_of(docs, capacity, end, vocabulary), "pieces")
    n = pieces.count()
    tasks = max(1, -(-n // PIECES_A_TASK))
    key = F.xxhash64("doc_id", "piece")
    dealt = pieces.withColumn("deal", F.pmod(key, F.lit(1 << 20))).repartition(tasks, "deal").sortWithinPartitions("deal", "doc_id", "piece", "ids_crc32")

    def run(batches):
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.add(s) for s in batch.column("length").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
