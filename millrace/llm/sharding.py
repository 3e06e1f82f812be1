"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id), so equal texts stand together. The splitters
between shards are found by counting: each round counts the exact bytes below a set of candidate
keys over all partitions and narrows every splitter's interval, until the bytes below a candidate
are within the tolerance of their target. Then rows are exchanged once, by their place in a finer
division found in the same rounds, and numbered within the shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, texts_of

SHARDS = 8
#: A splitter is done when its bytes are this close to the target, as a share of a shard.
TOLERANCE = 0.0005
#: Probes for each splitter in a round.
PROBES = 31
#: Rows that one task numbers about.
ROWS_A_TASK = 200_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def shard_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, and the key (h, doc_id) of each row."""

    def run(batches):
        for batch in batches:
            raw = texts_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) + 1 for t in raw], pa.int64()), pa.array([zlib.crc32(t) for t in raw], pa.int64()), batch.column("h")], names=["doc_id", "size", "text_crc32", "h"])

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(run, "doc_id long, size long, text_crc32 long, h long")


def _bytes_below(keys: DataFrame, column: str, probes: list[int]) -> tuple[np.ndarray, int]:
    """Bytes of the rows whose column is below each probe, and of all rows."""
    cut = np.array(sorted(set(probes)), np.int64)

    def run(batches):
        total = np.zeros(len(cut) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(cut, batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
            total += np.bincount(at, weights=batch.column("size").to_numpy(zero_copy_only=False), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "bytes"])

    rows = keys.select(F.coalesce(F.col(column), F.lit(_LOW)).alias(column), "size").mapInArrow(run, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()
    total = np.zeros(len(cut) + 1, np.int64)
    for r in rows:
        total[r["slot"]] = r["bytes"]
    below = dict(zip(cut.tolist(), np.cumsum(total)[:-1].tolist()))
    return np.array([below[p] for p in probes], np.int64), int(total.sum())


def _refine(keys: DataFrame, column: str, targets: np.ndarray, slack: np.ndarray, base: int = 0) -> tuple[list[int], list[int], list[int]]:
    """For each target, the value of the column with the bytes below it closest to the target, those
    bytes, and the greatest value with no more bytes below it than the target.

    A target's search ends within its slack, or when its interval is a single value.
    """
    lo, hi = [_LOW] * len(targets), [_HIGH] * len(targets)
    cut, got, done = [_LOW] * len(targets), [base] * len(targets), [False] * len(targets)
    while not all(done):
        plan = {}
        for i in (i for i, d in enumerate(done) if not d):
            width = hi[i] - lo[i]
            plan[i] = sorted({lo[i] + width * (j + 1) // (PROBES + 1) for j in range(PROBES)} - {lo[i]}) or [hi[i]]
        probes = sorted({p for own in plan.values() for p in own})
        below = dict(zip(probes, (_bytes_below(keys, column, probes)[0] + base).tolist()))
        for i, own in plan.items():
            for p in own:
                if abs(below[p] - targets[i]) < abs(got[i] - targets[i]):
                    cut[i], got[i] = p, below[p]
            lo[i] = max([lo[i], *(p for p in own if below[p] <= targets[i])])
            hi[i] = min([hi[i], *(p for p in own if below[p] > targets[i])])
            done[i] = abs(got[i] - targets[i]) <= slack[i] or hi[i] - lo[i] <= 1
    return cut, got, lo


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law ``bytes``.

    Equal texts share a shard unless a splitter falls into their group; a group is only split by
    doc_id where whole groups cannot meet the tolerance. Null texts count as empty; a null doc_id
    sorts first; repeated rows are kept; an empty table gives no rows; extra columns are ignored.
    """
    keys = materialize(shard_keys(docs), "shard-keys")
    n, total = keys.agg(F.count("*"), F.sum("size")).first()
    spark = docs.sparkSession
    if not n:
        return keys.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    finer = max(8, -(-n // ROWS_A_TASK // shards))
    parts = shards * finer
    targets = np.array([total * k // parts for k in range(1, parts)], np.float64)
    # splitters between shards are held to the tolerance; those inside a shard only deal out tasks
    slack = np.array([tolerance * total / shards if k % finer == finer - 1 else 0.2 * total / parts for k in range(parts - 1)])
    cut, got, low = _refine(keys, "h", targets, slack)
    # splitters that whole groups of equal texts cannot place are moved into their group
    inner: list[int] = [_LOW] * len(cut)
    astray = [k for k in range(parts - 1) if abs(got[k] - targets[k]) > slack[k]]
    at = F.col("h").isin(sorted({low[k] for k in astray}))
    groups = {r["h"]: r["n"] for r in keys.where(at).groupBy("h").agg(F.count("*").alias("n")).collect()} if astray else {}
    for h in sorted(h for h, n in groups.items() if n > 1):
        own = [k for k in astray if low[k] == h]
        start = int(_bytes_below(keys, "h", [h])[0][0])
        for k, i in zip(own, _refine(keys.where(F.col("h") == h), "doc_id", targets[own], slack[own], start)[0]):
            cut[k], inner[k] = h, i
    order = sorted(zip(cut, inner))
    bounds = np.array([c for c, _ in order], np.int64)
    ids = [i for _, i in order]
    shared = spark.sparkContext.broadcast((bounds, ids))

    def deal(batches):
        bounds, ids = shared.value
        hot = {int(b) for b, i in zip(bounds, ids) if i != _LOW}
        for batch in batches:
            h = batch.column("h").to_numpy()
            part = np.searchsorted(bounds, h, side="right")
            doc = batch.column("doc_id").fill_null(_LOW).to_numpy()
            for b in hot.intersection(h.tolist()) if hot else ():
                own = np.array([i for c, i in zip(bounds, ids) if c == b], np.int64)
                rows = h == b
                part[rows] = np.searchsorted(bounds, b, side="left") + np.searchsorted(own, doc[rows], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    dealt = materialize(keys.mapInArrow(deal, "doc_id long, size long, text_crc32 long, h long, part int"), "shard-parts")
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, at = [], 0
    for k in range(parts):
        if k % finer == 0:
            at = 0
        first.append(at)
        at += sizes.get(k, 0)
    shared_first = spark.sparkContext.broadcast(first)
    release(keys)

    def number(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            own = batch.column("part").to_pylist()
            slots = []
            for p in own:
                i = seen.get(p, 0)
                seen[p] = i + 1
                slots.append(shared_first.value[p] + i)
            m = len(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(["bytes"] * m, pa.string()), pa.array([p // finer for p in own], pa.int32()), pa.array(slots, pa.int64()), pa.nulls(m, pa.int32())], names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    sorted_rows = dealt.repartition(parts, "part").sortWithinPartitions("part", "h", "doc_id")
    return sorted_rows.mapInArrow(number, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
