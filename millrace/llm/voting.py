"""Quality classification: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a sequence of character classes (lower and upper letters, digits, white space, every
other ASCII character for itself) in which runs are one; a word that repeats the one before it is a
class of its own. Its n-grams are hashed into ``bins`` buckets; counts weigh by logarithm and by an
inverse document frequency that covers all documents. A truncated singular value decomposition of
the labelled sample gives the latent directions. Every document meets every labelled vector in exact blocked
cosine products; its nearest neighbours, ties of the last included, vote by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, strings_of

BINS = 1 << 12
ORDERS = (1, 2, 3, 4, 5)
#: Bound of the labelled sample: so many documents of each label at most.
TRAIN_PER_LABEL = 3000
#: Latent directions, and neighbours that vote.
RANK, NEIGHBOURS = 64, 25
#: Characters that are folded at once, and rows of a block of products.
_STEP, _BLOCK = 1 << 20, 512
_REPEAT = 127
_CLASS = np.arange(128, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[9:14] = 97, 65, 48, 10
_PLACES = np.random.default_rng(7).integers(1 << 62, size=64, dtype=np.uint64) | np.uint64(1)


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Collapsed classes of all texts in one array, and the text of each."""
    data = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    kind = np.where(data < 128, _CLASS[np.where(data < 128, data, 0)], np.uint8(97))
    space = (kind == 32) | (kind == 10)
    # words that repeat the one before them in their text
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(begins):
        place = np.arange(len(data)) - np.repeat(begins, np.diff(begins, append=len(data)))[: len(data)] if begins[0] == 0 else np.concatenate((np.zeros(begins[0], np.int64), np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(begins, append=len(data)))))
        value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 63])
        word = np.add.reduceat(value, begins)
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (own[begins[1:]] == own[begins[:-1]])))
        inside = np.repeat(again, np.diff(begins, append=len(data)))
        kind = kind.copy()
        kind[begins[0] :][inside & ~space[begins[0] :]] = _REPEAT
    fresh = np.concatenate(([True], (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])))
    return kind[fresh], own[fresh]


def _counts(texts: list[str], bins: int) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, texts x bins, by steps of texts."""
    shift = np.uint32(32 - int(bins).bit_length() + 1)
    for lo, hi in slices(list(map(len, texts)), _STEP):
        for at in range(lo, hi, _BLOCK):
            part = texts[at : min(at + _BLOCK, hi)]
            kind, own = _classes(part)
            total = np.zeros(len(part) * bins, np.int64)
            gram = np.zeros(len(kind), np.uint32)
            for order in ORDERS:
                n = len(kind) - order + 1
                if n <= 0:
                    break
                gram = (gram[:n] * np.uint32(0x9E3779B1)) + kind[order - 1 :] + np.uint32(order)
                h = gram ^ (gram >> np.uint32(15))
                h = (h * np.uint32(0x85EBCA6B)) >> shift
                ok = own[:n] == own[order - 1 :]
                total += np.bincount(own[:n][ok] * bins + h[ok], minlength=len(total))
            out = total.reshape(len(part), bins)
            out[[i for i, t in enumerate(part) if not t]] = 0
            yield out


def held_out(doc_id) -> bool:
    """Documents whose crc32 of the id, as text, is 1 modulo 3; a null id counts as text ``None``."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


class QualityModel:
    """Weights of buckets, latent directions, and the labelled vectors with the weight of each vote."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float, neighbours: int):
        self.idf, self.directions, self.vectors, self.labels, self.weights, self.prior, self.neighbours = idf, directions, vectors, labels, weights, prior, neighbours

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text."""
        out = [np.empty(0)]
        for counts in _counts(texts, len(self.idf)):
            if not len(self.vectors):
                out.append(np.full(len(counts), self.prior))
                continue
            near = np.rint(_unit_rows(_weigh(counts.astype(np.float32), self.idf) @ self.directions) @ self.vectors.T * 65536)  # steps that do not depend on the block
            k = min(self.neighbours, near.shape[1])
            last = np.partition(near, -k, axis=1)[:, -k][:, None]
            vote = np.where((near >= last) & (near > 0), near, 0).astype(np.float64) * self.weights
            total = vote.sum(axis=1)
            out.append(np.where(total > 0, vote @ self.labels / np.where(total > 0, total, 1), self.prior))
        return np.concatenate(out).round(6)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts as weights, in place."""
    np.log1p(counts, out=counts)
    counts *= idf
    return counts


def _unit_rows(latent: np.ndarray) -> np.ndarray:
    """Rows of length one; zero where nothing is known."""
    size = np.linalg.norm(latent, axis=1, keepdims=True)
    return latent / np.where(size > 1e-6, size, np.float32(np.inf))


def _directions(matrix: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    rank = min(rank, *matrix.shape)
    basis = np.random.default_rng(11).standard_normal((matrix.shape[1], min(matrix.shape[1], rank + 16))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ right.T)[:, :rank], np.float32)


def _document_frequencies(docs: DataFrame, bins: int) -> tuple[int, np.ndarray]:
    """Documents with a text, and how many of them have each bucket."""

    def count(batches):
        n, held = 0, np.zeros(bins, np.int64)
        for batch in batches:
            for counts in _counts([t for t in strings_of(batch.column("text")) if t], bins):
                n += len(counts)
                held += (counts > 0).sum(axis=0)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(held[at], n))], names=["bin", "n"])

    sums = docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().set_index("bin")["n"]
    out = np.zeros(bins, np.int64)
    at = sums.index[sums.index >= 0]
    out[at] = sums[at]
    return int(sums.get(-1, 0)), out


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, bins: int = BINS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> QualityModel:
    """Fit on labels (doc_id, quality) of documents (doc_id, text) that are not held out.

    The sample has at most ``per_label`` documents of each label, picked by a hash of id and text
    from all labelled rows; a smaller label is taken whole. A vote weighs as many labelled rows as it stands for,
    so the sample's shares do not shift the score. Labels that are neither 0 nor 1 and rows
    without text are left out; a document with both labels counts as label 0. Without labelled
    rows the model answers 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return QualityModel(np.zeros(bins, np.float32), np.zeros((bins, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0), 0.5, neighbours)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_label / n))])
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("label")) * float(1 << 30))

    def fold(batches):
        for batch in batches:
            texts = strings_of(batch.column("text"))
            rows = [(np.flatnonzero(c).astype(np.int32), c) for counts in _counts(texts, bins) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("pick"), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for a, c in rows], pa.binary())], names=["label", "pick", "bins", "counts"])

    # about 2 * per_label ids: a few hundred kB whatever the input
    joined = docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(picked), "doc_id").withColumn("pick", F.xxhash64("doc_id", "text"))
    folded = materialize(joined.select("label", "pick", "text").mapInArrow(fold, "label int, pick long, bins binary, counts binary"), "labelled")
    rows = []
    for k in sorted(sizes):
        rows += folded.where(F.col("label") == k).orderBy("pick", "counts").limit(per_label).collect()
    release(folded)
    matrix = np.zeros((len(rows), bins), np.float32)
    for own, r in zip(matrix, rows):
        own[np.frombuffer(r["bins"], np.int32)] = np.frombuffer(r["counts"], np.int32)
    label = np.array([r["label"] for r in rows], np.int64)
    total, held = _document_frequencies(docs, bins)
    idf = np.where(held > 0, np.log((1 + total) / (1 + held)) + 0.1, 0).astype(np.float32)
    _weigh(matrix, idf)
    directions = _directions(matrix, rank) if len(rows) else np.zeros((bins, 0), np.float32)
    stands_for = [sizes[k] / max(1, int((label == k).sum())) for k in label.tolist()]
    return QualityModel(idf, directions, _unit_rows(matrix @ directions), label.astype(np.float64), np.array(stands_for), sizes.get(1, 0) / sum(sizes.values()), neighbours)


def quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Null and empty texts, and texts unlike all labelled ones, score the share of label 1; equal
    texts score alike; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.scores(strings_of(batch.column("text")))
            out = [held_out(i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
