"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are n-grams of 1 to 3 characters (code points; A-Z lower-cased, ASCII characters that are
no letters taken as a space; a space stands before each text), hashed into ``bins`` buckets. The matrix of log
probabilities has bins x languages entries, which bounds what is broadcast whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings_of

BINS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the training sample: so many labelled documents of each language at most.
TRAIN_PER_LANGUAGE = 4000
#: The matrix that is broadcast may have at most so many bytes.
MATRIX_LIMIT = 256 << 20
#: Characters that are hashed at once, and of the texts that are folded at once.
_STEP, _TEXTS = 1 << 18, 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(128, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of folded code points, a space before each text, and where each text begins."""
    data = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    plain = data < 128
    return np.where(plain, _FOLD[np.where(plain, data, 0)], data), np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)


def _hashed(gram: np.ndarray, shift: np.uint32) -> np.ndarray:
    """Buckets of n-grams, given as 32-bit mixtures of their characters."""
    h = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift


def _ngrams(data: np.ndarray, bounds: np.ndarray, bins: int):
    """Yields (document of each n-gram, bucket of each n-gram) for steps of the buffer."""
    shift = np.uint32(32 - int(bins).bit_length() + 1)
    back = ORDERS[-1] - 1
    for lo in range(0, len(data), _STEP):
        hi = min(lo + _STEP, len(data))
        skip = lo - max(0, lo - back)
        part = data[lo - skip : hi]
        at = np.arange(lo, hi)
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at - bounds[doc]
        gram = np.zeros(hi - lo, np.uint32)
        for order in ORDERS:
            older = np.zeros(hi - lo, np.uint32)  # the character that the n-gram begins with
            src = part[max(0, skip - order + 1) : len(part) - order + 1]
            older[len(older) - len(src) :] = src
            gram = (gram + older + np.uint32(order)) * np.uint32(0x9E3779B1)
            # it lies within its text, and is not of spaces alone
            ok = (inside >= order - 1) & ((part[skip:] != 32) | (older != 32))
            yield doc[ok], _hashed(gram[ok], shift)


class LanguageModel:
    """Languages and their matrix of log probabilities, bins x languages."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability for each text; ``und`` and 0 where there is no letter."""
        texts = [t or "" for t in texts]
        sums = np.zeros((len(texts), max(1, len(self.languages))))
        for lo, hi in slices(list(map(len, texts)), _TEXTS) if self.languages else ():
            data, bounds = _buffer(texts[lo:hi])
            for doc, h in _ngrams(data, bounds, len(self.matrix)):
                if len(doc):
                    rows = self.matrix[h]
                    at = np.flatnonzero(np.diff(doc, prepend=-1))
                    sums[lo + doc[at]] += np.add.reduceat(rows, at, axis=0, dtype=np.float64)
        best = sums.argmax(axis=1)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        known = np.array([bool(_LETTER.search(t)) for t in texts], bool) & bool(self.languages)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


def in_training(doc_id) -> bool:
    """Documents whose crc32 of the id, as text, is 1 modulo 3 are held out; a null id counts as text ``None``."""
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def fit_language_model(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, bins: int = BINS, alpha: float = 0.05) -> LanguageModel:
    """Fit on the training share of docs (doc_id, text, lang).

    The sample holds about ``per_language`` documents of each language, picked by a hash of id and
    text from all labelled rows; smaller languages are taken whole. Rows without text or label are
    left out. An empty table gives a model that answers ``und``.
    """
    spark = docs.sparkSession
    ident = F.col("doc_id").cast("string")
    train = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(ident, F.lit("None"))) % 3 != 1))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) * bins * 4 > MATRIX_LIMIT:
        raise ValueError(f"{len(languages)} languages need a matrix beyond {MATRIX_LIMIT} bytes; lower bins")
    if not languages:
        return LanguageModel([], np.zeros((bins, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    picked = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
    code = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, langs = strings_of(batch.column("text")), [code[x] for x in batch.column("lang").to_pylist()]
            label = np.array(langs, np.int64)
            for doc, h in ((lo + doc, h) for lo, hi in slices(list(map(len, texts)), _TEXTS) for doc, h in _ngrams(*_buffer(texts[lo:hi]), bins)):
                both = np.bincount(label[doc] * bins + h, minlength=0)
                for k in range(len(languages)):
                    part = both[k * bins : (k + 1) * bins]
                    if not part.any():
                        continue
                    own = total.setdefault(k, np.zeros(bins, np.int64))
                    own[: len(part)] += part
        for k, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"])

    sums = picked.mapInArrow(count, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((bins, len(languages)))
    counts[sums["bin"], sums["lang"]] = sums["n"]
    logp = np.log(counts + alpha) - np.log((counts + alpha).sum(axis=0))
    return LanguageModel(languages, logp.astype(np.float32))


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text).

    Null and letterless texts give ``und`` with score 0; repeated rows give repeated results; an
    empty table gives no rows; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            langs, score = shared.value.predict(strings_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([not in_training(i) for i in ids], pa.bool_()), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose language is known with a probability of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, score = shared.value.predict(strings_of(batch.column("text")))
            yield batch.filter(pa.array([k != "und" and s >= least for k, s in zip(langs, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
