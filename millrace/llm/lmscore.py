"""Language-model scoring: a probabilistic suffix tree, beside an add-one unigram base.

The tree models the symbols of the normalised text (each word with a space, then an end symbol), so
its score is the probability of the text itself, whatever words it has.
The 62 most frequent bytes of the training text are symbols of their own; other bytes share one,
within which they have smoothed frequencies. Contexts of one to five symbols are counted over the
whole training share. A context is retained if it occurs LEAST_COUNT times and a divergence test
tells its next-symbol distribution from that of the longest retained state below it; its
distribution is smoothed towards that state's. A text is scored by the longest retained suffix at
each symbol.

States of up to three symbols are an array of a size that the alphabet bounds, and are broadcast.
How many longer ones there are grows with the input: they stay in a table, dealt to buckets by their
last four symbols. A chunk of documents asks the buckets for the probabilities of the distinct
symbol sequences that it holds, as it asks for the counts of its words.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bucket, chunked, documents_of
from .common import blob, collect_garbage, distinct, materialize, ranked, release, slices, texts_of

SYMBOLS = 64
#: Contexts of up to DENSE symbols are counted in one array, longer ones up to DEPTH by key.
DENSE, DEPTH = 3, 5
END, OTHER = 0, 1
#: A context is retained from so many occurrences and this gain in nats on.
LEAST_COUNT, LEAST_GAIN = 32, 40.0
#: Weight of the shorter state's distribution, in occurrences.
SMOOTHING = 4.0
#: Documents of a chunk, and chunks that ask one task for symbol sequences.
CHUNK_DOCS, FAN = 4096, 4096
_STEP = 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GRAMS = SYMBOLS ** (DENSE + 1)
_PAD = b"\n" * DEPTH


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased; the split is at blanks, tabs and line ends only."""
    return text.translate(_LOWER).split()


def held_out(doc_id) -> bool:
    """crc32 of the id as text is 2 modulo 7; a null id counts as text ``None``."""
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each as line feeds (one for each symbol of the longest context), its words with a space after each, and a line feed, and where each begins."""
    parts = [_PAD + b" ".join([*words_of(t), b"\n"]) for t in texts]
    starts = np.cumsum([0, *map(len, parts[:-1])], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _training_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))) if not held_out(i)]


class SuffixTree:
    """The states of up to three symbols: their distributions, the alphabet, and which contexts of four symbols may have longer ones."""

    def __init__(self, symbol: np.ndarray, extra: np.ndarray, state: np.ndarray, logp: np.ndarray, open4: np.ndarray):
        """symbol and extra by byte; state by the last three symbols; logp by state and next symbol (log10); open4 as bits by the last four symbols."""
        self.symbol, self.extra, self.state, self.logp, self.open4 = symbol, extra, state, logp, open4

    def grams(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each byte the symbol and the five before it, the oldest in the highest digit, and whether its context may have a longer state."""
        one = self.symbol[data].astype(np.int64)
        two = one.copy()
        two[1:] |= one[:-1] << 6
        gram = two.copy()
        gram[2:] |= two[:-2] << 12
        gram[4:] |= two[:-4] << 24
        four = gram >> 6 & _FOUR
        return gram, (self.open4[four >> 3] >> (four & 7).astype(np.uint8) & 1).astype(bool)

    def short(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence's last symbol by the states of up to three symbols."""
        return self.logp.ravel()[self.state[gram >> 6 & _THREE].astype(np.int64) * SYMBOLS + (gram & SYMBOLS - 1)]


def token_sums(data: np.ndarray, starts: np.ndarray, value: np.ndarray) -> list[float]:
    """Sum of the values of each text's bytes, without the line feeds before it."""
    for k in range(DEPTH):
        value[starts + k] = 0
    return np.add.reduceat(value, starts).tolist() if len(starts) else []


def _alphabet(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            texts = _training_texts(batch)
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), 1 << 20):
                data, starts = _buffer(texts[lo:hi])
                total += np.bincount(data, minlength=256)
                total[10] -= DEPTH * len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    counts = np.zeros(256)
    for r in docs.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    counts[10] = 0
    own = sorted(range(256), key=lambda b: (-counts[b], b))[: SYMBOLS - 2]
    symbol, extra = np.full(256, OTHER, np.uint8), np.zeros(256)
    symbol[own] = np.arange(2, SYMBOLS)
    rest = symbol == OTHER
    extra[rest] = np.log10((counts[rest] + 1) / (counts[rest] + 1).sum())
    symbol[10], extra[10] = END, 0.0
    return symbol, extra


def _gram_counts(docs: DataFrame, symbol: np.ndarray) -> np.ndarray:
    """Counts of four symbols in a row that end at a byte or the end of a training text."""

    def run(batches):
        total = np.zeros(_GRAMS, np.int64)
        for batch in batches:
            texts = _training_texts(batch)
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), 1 << 21):
                data, starts = _buffer(texts[lo:hi])
                s = symbol[data].astype(np.uint32)
                gram = s.copy()
                for k in (1, 2, 3):
                    gram[k:] |= s[:-k] << np.uint32(6 * k)
                ok = np.ones(len(s), bool)
                for k in range(DEPTH):
                    ok[starts + k] = False
                value, n = np.unique(gram[ok], return_counts=True)
                total[value] += n
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    sums = docs.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_GRAMS, np.int64)
    counts[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return counts.reshape(-1, SYMBOLS)


def _longer_counts(docs: DataFrame, tree) -> DataFrame:
    """Counts (gram, n) of the longest contexts with their next symbol, where contexts of more than three symbols may be retained."""

    def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, where = ranked(np.concatenate(values))
        return value, np.bincount(where, np.concatenate(counts), len(value)).astype(np.int64)

    def run(batches):
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = _training_texts(batch)
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), _STEP):
                data, starts = _buffer(texts[lo:hi])
                gram, ok = tree.value.grams(data)
                for k in range(DEPTH):
                    ok[starts + k] = False
                value, n = np.unique(gram[ok], return_counts=True)
                values.append(value)
                counts.append(n)
                if sum(map(len, values)) > 1 << 21 and len(values) > 8:
                    value, n = merged(values, counts)
                    values, counts = [value], [n]
        value, n = merged(values, counts)
        for lo in range(0, len(value), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(value[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)])], names=["gram", "n"])

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _retained(counts: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are kept, and the distributions of all: their own, smoothed, or the shorter state's."""
    keep, out = np.zeros(len(counts), bool), np.array(shorter, np.float32)
    for lo in range(0, len(counts), 1 << 14):
        own, below = counts[lo : lo + (1 << 14)].astype(np.float64), shorter[lo : lo + (1 << 14)].astype(np.float64)
        n = own.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(own > 0, own * np.log(own / n / below), 0).sum(axis=1)
        kept = (n[:, 0] >= LEAST_COUNT) & (gain >= LEAST_GAIN)
        keep[lo : lo + (1 << 14)] = kept
        out[lo : lo + (1 << 14)][kept] = ((own + SMOOTHING * below) / (n + SMOOTHING))[kept]
    return keep, out


def fit_suffix_tree(docs: DataFrame) -> SuffixTree:
    """The states of up to three symbols of the training share of docs (doc_id, text), from counts over all of it."""
    rows = docs.select("doc_id", "text")
    symbol, extra = _alphabet(rows)
    counts = _gram_counts(rows, symbol)  # contexts of three x next symbol
    open4 = np.packbits(counts.ravel() >= LEAST_COUNT, bitorder="little")  # four symbols in a row are a context, too
    root = counts.sum(axis=0) + 0.5
    dist = (root / root.sum()).astype(np.float32)[None, :]
    states, logp = np.zeros(1, np.int32), [np.log10(dist)]
    total = 1
    for depth in range(1, DENSE + 1):
        own = counts.reshape(SYMBOLS ** (DENSE - depth), SYMBOLS**depth, SYMBOLS).sum(axis=0) if depth < DENSE else counts
        # the oldest symbol is the highest digit, so the shorter context repeats
        keep, dist = _retained(own, np.tile(dist, (SYMBOLS, 1)))
        states = np.tile(states, SYMBOLS)
        states[keep] = total + np.arange(keep.sum())
        total += int(keep.sum())
        logp.append(np.log10(dist[keep]))
    return SuffixTree(symbol, extra, states.astype(np.int32), np.concatenate(logp).astype(np.float32), open4)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of n of each, and each row's place among them."""
    known, at = ranked(keys)
    return known, np.bincount(at, n, len(known)), at


def longer_states(gram: np.ndarray, n: np.ndarray, tree: SuffixTree) -> dict[str, np.ndarray]:
    """The retained contexts of four and five symbols among counted sequences, their totals, and the counts of what follows them.

    All sequences that share their last four context symbols must be among gram.
    """
    out: dict[str, np.ndarray] = {}
    for depth in (4, 5):
        following, count, _ = _sums(gram & (SYMBOLS ** (depth + 1) - 1), n)
        context, total, at = _sums(following >> 6, count)
        with np.errstate(divide="ignore"):
            gain = np.bincount(at, count * (np.log(count / total[at]) - np.log(10.0) * _by_states(following, tree, out)), len(context))
        keep = (total >= LEAST_COUNT) & (gain >= LEAST_GAIN)
        out |= {f"context{depth}": context[keep], f"total{depth}": total[keep], f"following{depth}": following[keep[at]], f"count{depth}": count[keep[at]]}
    return out


def _found(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where it is not among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0.0)


def _by_states(gram: np.ndarray, tree: SuffixTree, states: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of the last symbol of each sequence by its longest retained context, of those that states has."""
    p = 10.0 ** tree.short(gram).astype(np.float64)
    for depth in (4, 5):
        if f"context{depth}" in states:
            following = gram & (SYMBOLS ** (depth + 1) - 1)
            total = _found(following >> 6, states[f"context{depth}"], states[f"total{depth}"])
            own = _found(following, states[f"following{depth}"], states[f"count{depth}"])
            p = np.where(total > 0, (own + SMOOTHING * p) / (total + SMOOTHING), p)
    return np.log10(p)


_THREE, _FOUR = SYMBOLS**3 - 1, SYMBOLS**4 - 1
_SPREAD = 2654435761


def _bucket_of(gram: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a sequence, by the last four symbols of its context."""
    return ((gram >> 6 & _FOUR) * _SPREAD >> 16) % n


def _states_table(docs: DataFrame, tree, n_buckets: int) -> DataFrame:
    """bucket and, packed, the retained contexts of more than three symbols in it."""
    names = [f"{k}{d}" for d in (4, 5) for k in ("context", "total", "following", "count")]

    def run(table):
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        found = longer_states(gram, n, tree.value)
        return pa.table({"bucket": table.column("bucket").slice(0, 1)} | {k: pa.array([blob(found[k].astype(np.int64))], pa.binary()) for k in names})

    bucket = F.pmod(F.shiftright(F.shiftright("gram", 6).bitwiseAND(_FOUR) * F.lit(_SPREAD), 16), F.lit(n_buckets)).cast("int")
    counted = _longer_counts(docs, tree).withColumn("bucket", bucket)
    return materialize(counted.groupBy("bucket").applyInArrow(run, "bucket int, " + ", ".join(f"{k} binary" for k in names)), "states")


def _packed_grams(gram: np.ndarray) -> bytes:
    """Sequences of 36 bits in five bytes each."""
    return gram.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked_grams(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<i8").ravel()


def _asked(rows: DataFrame, tree, n_buckets: int) -> DataFrame:
    """What each chunk asks of each bucket: its words and their training counts (kind 0), its sequences (kind 1)."""

    def ask(table):
        found = documents_of(table)
        number, ids = _numbered(found)
        known = np.zeros(len(number), np.int64)  # training counts
        for (doc, _), own in zip(found, ids):
            if not held_out(doc):
                np.add.at(known, own, 1)
        buckets = by_bucket(number, n_buckets)
        texts = [t for _, t in found]
        grams = [np.zeros(0, np.int64)]
        for lo, hi in slices(np.array([len(t) for t in texts], np.int64), _STEP):
            gram, ok = tree.value.grams(_buffer(texts[lo:hi])[0])
            grams.append(distinct(gram[ok]))
        parts = _by_gram_bucket(distinct(np.concatenate(grams)), n_buckets)
        chunk = table.column("chunk")[0].as_py()
        return pa.table({
            "kind": pa.array([0] * len(buckets) + [1] * len(parts), pa.int32()),
            "chunk": pa.array([chunk] * (len(buckets) + len(parts)), pa.int32()),
            "bucket": pa.array([*buckets, *(b for b, _ in parts)], pa.int32()),
            "keys": pa.array([b"\n".join(own) for own in buckets.values()] + [_packed_grams(g) for _, g in parts], pa.binary()),
            "counts": pa.array([known[[number[w] for w in own]].astype(np.int32).tobytes() for own in buckets.values()] + [b""] * len(parts), pa.binary()),
        })

    return materialize(rows.groupBy("chunk").applyInArrow(ask, "kind int, chunk int, bucket int, keys binary, counts binary"), "asked")


def _numbered(found: list) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of a chunk's distinct words, in the order they come, and each document's words as numbers. The end is the empty word."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = []
    for _, text in found:
        words = words_of(text)
        words.append(b"")
        ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    return number, ids


def _by_gram_bucket(gram: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """Sequences by bucket, ascending in each."""
    own = _bucket_of(gram, n_buckets)
    order = np.argsort(own, kind="stable")
    at = np.flatnonzero(np.diff(own[order], prepend=-1))
    return [(int(own[order[a]]), gram[order[a:b]]) for a, b in zip(at, np.append(at[1:], len(order)))]


def _answers(asked: DataFrame, states: DataFrame, tree, n_chunks: int) -> DataFrame:
    """For each asked row the counts of its words (int64), or the log10 probabilities of its sequences (float32); chunk -1 has each bucket's distinct words and tokens."""

    def words(table):
        total: dict[bytes, int] = {}
        rows = [(c, w.split(b"\n"), np.frombuffer(n, np.int32)) for c, w, n in zip(*(table.column(x).to_pylist() for x in ("chunk", "keys", "counts")))]
        for _, own, counts in rows:
            for w, n in zip(own, counts.tolist()):
                total[w] = total.get(w, 0) + n
        stats = np.array([sum(n > 0 for n in total.values()), sum(total.values())], np.int64)
        return answered(table, 0, [-1] + [c for c, _, _ in rows], [stats.tobytes()] + [np.array([total[w] for w in own], np.int64).tobytes() for _, own, _ in rows])

    def answered(table, kind, chunks, values):
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"kind": pa.array([kind] * len(chunks), pa.int32()), "chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "values": pa.array(values, pa.binary())})

    def sequences(left, right):
        if not left.num_rows:
            return left.select(["kind", "chunk", "bucket"]).append_column("values", pa.array([], pa.binary()))
        known = {n: np.frombuffer(right.column(n)[0].as_py(), np.int64) for n in right.column_names if n not in ("bucket", "salt")} if right.num_rows else {}
        values = [blob(_by_states(_unpacked_grams(k), tree.value, known).astype(np.float32)) for k in left.column("keys").to_pylist()]
        return answered(left, 1, left.column("chunk").to_pylist(), values)

    schema = "kind int, chunk int, bucket int, values binary"
    salts = -(-n_chunks // FAN)  # a bucket's states meet so many ranges of chunks, each in a task of its own
    left = asked.where("kind = 1").withColumn("salt", F.floor(F.col("chunk") / FAN).cast("int"))
    right = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(sequences, schema)
    return materialize(asked.where("kind = 0").groupBy("bucket").applyInArrow(words, schema).unionByName(scored), "answers")


def score(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are the end token alone; repeated rows count and are scored once each; an
    empty table gives no rows; extra columns are ignored. Counts cover every training row.
    """
    spark = docs.sparkSession
    tree = spark.sparkContext.broadcast(fit_suffix_tree(docs))
    rows, n_chunks, n_buckets = chunked(docs, CHUNK_DOCS)
    states = _states_table(docs.select("doc_id", "text"), tree, n_buckets)
    collect_garbage(spark)
    asked = _asked(rows, tree, n_buckets)
    collect_garbage(spark)
    answers = _answers(asked, states, tree, n_chunks)
    release(asked)
    release(states)
    collect_garbage(spark)

    def add(batches):
        total = np.zeros(2, np.int64)
        for batch in batches:
            for c in batch.column("values").to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["v", "n"])

    v, n = answers.where("chunk = -1").select("values").mapInArrow(add, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def finish(docs_table, answers_table):
        if not docs_table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _RESULT.items()})
        found = documents_of(docs_table)
        number, words = _numbered(found)
        buckets = by_bucket(number, n_buckets)
        count = np.zeros(len(number))
        answer: dict[int, np.ndarray] = {}
        for kind, bucket, values in zip(*(answers_table.column(x).to_pylist() for x in ("kind", "bucket", "values"))):
            if kind:
                answer[bucket] = np.frombuffer(values, np.float32)
            else:
                count[[number[w] for w in buckets[bucket]]] = np.frombuffer(values, np.int64)
        known, each = count > 0, np.log10(count + 1) - np.log10(n + v + 1)
        spelled = _spelled([t for _, t in found], tree.value, answer, n_buckets)
        out = [[len(w) for w in words], [int(known[w].sum()) for w in words], [float(each[w].sum()) for w in words], spelled]
        ids = [d for d, _ in found]
        values = (ids, [held_out(d) for d in ids], out[0], out[1], [n] * len(ids), out[2], out[3])
        return pa.table({k: pa.array(x, t) for (k, t), x in zip(_RESULT.items(), values)})

    own = answers.where("chunk >= 0").select("kind", "chunk", "bucket", "values")
    return rows.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _spelled(texts: list[bytes], tree: SuffixTree, answer: dict[int, np.ndarray], n_buckets: int) -> list[float]:
    """log10 probability of each text of a chunk, with the buckets' answers for its sequences."""
    parts, found = [], [np.zeros(0, np.int64)]
    for lo, hi in slices(np.array([len(t) for t in texts], np.int64), _STEP):
        data, starts = _buffer(texts[lo:hi])
        gram, ok = tree.grams(data)
        value = tree.extra[data]
        value[~ok] += tree.short(gram[~ok])
        own, at = ranked(gram[ok])
        parts.append((data, starts, value, ok, own, at))
        found.append(own)
    every = distinct(np.concatenate(found))
    logp = np.zeros(len(every))
    for bucket, own in _by_gram_bucket(every, n_buckets):
        logp[np.searchsorted(every, own)] = answer[bucket]
    out: list[float] = []
    for data, starts, value, ok, own, at in parts:
        value[ok] += logp[np.searchsorted(every, own)][at]
        out += token_sums(data, starts, value)
    return out


_RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
