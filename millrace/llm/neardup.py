"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words. A shingle weighs
tf * (1 + IDF_SHARE * idf), where idf in 0..1 comes from document frequencies counted over the
whole corpus in a hashed table of fixed size. Each distinct text gets HASHES consistent weighted
samples, in BANDS bands of ROWS samples; texts that share a band are in one bucket, and two of them
are linked if the weighted Jaccard similarity of their whole texts is LEAST or more. Classes are the
connected components of all links within buckets.

All pairs of a bucket need no verification for that. In buckets of up to SMALL members all pairs
are candidates; in larger ones each member is a candidate with a centre, bucket by bucket of bounded
size, level by level, so the number of pairs is linear. The samples discard clear misses, and the
whole texts decide. What this leaves in several classes is then settled exactly: the members of a
larger bucket that are outside its largest class are compared with all its members, in tiles of a
bounded size that hold each member's shingles once, and a tile gives one link for each two classes
that it joins. So no two classes stay apart that some pair of a bucket would join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, blob, distinct, materialize, release, texts_of
from .decontaminate import words_of

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 12, 3
HASHES = BANDS * ROWS
IDF_BINS = 1 << 18
_SLICE = 1 << 12
IDF_SHARE = 0.25
#: Members of a bucket that one comparison step takes; all pairs are made up to SMALL of them.
BUCKET, SMALL = 256, 24
#: Members and shingles on either side of a tile, about, and shingles that are multiplied at once.
TILE, TILE_SHINGLES, _COLUMNS = 1024, 1 << 21, 4096
#: Candidates whose samples agree less often than this cannot reach LEAST but by an odd chance (4 deviations).
LEAST_AGREEMENT = LEAST - 4 * (LEAST * (1 - LEAST) / HASHES) ** 0.5
_STEP = 1 << 15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, computed over one buffer."""
    if not words:
        return np.zeros(0, np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lens) - lens
    inside = np.arange(len(data)) - np.repeat(starts, lens)
    keys = _mix(data.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(keys, starts) ^ lens.astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and its document, for documents given by bounds in the words.

    A document of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    lens = np.diff(bounds)
    doc = np.repeat(np.arange(len(lens)), lens)
    left = np.repeat(bounds[1:], lens) - np.arange(len(words))
    short = np.minimum(lens, SHINGLE)[doc]
    out = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(len(words), np.uint64)
        part[: max(0, len(words) - k)] = words[k:]
        mixed = _mix(out + part + np.uint64(k + 1))
        out = np.where(k < short, mixed, out)
    ok = left >= short
    return out[ok], doc[ok]


def weighted_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: document, hash and count, ordered by document."""
    words = [words_of(t) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    h, doc = shingles(word_hashes([w for own in words for w in own]), bounds)
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _batches_of(texts: list[bytes], limit: int = 1 << 20):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency, 0 to 1, of each bucket of shingles, over all rows of docs.

    Each task sums its own table and gives it in slices, so what is exchanged and collected has a fixed size.
    """

    def run(batches):
        total, n = np.zeros(IDF_BINS, np.int32), 0
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n += len(texts)
            for lo, hi in _batches_of(texts):
                _, h, _ = weighted_sets(texts[lo:hi])
                total += np.bincount((h & np.uint64(IDF_BINS - 1)).astype(np.int64), minlength=IDF_BINS).astype(np.int32)
        if n:
            parts = total.reshape(-1, _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(parts), dtype=np.int32)), pa.array([n, *([0] * len(parts))], pa.int64()), pa.array([None, *[p.tobytes() for p in parts]], pa.binary())], names=["slice", "n", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, c in zip(*(batch.column(x).to_pylist() for x in ("slice", "n", "counts"))):
                own = totals.setdefault(k, np.zeros(_SLICE if k >= 0 else 1, np.int64))
                own += n if k < 0 else np.frombuffer(c, np.int32)
        for k, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "counts"])

    parts = docs.select("text").mapInArrow(run, "slice int, n long, counts binary")
    sums = parts.repartition(IDF_BINS // _SLICE, "slice").mapInArrow(add, "slice int, counts binary").collect()
    table, n = np.zeros(IDF_BINS, np.int64), 0
    for r in sums:
        if r["slice"] < 0:
            n = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            table[r["slice"] * _SLICE :][:_SLICE] = np.frombuffer(r["counts"], np.int64)
    return (np.log((n + 1) / (np.minimum(table, n) + 1)) / np.log(n + 2)).astype(np.float32)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count * (1 + IDF_SHARE * idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)])


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal steps, by bisection."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Improved consistent weighted sampling: for each hash, r and c ~ Gamma(2, 1) and b ~ U(0, 1) of a
    shingle come from its hash; t = floor(ln w / r + b), ln y = r (t - b), and the sample is the
    (shingle, t) with the least ln c - ln y - r."""

    def __init__(self):
        q = _gamma_quantiles(1 << 12)
        self.r, self.lnc = q.astype(np.float32), np.log(_gamma_quantiles(1 << 16)).astype(np.float32)

    def signatures(self, doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """n x HASHES samples as unsigned 32-bit fingerprints; rows without shingles stay zero."""
        out = np.zeros((n, HASHES), np.uint32)
        # whole documents by steps that stay in cache; one longer than a step is a step of its own
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        ends = np.append(at[1:], len(doc))
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + _STEP, side="right")))
            a, b = at[lo], ends[hi - 1]
            self._step(doc[at[lo:hi]], at[lo:hi] - a, h[a:b], np.log(w[a:b]).astype(np.float32), out)
            lo = hi
        return out

    def _step(self, docs, starts, h, lnw, out) -> None:
        lens = np.diff(np.append(starts, len(h)))
        row = np.repeat(np.arange(len(starts)), lens)
        for k in range(HASHES):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * _M1
            x ^= x >> np.uint64(29)
            x *= _M2
            r = self.r[(x >> np.uint64(52)).astype(np.int32)]
            beta = ((x >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(lnw / r + beta)
            a = self.lnc[((x >> np.uint64(18)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - beta) - r
            least = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == least[row])
            first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            out[docs, k] = (_mix(h[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def with_key(docs: DataFrame) -> DataFrame:
    """docs and ``_text_key``, 16 bytes that identify the text (null for a null text)."""
    return docs.withColumn("_text_key", F.unhex(F.md5("text")))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, key of the text, n_shingles and samples of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        sampler, idf = Sampler(), shared.value
        for batch in batches:
            texts = texts_of(batch.column("text"))
            counts, sigs = [], []
            for lo, hi in _batches_of(texts):
                doc, h, n = weighted_sets(texts[lo:hi])
                sig = sampler.signatures(doc, h, weights(h, n, idf), hi - lo)
                counts += np.bincount(doc, minlength=hi - lo).tolist()
                sigs += [s.tobytes() for s in sig]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text_key"), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "key", "n_shingles", "sig"])

    return with_key(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, key binary, n_shingles long, sig binary")


def _keys(sig: np.ndarray) -> np.ndarray:
    """The key of each band of each row of samples."""
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
    return key.view(np.int64)


def _band_keys(texts: DataFrame) -> DataFrame:
    """band key and node of each band of each distinct text."""

    def run(batches):
        for batch in batches:
            keep = batch.filter(pa.array([n > 0 for n in batch.column("n_shingles").to_pylist()], pa.bool_()))
            if keep.num_rows:
                key = _keys(np.frombuffer(b"".join(keep.column("sig").to_pylist()), np.uint32))
                node = keep.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(node, BANDS))], names=["band", "node"])

    return texts.mapInArrow(run, "band long, node long")


def _pairs_of(nodes: np.ndarray, sig: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Candidate pairs among the members of a bucket, and its centre."""
    order = np.argsort(nodes, kind="stable")
    nodes, sig = nodes[order], sig[order]
    n = len(nodes)
    if n <= SMALL:
        i, j = np.triu_indices(n, 1)
        centre = 0
    else:
        agree = np.zeros(n, np.int64)
        for k in range(HASHES):
            value, inverse, count = np.unique(sig[:, k], return_inverse=True, return_counts=True)
            agree += count[inverse]
        centre = int(agree.argmax())
        i, j = np.full(n - 1, centre), np.delete(np.arange(n), centre)
        i, j = np.minimum(i, j), np.maximum(i, j)
    near = (sig[i] == sig[j]).mean(axis=1) >= LEAST_AGREEMENT
    return list(zip(nodes[i[near]].tolist(), nodes[j[near]].tolist())), int(nodes[centre])


def candidate_pairs(bands: DataFrame, sigs: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes whose samples agree often enough, linear in the members of buckets.

    Buckets beyond BUCKET members are dealt into sub-buckets by a hash of the node; the centres of
    the sub-buckets form the next level's bucket, until one step takes each bucket.
    """
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(sizes, "band").select("band", "node", "n")
    pairs, tops, level = None, None, 0
    while True:
        salted = members.join(sigs, "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("n") / BUCKET))).select("band", "salt", "node", "sig")

        def compare(key, rows):
            nodes = rows.column("node").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(nodes), HASHES)
            out, centre = _pairs_of(nodes, sig)
            found = [(key[0].as_py(), a, b) for a, b in out] + [(key[0].as_py(), centre, None)]
            band, a, b = zip(*found)
            return pa.table({"band": pa.array(band, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        step = materialize(salted.groupBy("band", "salt").applyInArrow(compare, "band long, a long, b long"), "pairs")
        own = step.where("b is not null").select("a", "b")
        pairs = own if pairs is None else pairs.unionByName(own)
        centres = step.where("b is null").select("band", F.col("a").alias("node"))
        again = centres.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        if level:
            done = centres.join(again, "band", "left_anti").withColumnRenamed("node", "top")
            tops = done if tops is None else tops.unionByName(done)
        if again.isEmpty():
            break
        members = centres.join(again, "band").select("band", "node", "n")
        level += 1
    if tops is not None:
        pairs = pairs.unionByName(_with_top(bands, tops, sigs))
    return pairs.distinct()


def _with_top(bands: DataFrame, tops: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of every member of a bucket of several levels with the centre that its last level found."""

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            near = (a == b).mean(axis=1) >= LEAST_AGREEMENT
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    found = bands.join(tops, "band").where("node <> top").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct()
    left = found.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    return left.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").mapInArrow(agree, "a long, b long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets, each as sorted hashes and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = LEAST) -> DataFrame:
    """The pairs whose whole texts (node, text) have a weighted Jaccard similarity of at least ``least``."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf, kept = shared.value, {}

        def sets(node: int, text: bytes):
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                _, h, n = weighted_sets([text])
                kept[node] = (h, weights(h, n, idf))
            return kept[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
            s = [similarity(sets(x, p), sets(y, q)) for x, y, p, q in zip(a, b, ta, tb)]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([v >= least - 1e-9 for v in s], pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its connected component, for every node of the edges (a, b).

    Each round gives every node the least label among its own and its neighbours' labels, and then
    the label of its label; labels are written out after each round until none changes.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(step.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        moved = new.where("root < old").limit(1).count()
        release(labels)
        labels = new.select("node", "root")
        labels._scratch_path = new._scratch_path
        if not moved:
            release(both)
            return labels


def _across(classed: DataFrame, sets: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links (a, b) that join classes of a bucket, for members (band, node, class, open) and their shingles (node, h, n).

    Open members are compared with all members of their bucket, in tiles; both sides are dealt by a hash of the node.
    """
    shared = classed.sparkSession.sparkContext.broadcast(idf)
    sized = classed.join(sets, "node").withColumn("size", F.octet_length("h") / 8)
    tiles = lambda only: F.greatest(F.ceil(F.sum(only) / TILE), F.ceil(F.sum(F.col("size") * only) / TILE_SHINGLES)).cast("int")
    blocks = sized.groupBy("band").agg(tiles(F.col("open").cast("long")).alias("across"), tiles(F.lit(1)).alias("down"))
    dealt = sized.join(blocks, "band")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "i", "j", "node", "class", "open", "h", "n"]
    left = dealt.where("open").withColumn("i", deal("across")).withColumn("j", every("down")).select(columns)
    right = dealt.withColumn("j", deal("down")).withColumn("i", every("across")).select([F.col(c).alias(f"{c}_b") for c in columns])

    def compare(key, a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = _links_of_tile(_Side(a, shared.value), _Side(b.rename_columns(columns), shared.value), least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return left.groupBy("band", "i", "j").cogroup(right.groupBy("band_b", "i_b", "j_b")).applyInArrow(compare, "a long, b long")


class _Side:
    """One side of a tile: nodes, classes, and each shingle's occurrences as features of a weight of their own."""

    def __init__(self, table: pa.Table, idf: np.ndarray):
        self.node, self.cls = table.column("node").to_numpy(), table.column("class").to_numpy()
        self.open = np.array(table.column("open").to_pylist(), bool)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
        counts = [np.frombuffer(x, np.int32) for x in table.column("n").to_pylist()]
        h, n = np.concatenate(sets), np.concatenate(counts)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.row, plain = np.repeat(row, n), np.repeat(h, n)
        self.feature = np.where(nth > 0, _mix(plain + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), plain)
        self.weight = weights(plain, np.ones(len(plain)), idf)
        self.total = np.bincount(self.row, self.weight, len(sets))

    def exact(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.row == i
        order = np.argsort(self.feature[own])
        return self.feature[own][order], self.weight[own][order]


def _links_of_tile(a: _Side, b: _Side, least: float) -> list[tuple[int, int]]:
    """One linked pair for each two classes that the tile joins, without those that others imply."""
    # shared weights, as products over the features that both sides have
    both = np.intersect1d(distinct(a.feature), distinct(b.feature), assume_unique=True)
    shared = np.zeros((len(a.node), len(b.node)), np.float32)
    columns = []
    for side in (a, b):
        at = np.minimum(np.searchsorted(both, side.feature), max(len(both) - 1, 0))
        hit = both[at] == side.feature if len(both) else np.zeros(len(at), bool)
        order = np.argsort(at[hit], kind="stable")
        columns.append((at[hit][order], side.row[hit][order], np.sqrt(side.weight[hit][order]).astype(np.float32)))
    for lo in range(0, len(both), _COLUMNS):
        parts = []
        for (at, row, w), side in zip(columns, (a, b)):
            x, y = np.searchsorted(at, (lo, lo + _COLUMNS))
            dense = np.zeros((len(side.node), min(_COLUMNS, len(both) - lo)), np.float32)
            dense[row[x:y], at[x:y] - lo] = w[x:y]
            parts.append(dense)
        shared += parts[0] @ parts[1].T
    similar = shared / np.maximum(a.total[:, None] + b.total - shared, 1e-9)
    near = (similar >= least - 1e-3) & (a.cls[:, None] != b.cls) & ~(b.open & (a.node[:, None] > b.node))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, sets = [], {}
    i, j = np.nonzero(near)
    order = np.argsort(-similar[i, j], kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        p, q = root(int(a.cls[x])), root(int(b.cls[y]))
        if p == q:
            continue
        if similar[x, y] < least + 1e-3:  # too close to call in single precision
            for k, side, at in ((0, a, x), (1, b, y)):
                if (k, at) not in sets:
                    sets[k, at] = side.exact(at)
            if similarity(sets[0, x], sets[1, y]) < least - 1e-9:
                continue
        parent[p] = q
        out.append((int(a.node[x]), int(b.node[y])))
    return out


def _sets(texts: DataFrame) -> DataFrame:
    """node, hashes and counts of the distinct shingles of texts (node, text)."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            sets, counts = [], []
            for lo, hi in _batches_of(texts):
                doc, h, n = weighted_sets(texts[lo:hi])
                cut = np.searchsorted(doc, np.arange(1, hi - lo))
                sets += [blob(x) for x in np.split(h, cut)]
                counts += [blob(x.astype(np.int32)) for x in np.split(n, cut)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], names=["node", "h", "n"])

    return texts.mapInArrow(run, "node long, h binary, n binary")


def _settled(links: DataFrame, bands: DataFrame, node_texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """node and root of the classes that links and all other links within large buckets make."""
    roots = components(links)
    large = bands.join(bands.groupBy("band").count().where(F.col("count") > SMALL).select("band"), "band")
    own = materialize(large.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("class")), "classed")
    counts = own.groupBy("band", "class").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("band", "main")
    classed = materialize(own.join(mixed, "band").select("band", "node", "class", F.expr("class <> main").alias("open")), "mixed")
    release(own)
    if classed.isEmpty():
        return roots
    sets = materialize(_sets(node_texts.join(classed.select("node").distinct().hint("merge"), "node", "left_semi")), "sets")
    found = materialize(_across(classed, sets, idf, least), "links")
    release(classed)
    release(sets)
    return roots if found.isEmpty() else components(found.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and key of each row of docs, and key, n_copies, class (null for texts without links) and least doc_id of each distinct text."""
    rows = docs.select("doc_id", "text")
    idf = idf_table(rows)
    signed = materialize(signatures(rows, idf), "signed")
    grouped = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    texts = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "texts")
    bands = _band_keys(texts.select("node", "n_shingles", "sig"))
    crowded = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    bands = materialize(bands.join(crowded, "band").select("band", "node"), "bands")
    # only texts that share a band are ever compared
    wanted = bands.select("node").distinct().join(texts.select("node", "key"), "node").withColumnRenamed("key", "_text_key")
    node_texts = materialize(with_key(rows).join(wanted.hint("merge"), "_text_key").select("node", "text").dropDuplicates(["node"]), "node-texts")
    pairs = materialize(candidate_pairs(bands, texts.select("node", "sig")), "candidates")
    with batch_rows(docs.sparkSession, 100):  # a row holds two whole texts
        links = materialize(verified(pairs, node_texts, idf, least), "links")
    release(pairs)
    roots = _settled(links.select("a", "b"), bands, node_texts, idf, least)
    classes = materialize(texts.select("key", "node", "n_copies", "least_id").join(roots, "node", "left"), "classes")
    for t in (texts, bands, node_texts, links):
        release(t)
    return signed, classes


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id and n_copies of every row of docs (doc_id, text).

    class_id is the least doc_id of the class: equal texts, and texts linked by a similarity of at
    least ``least``, directly or by others. n_copies counts the rows of the same text. A null text
    is a class of its own row, by its doc_id, with one copy; texts without words only equal themselves; repeated rows
    are copies; different texts under one doc_id are judged apart; a null doc_id gets the class of
    its text, and a class without any doc_id a negative number made from its texts; an empty table
    gives no rows; extra columns are ignored.
    """
    signed, classes = _classes(docs, least)
    nameless = F.lit(-1).cast("long") - F.min(F.pmod(F.xxhash64("key"), F.lit(1 << 62)))
    named = classes.withColumn("class", F.coalesce("root", "node")).groupBy("class").agg(F.coalesce(F.min("least_id"), nameless).alias("class_id"))
    own = classes.withColumn("class", F.coalesce("root", "node")).join(named, "class").select("key", "class_id", "n_copies")
    out = signed.select("doc_id", "key").join(own, "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def drop_near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of docs, all columns, one for each class of near_duplicates(): one with the class's least doc_id (null ids come last), and of those with the least text key.

    Rows with a null text are kept. Repeated rows are the same document, of which any one is kept.
    """
    _, classes = _classes(docs, least)
    first = F.min(F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("key"))).alias("first")
    kept = classes.groupBy(F.coalesce("root", "node").alias("class")).agg(first).select(F.col("first.key").alias("_text_key"), F.col("first.least_id").alias("_least_id"))
    found = with_key(docs).join(kept.hint("merge"), "_text_key").where(F.col("doc_id").eqNullSafe(F.col("_least_id")))
    return found.dropDuplicates(["_text_key"]).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("text is null"))
