"""Substring deduplication by prefix-partitioned suffix trees.

A window is 20 consecutive words; the suffixes that matter begin at windows. Each window has an
anchor, the run of 8 words in it with the least hash, so equal windows have equal anchors at equal
places. Chunks of documents first learn how often each of their anchors occurs in the corpus, and
drop windows whose anchor occurs once. The others are dealt to groups by a prefix of variable
length: windows of an anchor that occurs up to HOT times by the anchor's 8 words, neighbouring
windows of one anchor together; windows of more frequent anchors by all their 20 words, each on its
own. A chunk sends equal content once. There are as many groups as chunks, so that a group fits in
memory whatever the input; windows of one frequent content come to a group from up to FAN chunks at
a time, and only the earliest goes on to meet those of other chunks.

A group builds the suffix array of its windows, with the lengths of common prefixes of neighbours:
intervals of the array with at least 20 words in common are the deep internal nodes of its suffix
tree. Of the windows below such a node the earliest stays and the others are repeats; runs of
repeated windows are maximal repeats. All comparisons are of words; hashes only choose where.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunked, documents_of
from .common import blob, collect_garbage, distinct, materialize, ranked
from .neardup import _mix, word_hashes

WINDOW, ANCHOR = 20, 8
#: Occurrences from which an anchor's windows are dealt by all their words, and chunks whose windows of one content meet at a time.
HOT, FAN = 256, 4096
_SPAN = WINDOW - ANCHOR + 1


class _Chunk:
    """The words of a chunk's documents as one list, its windows and their anchors."""

    def __init__(self, table: pa.Table):
        found = documents_of(table)
        self.docs = [d for d, _ in found]
        self.words: list[bytes] = []
        bounds = [0]
        for _, text in found:
            self.words += text.split()
            bounds.append(len(self.words))
        self.bounds = np.array(bounds, np.int64)
        n = len(self.words)
        lens = np.diff(self.bounds)
        self.doc_of = np.repeat(np.arange(len(found)), lens)
        if n < WINDOW:
            self.windows = self.anchor = self.hash = np.zeros(0, np.int64)
            return
        w = word_hashes(self.words)
        h = np.zeros(n - ANCHOR + 1, np.uint64)
        for k in range(ANCHOR):
            h = _mix(h + w[k : n - ANCHOR + 1 + k] + np.uint64(k + 1))
        least = h.copy()
        reach = 1
        while 2 * reach <= _SPAN:  # least of 1, 2, 4, 8 hashes in a row
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: n - WINDOW + 1], least[_SPAN - reach :][: n - WINDOW + 1])
        at = np.zeros(n - WINDOW + 1, np.int64)
        for k in range(_SPAN - 1, -1, -1):
            at[h[k : k + len(at)] == least] = k
        self.windows = np.flatnonzero(self.doc_of[: n - WINDOW + 1] == self.doc_of[WINDOW - 1 :])
        self.anchor = self.windows + at[self.windows]
        self.hash = least[self.windows]
        self.word_hash = w

    def window_hash(self, at: np.ndarray) -> np.ndarray:
        """A hash of the 20 words from each place on."""
        h = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            h = _mix(h + self.word_hash[at + k] + np.uint64(k + 1))
        return h

    def buckets(self, n: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Distinct anchor hashes by bucket, in order, and all of them sorted; buckets are ranges of the hash."""
        known = distinct(self.hash)
        own = _bucket(known, n)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        return [(int(own[a]), known[a:b]) for a, b in zip(at, np.append(at[1:], len(known)))], known


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) * n >> 32


def _packed(chunk: int, parts: list[tuple[int, dict[str, bytes]]], names: list[str]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int32()), "bucket": pa.array([b for b, _ in parts], pa.int32())} | {n: pa.array([p[n] for _, p in parts], pa.binary()) for n in names})


def repeated_windows(docs: DataFrame, hot: int = HOT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs (doc_id, text, chunk) and, packed by chunk, the windows that repeat an earlier one.

    A row of the second has chunk, and as arrays: document (its place in the chunk's order), first
    window's place in the document's words and number of windows.
    """
    spark = docs.sparkSession
    rows, n_chunks, n_buckets = chunked(docs)

    def ask(table):
        chunk = _Chunk(table)
        parts, known = chunk.buckets(n_buckets)
        # an anchor occurs as often as there are places it stands at
        at = np.flatnonzero(np.diff(chunk.anchor, prepend=-1)) if len(chunk.anchor) else np.zeros(0, np.int64)
        count = np.minimum(np.bincount(np.searchsorted(known, chunk.hash[at]), minlength=len(known)), 255).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        out, lo = [], 0
        for bucket, own in parts:
            out.append((bucket, {"hashes": blob(own), "counts": blob(count[lo : lo + len(own)])}))
            lo += len(own)
        return _packed(table.column("chunk")[0].as_py(), out, ["hashes", "counts"])

    def answer(table):
        """For each asked anchor 0, 1 or 2: it occurs once, repeatedly, or more than HOT times."""
        chunks = table.column("chunk").to_pylist()
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        value, inverse = ranked(np.concatenate(hashes))
        total = np.bincount(inverse, counts, len(value))
        kind = ((total > 1).astype(np.uint8) + (total > hot))[inverse]
        lo, out = 0, []
        bucket = table.column("bucket")[0].as_py()
        for h in hashes:
            out.append((bucket, {"again": blob(kind[lo : lo + len(h)])}))
            lo += len(h)
        done = _packed(0, out, ["again"])
        return done.set_column(0, "chunk", pa.array(chunks, pa.int32()))

    def cut(left, right):
        """Stretches of windows for the groups; bucket -1 has the windows that repeat within the chunk."""
        if not left.num_rows:
            return _group_rows([], [])
        chunk = _Chunk(left)
        parts, known = chunk.buckets(n_buckets)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("again").to_pylist()))
        kind = np.concatenate([np.frombuffer(answers[b], np.uint8) for b, _ in parts]) if parts else np.zeros(0, np.uint8)
        kind = kind[np.searchsorted(known, chunk.hash)] if len(known) else kind
        # stretches: runs of neighbouring windows with one anchor, or single windows of a hot one
        run = np.flatnonzero((np.diff(chunk.anchor, prepend=-1) != 0) | (kind == 2)) if len(kind) else np.zeros(0, np.int64)
        ends = np.append(run[1:], len(chunk.anchor)) if len(run) else run
        ok = kind[run] > 0 if len(run) else np.zeros(0, bool)
        run, ends = run[ok], ends[ok]
        groups: dict[tuple[int, int], list] = {}
        seen: set = set()
        inner: list[tuple[int, int, int]] = []
        if len(run):
            single, prefix = kind[run] == 2, chunk.hash[run].copy()
            prefix[single] = chunk.window_hash(chunk.windows[run[single]])
            dealt = list(zip(_bucket(prefix, n_buckets).tolist(), single.astype(int).tolist()))
        for a, b, group in zip(run.tolist(), ends.tolist(), dealt if len(run) else ()):
            lo, n = int(chunk.windows[a]), b - a
            doc = int(chunk.doc_of[lo])
            start, rel = lo - int(chunk.bounds[doc]), int(chunk.anchor[a]) - lo
            words = b" ".join(chunk.words[lo : lo + n + WINDOW - 1])
            if (rel, words) in seen:
                inner.append((doc, start, n))
            else:
                seen.add((rel, words))
                groups.setdefault(group, []).append((doc, start, n, words))
        out = [(left.column("chunk")[0].as_py(), bucket, alone, own, [chunk.docs[x[0]] for x in own]) for (bucket, alone), own in groups.items()]
        return _group_rows(out, [(left.column("chunk")[0].as_py(), inner)] if inner else [])

    answers = rows.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, again binary")
    stretches = materialize(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, _ROWS), "stretches")
    collect_garbage(spark)

    repeats = [stretches.where("words is null").select(_SPANS)]
    todo, reach = stretches.where("words is not null"), fan
    while True:
        # windows of frequent content from a range of chunks at a time, others all at once
        last = reach >= n_chunks
        level = todo.withColumn("salt", F.when(F.col("alone"), F.floor(F.col("chunk") / reach)).otherwise(F.lit(0)).cast("int"))
        found = materialize(level.groupBy("bucket", "alone", "salt").applyInArrow(_subtree(not last), _ROWS), "repeats")
        repeats.append(found.where("words is null").select(_SPANS))
        if last:
            break
        todo, reach = found.where("words is not null"), reach * fan
    out = repeats[0]
    for r in repeats[1:]:
        out = out.unionByName(r)
    return rows, out


_SPANS = ["chunk", "doc", "start", "size"]
_ROWS = "chunk int, bucket int, alone boolean, doc binary, start binary, size binary, words binary, ids binary"
_NULL_ID = -(1 << 63)


def _group_rows(stretches: list, spans: list) -> pa.Table:
    """Rows for groups, from (chunk, bucket, alone, [(doc, start, size, words)], ids), and of repeated windows, from (chunk, [(doc, start, size)])."""
    packed: list[list] = [[] for _ in range(8)]
    for chunk, bucket, alone, own, ids in stretches + [(c, -1, 0, own, None) for c, own in spans]:
        d, s, n = (np.array([x[k] for x in own], np.int32) for k in range(3))
        words = None if ids is None else b"\n".join([x[3] for x in own])
        named = None if ids is None else blob(np.array([_NULL_ID if i is None else i for i in ids], np.int64))
        for column, value in zip(packed, (chunk, bucket, bool(alone), blob(d), blob(s), blob(n), words, named)):
            column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(_ROWS.split(", "), packed, kinds)})


def _suffix_array(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at some places of words (numbers), and how many words each has in common with the one before it in that order.

    left: how many words each suffix has; at least WINDOW. Suffixes are told apart by up to 32 words.
    """
    ranks, depth = [words], 1
    while 2 * depth <= 16:
        cur = ranks[-1]
        pair = cur * (int(cur.max()) + 1)
        pair[: len(cur) - depth] += cur[depth:]
        ranks.append(ranked(pair)[1].astype(np.int64))
        depth *= 2
    whole = np.append(ranks[-1], 0)
    order = np.lexsort((whole[np.minimum(at + 16, len(words))], whole[at]))
    p, q, common = at[order[:-1]].copy(), at[order[1:]].copy(), np.zeros(max(0, len(order) - 1), np.int64)
    for depth, rank in zip((16, 16, 8, 4, 2, 1), (*ranks[:3:-1], *ranks[::-1])):
        x, y = np.minimum(p, len(words) - 1), np.minimum(q, len(words) - 1)
        same = (rank[x] == rank[y]) & (np.maximum(p, q) < len(words))
        for v in (p, q, common):
            v[same] += depth
    return order, np.concatenate(([0], np.minimum(common, np.minimum(left[order[:-1]], left[order[1:]]))))


def _subtree(keep_first: bool):
    """The function of a group: its windows that repeat an earlier one, by chunk; and the earliest of each content, if they go on."""

    def run(table):
        chunks = table.column("chunk").to_pylist()
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        per = read("size", np.int32)
        chunk = np.repeat(np.array(chunks, np.int64), [len(x) for x in per])
        doc, start, size, ids = np.concatenate(read("doc", np.int32)), np.concatenate(read("start", np.int32)), np.concatenate(per), np.concatenate(read("ids", np.int64))
        texts = [s for x in table.column("words").to_pylist() for s in x.split(b"\n")]
        number: dict[bytes, int] = {}
        words = np.array([number.setdefault(w, len(number)) for s in texts for w in s.split(b" ")], np.int64)
        lens = size.astype(np.int64) + WINDOW - 1
        first = np.cumsum(lens) - lens
        stretch = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(stretch)) - np.repeat(np.cumsum(size) - size, size)
        place = start[stretch].astype(np.int64) + inside
        order, common = _suffix_array(words, first[stretch] + inside, lens[stretch] - inside)
        node = np.zeros(len(order), np.int64)
        node[order] = np.cumsum(common < WINDOW)
        order = np.lexsort((place, doc[stretch], chunk[stretch], ids[stretch], node))
        again = np.zeros(len(order), bool)
        again[order[1:]] = node[order[1:]] == node[order[:-1]]
        # runs of repeats within a stretch
        hit = np.flatnonzero(again)
        new = (np.diff(hit, prepend=-2) != 1) | (np.diff(stretch[hit], prepend=-1) != 0)
        a = hit[new]
        n = np.diff(np.append(np.flatnonzero(new), len(hit)))
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for c, d, s, m in zip(chunk[stretch[a]].tolist(), doc[stretch[a]].tolist(), place[a].tolist(), n.tolist()):
            spans.setdefault(c, []).append((d, s, m))
        out: dict[int, tuple[list, list]] = {}
        if keep_first and table.column("alone")[0].as_py():
            for k in np.flatnonzero(~again).tolist():
                own = out.setdefault(int(chunk[k]), ([], []))
                own[0].append((int(doc[k]), int(start[k]), 1, texts[k]))
                own[1].append(int(ids[k]))
        bucket = table.column("bucket")[0].as_py()
        return _group_rows([(c, bucket, 1, own, named) for c, (own, named) in out.items()], list(spans.items()))

    return run


def drop_repeats(docs: DataFrame, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept_text, the words outside every window that repeats an earlier one.

    Earlier is: a smaller doc_id, or an earlier start in the same document; a null doc_id comes
    first, and rows of one doc_id are ordered by their chunk, then their text. Null and empty texts have no words;
    repeated rows repeat each other; an empty table gives no rows; extra columns are ignored.
    """
    rows, repeats = repeated_windows(docs, hot, fan)

    def finish(left, right):
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _KEPT.items()})
        found = documents_of(left)
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, s, n in zip(*(right.column(x).to_pylist() for x in ("doc", "start", "size"))):
            for x, a, m in zip(np.frombuffer(d, np.int32).tolist(), np.frombuffer(s, np.int32).tolist(), np.frombuffer(n, np.int32).tolist()):
                spans.setdefault(x, []).append((a, a + m + WINDOW - 1))
        out: list[list] = [[], [], [], []]
        for k, (doc, text) in enumerate(found):
            words = text.split()
            kept, at = [], 0
            for a, b in sorted(spans.get(k, ())):
                kept += words[at:a] if a > at else []
                at = max(at, b)
            kept += words[at:]
            for column, value in zip(out, (doc, len(words), len(words) - len(kept), b" ".join(kept))):
                column.append(value)
        return pa.table({k: pa.array(v, pa.binary() if k == "kept_text" else t).cast(t) for (k, t), v in zip(_KEPT.items(), out)})

    return rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")


_KEPT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string()}
