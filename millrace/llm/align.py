"""Cross-tokenizer alignment: which tokens of two public tokenizers cover the same bytes of a text.

Both tokenizers work on a space and the text: the byte-level one gets the space, the piece model
adds its own. A text is cut before each single space between two characters that are no white
space. There the byte-level pre-tokenizer begins a piece, and the piece model, none of whose pieces
holds a word mark after another character (checked when it is loaded), begins one as well; so a cut
stretch has the same tokens wherever it stands, and both tokenizers end a token at its end.

A task takes its documents in units of a bounded number of characters. The distinct stretches of a
unit are laid end to end, and DuckDB holds the token intervals of both tokenizers on that line: a
window sum over common ends numbers the groups, an ASOF join finds the token in which another begins,
and a range join within a group those that begin inside it. A document's figures are sums over its
stretches. Each unit sends every id pair once, with the number of its documents that hold it; Spark adds the counts,
marks the best of each id, and sends them back to the unit, whose documents and links stand written.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct, materialize, slices, strings_of
from .tokens import default_vocabulary

#: Characters of a unit of documents; a longer document is a unit of its own.
UNIT_CHARS = 6 << 20
#: Stretches whose alignment a worker keeps, and the longest that it keeps.
KEEP, LONGEST = 100_000, 32
#: Characters of stretches that DuckDB aligns at once.
LINE_CHARS = 1 << 20
#: Pairs of documents that are told apart at once; those of one document are taken whole.
_STEP = 1 << 20
#: Characters of a stretch that is encoded in one line with others: longer ones, and those of other characters than these, go to the library one by one.
_SHORT, _PLAIN = 256, re.compile(r"[!-~À-ɏ](?:[\t\n\r -~À-ɏ]*[!-~À-ɏ])?")
# Fixed value: the pattern by which the byte-level tokenizer cuts pieces.
_PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], "Aligner"] = {}

_NUMBERED = """
CREATE OR REPLACE TEMP TABLE {0} AS
SELECT x.stretch, x.id, x.pos, x.stop, count(y.stop) OVER (ORDER BY x.pos ROWS UNBOUNDED PRECEDING) - (y.stop IS NOT NULL)::INT AS grp
FROM {1} x LEFT JOIN {2} y ON x.stop = y.stop
"""
_LINKS = """
SELECT a.stretch, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.pos >= b.pos
UNION ALL
SELECT a.stretch, a.id, b.id FROM a JOIN b ON a.grp = b.grp AND b.pos > a.pos AND b.pos < a.stop
"""
_GROUPS = """
SELECT stretch, grp, side, id FROM (SELECT 0 AS side, * FROM a UNION ALL SELECT 1, * FROM b) ORDER BY grp, side, pos
"""


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers and the stretches that the worker has aligned."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import duckdb
        import sentencepiece

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(bytes_path)
        self.first.encode_special_tokens = True  # their strings are text
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        symbols = {c: b for b, c in _byte_symbols().items()}
        tokens = list(map(self.first.id_to_token, range(self.first.get_vocab_size())))
        added = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.bytes_a = [t.encode() if t in added else bytes(symbols[c] for c in t) for t in tokens]
        self.joined = _by_ranks(bytes_path, tokens, added, self.bytes_a)
        sp = self.second
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.words = np.array([[m + str(i) for i in range(max(len(tokens), len(names)))] for m in ("", ";", "|", ",")], object)
        self.kept: dict[str, tuple[int, int, int, str, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": True})

    def stretches(self, text: str) -> list[str]:
        """Parts of a text whose tokens do not depend on their neighbours, each without the space before it."""
        return (_CUT.split(text) if self.cuts else [text]) if text else []

    def align(self, parts: list[str], times: np.ndarray) -> list[tuple[int, int, int, str, bytes]]:
        """The alignment of each of some distinct stretches, which occur so many times here: numbers of tokens of both and of groups, the groups as text, and the linked pairs (a << 32 | b as 64-bit integers, with repeats). All empty where a tokenizer does not give the bytes back."""
        kept = self.kept
        out = list(map(kept.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        plain = [i for i in missing if len(parts[i]) <= _SHORT and _PLAIN.fullmatch(parts[i])] if self.joined else []
        for group, joined in ((plain, True), (sorted(set(missing).difference(plain)), False)):
            for lo, hi in slices([len(parts[i]) for i in group], LINE_CHARS):
                for i, x in zip(group[lo:hi], self._fresh([parts[i] for i in group[lo:hi]], joined)):
                    out[i] = x
        again = [i for i in missing if times[i] > 1 and len(parts[i]) <= LONGEST][:KEEP]
        if len(kept) + len(again) > KEEP:
            kept.clear()
        kept.update((parts[i], out[i]) for i in again)
        return out

    def _fresh(self, parts: list[str], joined: bool) -> list[tuple[int, int, int, str, bytes]]:
        whole = [b" " + p.encode() for p in parts]
        line = b"".join(whole)
        if joined:
            flat_a = np.array(self.joined.encode_ordinary(line.decode()), np.int64)
            ends = np.searchsorted(self.size_a[flat_a].cumsum(), np.cumsum(list(map(len, whole))), side="right")
            n_a = np.diff(ends, prepend=0)
        else:
            a = [x.ids for x in self.first.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
            n_a = np.array(list(map(len, a)))
            flat_a = np.fromiter(itertools.chain.from_iterable(a), np.int64, int(n_a.sum()))
        b = self.second.encode(parts, num_threads=1)
        n_b = np.array(list(map(len, b)))
        flat_b = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(n_b.sum()))
        if b"".join([self.bytes_a[i] for i in flat_a.tolist()]) != line or b"".join([self.bytes_b[i] for i in flat_b.tolist()]) != line:
            a = np.split(flat_a, n_a.cumsum()[:-1])
            good = [k for k, w in enumerate(whole) if b"".join([self.bytes_a[i] for i in a[k].tolist()]) == w and b"".join([self.bytes_b[i] for i in b[k]]) == w]
            out = [_EMPTY] * len(parts)
            if good:
                for k, x in zip(good, self._fresh([parts[k] for k in good], joined)):
                    out[k] = x
            return out
        db = self.db
        db.register("first", _intervals(flat_a, n_a, self.size_a))
        db.register("second", _intervals(flat_b, n_b, self.size_b))
        db.execute(_NUMBERED.format("a", "first", "second"))
        db.execute(_NUMBERED.format("b", "second", "first"))
        links, groups = db.sql(_LINKS).to_arrow_table(), db.sql(_GROUPS).to_arrow_table()
        for name in ("first", "second"):
            db.unregister(name)
        at = links.column("stretch").to_numpy()
        order = at.argsort(kind="stable")
        pairs = ((links.column("a").to_numpy() << 32) | links.column("b").to_numpy())[order].tobytes()
        each = np.arange(len(parts) + 1)
        ends = (np.searchsorted(at[order], each) * 8).tolist()
        stretch, number, side, ids = (groups.column(c).to_numpy() for c in ("stretch", "grp", "side", "id"))
        fresh = np.diff(number, prepend=-1) != 0
        # what stands before an id: nothing at the head of a stretch, else the mark of a new group, of the other side, or of the same
        mark = np.where(np.diff(stretch, prepend=-1) != 0, 0, np.where(fresh, 1, np.where(np.diff(side, prepend=0) != 0, 2, 3)))
        words = self.words[mark, ids].tolist()
        begins = np.searchsorted(stretch, each)
        n_groups = np.add.reduceat(fresh.astype(np.int64), begins[:-1])
        begins = begins.tolist()
        told = ["".join(words[i:j]) for i, j in zip(begins, begins[1:])]
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), told, [pairs[i:j] for i, j in zip(ends, ends[1:])]))


_EMPTY = (0, 0, 0, "", b"")


def _intervals(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Tokens of stretches that lie end to end: stretch, id and byte range."""
    width = sizes[ids]
    stop = np.cumsum(width)
    return pa.table({"stretch": np.repeat(np.arange(len(counts)), counts), "id": ids, "pos": stop - width, "stop": stop})


def _by_ranks(path: str, tokens: list[str], added: set[str], told: list[bytes]):
    """The same vocabulary as ranks, which encodes a long line several times as fast; None where the merges are not in the order of the ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    plain = [t for t in tokens if t not in added]
    if plain != tokens[: len(plain)] or ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges] != plain[256:]:
        return None
    return tiktoken.Encoding("joined", pat_str=_PIECE, mergeable_ranks={told[i]: i for i in range(len(plain))}, special_tokens={})


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    key = (bytes_path, pieces_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


_FIELDS = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stretches binary, links binary, sizes binary, a int, b int, place int, docs long"


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ranges of an int32 array as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(values, np.int32))]).cast(pa.binary())


def _places(n: int) -> type:
    """The integers that hold the places of n pairs."""
    return np.uint16 if n <= 1 << 16 else np.uint32


_SCHEMA = pa.schema([("unit", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.binary()) for c in ("stretches", "links", "sizes")), *((c, pa.int32()) for c in ("a", "b", "place")), ("docs", pa.int64())])


def _rows(unit: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, unit)), *(columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)


def _unit(own: Aligner, unit: int, ids: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a unit, one of the pairs that its stretches link, then one for each id pair that its documents hold."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    found = [list(map(number.__getitem__, own.stretches(t))) for t in texts]
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, sum(map(len, found)))
    aligned = own.align(list(number), np.bincount(flat, minlength=len(number)))
    bad = {i for i, x in enumerate(aligned) if x is _EMPTY}
    if bad:
        found = [[] if not bad.isdisjoint(x) else x for x in found]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, sum(map(len, found)))
    n_a, n_b, n_groups, told, pairs = zip(*aligned) if aligned else ((),) * 5
    sha = [hashlib.sha256(";".join(map(told.__getitem__, x)).encode()).hexdigest() if x else "" for x in found]
    sizes = np.array(list(map(len, found)), np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    lengths = np.array(list(map(len, pairs)), np.int64) // 8
    columns = {"doc_id": pa.array(ids, pa.int64()), "groups_sha256": pa.array(sha, pa.string()), "stretches": _blobs(flat, bounds)}
    for name, figure in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", lengths)):
        columns[name] = pa.array(_sums(np.array(figure, np.int64), flat, bounds))
    yield _rows(unit, len(texts), columns)
    if not len(flat):
        return
    known, code = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_inverse=True)
    # which pairs each stretch links, as places among the unit's pairs
    yield _rows(unit, 1, {"links": pa.array([code.astype(_places(len(known))).tobytes()], pa.binary()), "sizes": pa.array([lengths.astype(np.uint32).tobytes()], pa.binary())})
    count = _documents(np.repeat(np.arange(len(texts)), sizes), flat, code, lengths, len(known))
    live = np.flatnonzero(count)  # the others stand only in documents without tokens
    ids_a, ids_b = (known[live] >> 32).astype(np.int32), (known[live] & 0xFFFFFFFF).astype(np.int32)
    yield _rows(unit, len(live), {"a": pa.array(ids_a), "b": pa.array(ids_b), "place": pa.array(live.astype(np.int32)), "docs": pa.array(count[live])})


def _sums(figure: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a stretch's figure over each document's stretches."""
    running = np.concatenate(([0], figure[flat].cumsum()))
    return running[bounds[1:]] - running[bounds[:-1]]


def _documents(doc: np.ndarray, flat: np.ndarray, code: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """How many documents hold each of n pairs in some stretch."""
    held = distinct(doc * len(lengths) + flat)  # each document's distinct stretches
    doc, stretch = np.divmod(held, len(lengths))
    begins, size = np.cumsum(lengths) - lengths, lengths[stretch]
    count = np.zeros(n, np.int64)
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    weights = np.add.reduceat(size, firsts)
    for lo, hi in slices(weights, _STEP):
        own = slice(firsts[lo], firsts[hi] if hi < len(firsts) else len(doc))
        k = size[own]
        at = np.arange(int(k.sum())) + np.repeat(begins[stretch[own]] - (np.cumsum(k) - k), k)
        count += np.bincount(distinct(np.repeat(doc[own], k) * n + code[at]) % n, minlength=n)
    return count


def align(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    Null and empty texts, and texts that a tokenizer does not give back byte by byte (those with
    U+2581, which the piece model reads as a space), have no tokens: zeros and ''. Repeated rows
    count as documents of their own; an empty table gives no rows; other columns are ignored. A
    pair that ties for the highest count of its first id is best as well.
    """
    paths = (bytes_path or default_vocabulary(), pieces_path or default_pieces())

    def run(batches):
        from pyspark import TaskContext

        own, unit = aligner(*paths), TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes, unit_chars):
                part = batch.slice(lo, hi - lo)
                yield from _unit(own, unit, part.column("doc_id").to_pylist(), strings_of(part.column("text")))
                unit += 1

    units = materialize(docs.select("doc_id", "text").mapInArrow(run, _FIELDS), "alignment")
    pairs = units.where("a is not null").select("unit", "a", "b", "place", "docs")
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    marked = totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    answers = pairs.join(marked, ["a", "b"]).select(F.col("unit").alias("asked"), "place", "n", "best")
    rows = units.where("a is null").select("unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "stretches", "links", "sizes")

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        documents, whole = left.filter(pc.is_null(left.column("sizes"))), left.filter(pc.is_valid(left.column("sizes"))).to_pylist()
        own = [np.frombuffer(x, np.int32) for x in documents.column("stretches").to_pylist()]
        flat, bounds = np.concatenate([np.empty(0, np.int32), *own]), np.concatenate(([0], np.cumsum(list(map(len, own)), dtype=np.int64)))
        totals = np.zeros((len(own), 2), np.int64)
        if whole:
            sizes = np.frombuffer(whole[0]["sizes"], np.uint32).astype(np.int64)
            width = np.uint16 if len(whole[0]["links"]) == 2 * sizes.sum() else np.uint32
            code = np.frombuffer(whole[0]["links"], width)
            ends = np.cumsum(sizes)
            place = right.column("place").to_numpy()
            for k, name in enumerate(("best", "n")):
                answer = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int64)
                answer[place] = right.column(name).to_numpy(zero_copy_only=False)
                running = np.concatenate(([0], answer[code].cumsum()))
                totals[:, k] = _sums(running[ends] - running[ends - sizes], flat, bounds)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(documents.column(c) for c in names), pa.array(totals[:, 0]), pa.array(totals[:, 1]), documents.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("unit").cogroup(answers.groupBy("asked")).applyInArrow(close, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
