"""Token ids of whole texts by the public tokenizers library.

A space before a character that is no white space always begins a new piece of byte-level BPE's
pre-tokenizer, and so does the last white space of any run; the words between them are encoded on
their own. Arrow cuts many texts into words at once and numbers the distinct ones; only these
become Python strings. Their pieces go to the library's model, and a worker keeps the ids of pieces
it has met. Words beyond a plain range of characters, where the classes of the pre-tokenizer and of
Python's ``re`` might differ, go to the library whole, and so do texts that hold the string of an
added token.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, slices

#: Pieces kept by a worker at most; a store that is full keeps those of the texts at hand. Longer pieces are not kept.
KEEP_PIECES, LONGEST = 350_000, 48
#: Characters of texts that are encoded at once.
_STEP = 1 << 22
_PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ɏ]*")
#: Letters, after a space or a line feed, and the marks that may follow them (an apostrophe may not): a piece each, and the line feed one.
_LETTERS, _MARKS = "^[ \\n]?[A-Za-zÀ-ÖØ-öø-ɏ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SIMPLE = f"{_LETTERS}[{re.escape(_MARKS)}]*$"
#: White space, as a class of Arrow's expressions.
_SPACE = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace())
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}
_CUT = re.compile(r" (?=\S)")
#: Kinds of words, as bits: white space at the end; nothing or a line feed alone; other white space at the start.
_TRAIL, _BLANK, _LEAD = 1, 2, 4
if sys.byteorder != "little":
    raise ImportError("ids are written as the machine's own integers, which must be little-endian")
_LOADED: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return next(self.each([text]))

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, by steps of a bounded size."""
        for lo, hi in slices(list(map(len, texts)), _STEP):
            phrases, numbers, counts = self.phrases(pa.array(texts[lo:hi], pa.large_string()))
            sizes = np.array(list(map(len, phrases)), np.int64)
            data = np.frombuffer(b"".join(phrases), "<u4")[ragged(sizes // 4, numbers)].tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes[numbers])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            yield from (data[a:b] for a, b in zip(ends, ends[1:]))

    def phrases(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct phrases of texts without nulls: the ids of each, the numbers of the phrases of all texts in order, and how many each text has."""
        if not len(texts):
            return [], np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = parts.offsets.to_numpy()
        found = parts.flatten().dictionary_encode()
        numbers, words = found.indices.to_numpy().copy(), found.dictionary
        heads, counts = offsets[:-1], np.diff(offsets)
        apart = _apart(words, numbers, heads)
        for a in self.added:
            apart |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        del parts, found  # the words of all texts
        first, place = np.unique(numbers[heads], return_inverse=True)
        numbers[heads] = len(words) + place
        spaced = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type)))
        source, single = [spaced, words.take(pa.array(first))], []
        if apart.any():
            more, single, numbers, counts = self._replaced(texts, np.flatnonzero(apart), len(words) + len(first), numbers, counts)
            source.append(more)
        strings = pa.concat_arrays(source)
        used, numbers = _renumbered(numbers, len(strings) + len(single))
        encoded = self._encoded(strings.take(pa.array(used[used < len(strings)])))
        return encoded + [_bytes([single[k]]) for k in (used[used >= len(strings)] - len(strings)).tolist()], numbers, counts

    def _replaced(self, texts: pa.Array, rows: np.ndarray, base: int, numbers: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, list[int], np.ndarray, np.ndarray]:
        """numbers and counts with some rows cut one text at a time, before them new strings (from number base on) and, where the library cuts, ids."""
        strings: dict[str, int] = {}
        ids: dict[int, int] = {}
        own = []
        for i in rows.tolist():
            text = texts[i].as_py()
            if any(a in text for a in self.added):
                cut = self.tokenizer.encode(text, add_special_tokens=False).ids
                own.append(np.array([-1 - ids.setdefault(x, len(ids)) for x in cut], np.int32))
            else:
                head, *rest = _CUT.split(text)
                own.append(np.array([strings.setdefault(x, len(strings)) for x in (head, *(" " + p for p in rest))], np.int32))
        kept = np.ones(len(counts), bool)
        kept[rows] = False
        before, counts = np.repeat(kept, counts), counts.copy()
        counts[rows] = list(map(len, own))
        out, stays, new = np.empty(int(counts.sum()), np.int32), np.repeat(kept, counts), np.concatenate(own)
        out[stays], out[~stays] = numbers[before], base + np.where(new < 0, len(strings) - 1 - new, new)
        return pa.array(list(strings), pa.large_string()), list(ids), out, counts

    def _encoded(self, parts: pa.Array) -> list[bytes]:
        """Ids of distinct strings that begin pieces and end them."""
        plain = pc.match_substring_regex(parts, _SIMPLE)
        simple, others = parts.filter(plain), _listed(parts.filter(pc.invert(plain)))
        marks = pc.replace_substring_regex(simple, _LETTERS, "").dictionary_encode()
        lines, letters = pc.starts_with(simple, "\n"), pc.utf8_ltrim(pc.utf8_rtrim(simple, _MARKS), "\n").dictionary_encode()
        cut = list(map(_pieces, others))
        bodies, tails = _listed(letters.dictionary), _listed(marks.dictionary)
        known = self.pieces
        need = {"\n", *bodies, *tails, *(x for c in cut if c for x in c)}
        fresh = [x for x in need if x not in known]
        if len(known) + len(fresh) > KEEP_PIECES:
            known = self.pieces = {x: known[x] for x in need if x in known}
        tokenize = self.model.tokenize
        known.update((x, _bytes([t.id for t in tokenize(_symbols(x))])) for x in fresh)
        first, second = ([known[x] for x in own] for own in (bodies, tails))
        del need, bodies, tails
        out = np.empty(len(parts), object)
        flags = plain.to_numpy(zero_copy_only=False)
        ahead = b"", known["\n"]
        out[flags] = [ahead[n] + first[k] + second[m] for n, k, m in zip(_listed(lines), _listed(letters.indices), _listed(marks.indices))]
        # without pieces the library cuts it
        out[~flags] = [_bytes(self.tokenizer.encode(x, add_special_tokens=False).ids) if c is None else b"".join([known[y] for y in c]) for x, c in zip(others, cut)]
        for x in fresh:
            if len(x) > LONGEST:
                del known[x]
        if len(known) > KEEP_PIECES:
            known.clear()
        return out.tolist()


def _apart(words: pa.Array, numbers: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which texts have white space that is not cut where a piece begins: runs of more than two, or of other characters."""
    kinds = np.zeros(len(words), np.uint8)
    odd = np.flatnonzero(pc.match_substring_regex(words, f"^$|^[{_SPACE}]|[{_SPACE}]$").to_numpy(zero_copy_only=False))
    kinds[odd] = [_BLANK if p in ("", "\n") else p[-1].isspace() | (_LEAD if p[0].isspace() and (p[0] != "\n" or p[1].isspace()) else 0) for p in _listed(words.take(pa.array(odd)))]
    kind = kinds[numbers]
    kind[heads] &= _TRAIL
    after = np.zeros(len(kind), bool)
    after[1:] = kind[:-1] & (_BLANK | _TRAIL) != 0
    after[heads] = False
    return np.logical_or.reduceat((kind & _LEAD != 0) | (kind & _BLANK != 0) & after, heads)


def _renumbered(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n that occur, and each one's place among them."""
    there = np.bincount(numbers, minlength=n) > 0
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[numbers]


def _listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _symbols(piece: str) -> str:
    """The bytes of a piece as the model's symbols: printable ones are themselves, others have characters from U+0100 on."""
    if piece.isascii() and piece[1:].isalnum():
        return "\u0120" + piece[1:] if piece[0] == " " else piece if piece[0] > " " else piece.translate(_SYMBOL)
    return piece.encode().decode("latin-1").translate(_SYMBOL)


def _pieces(part: str) -> list[str] | None:
    """The part as pieces of the pre-tokenizer; None where its characters are not plain."""
    if part[:1] == "\n" and not part[1:2].isspace():
        rest = _pieces(part[1:])
        return None if rest is None else ["\n", *rest]
    letters = part.rstrip(".,;:!?")
    if (letters[1:] if letters[:1] == " " else letters).isalpha() and (letters.isascii() or _PLAIN.fullmatch(letters)):
        return [letters] if len(letters) == len(part) else [letters, part[len(letters) :]]
    return _PIECE.findall(part) if _PLAIN.fullmatch(part) else None


def forget_pieces() -> None:
    """Empty the worker's stores, where other large arrays follow."""
    for e in _LOADED.values():
        e.pieces.clear()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
