"""Baseline JPEG: an encoder of bytes as DC coefficients, and a decoder of DC-only luminance thumbnails.

The encoder stores one byte in each 8x8 block as the block's only coefficient, so a frame is a
grey image whose DC thumbnail is the payload, byte by byte. Restart markers cut the scan into
intervals. The decoder parses the markers of any baseline frame (one scan, any sampling), and
decodes the intervals of many frames at once: all of them advance symbol by symbol in numpy.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

#: Blocks in a row of our frames, blocks in a restart interval, and blocks in a frame at most (sides have 16 bits).
ROW, INTERVAL, FRAME = 24, 96, 24 * 8184
#: Payload bytes that are coded at once.
_STEP = 1 << 19
# fixed values: the standard's luminance DC table (codes of each length, then symbols), and an AC table of the end of block alone
_DC_BITS, _DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
_AC_BITS, _AC_SYMBOLS = (1, *[0] * 15), (0,)
_QUANT = 8  # the DC coefficient of a flat block is 8 times its level


def huffman_codes(bits, symbols) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol of a table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a DC difference of -255 to 255 and the end of block."""
    dc, (eob, eob_bits) = huffman_codes(_DC_BITS, _DC_SYMBOLS), huffman_codes(_AC_BITS, _AC_SYMBOLS)[0]
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = dc[size]
        c = c << size | (d if d >= 0 else d + (1 << size) - 1)
        code[d + 255], length[d + 255] = c << eob_bits | eob, n + size + eob_bits
    return code, length


_CODE, _LENGTH = _diff_codes()


def _header(rows: int) -> bytes:
    table = lambda kind, bits, symbols: b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(symbols), kind) + bytes(bits) + bytes(symbols)
    return b"".join((
        b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00",
        b"\xff\xdb\x00\x43\x00", bytes([_QUANT] * 64),
        b"\xff\xc0", struct.pack(">HBHHBBBB", 11, 8, rows * 8, ROW * 8, 1, 1, 0x11, 0),
        table(0x00, _DC_BITS, _DC_SYMBOLS), table(0x10, _AC_BITS, _AC_SYMBOLS),
        b"\xff\xdd", struct.pack(">HH", 4, INTERVAL),
        b"\xff\xda", struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0),
    ))


def _scan_bytes(levels: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes, not stuffed, of the intervals that begin at starts."""
    diff = levels.astype(np.int64) - 128
    diff[1:] -= diff[:-1].copy()
    diff[starts] = levels[starts].astype(np.int64) - 128
    code, length = _CODE[diff + 255], _LENGTH[diff + 255]
    total = np.cumsum(length)
    bits = np.add.reduceat(length, starts)
    sizes = (bits + 7) >> 3
    offsets = np.cumsum(sizes) - sizes
    begin = total - length
    position = begin + np.repeat(8 * offsets - begin[starts], np.diff(np.append(starts, len(levels))))
    pad = 8 * sizes - bits
    position = np.concatenate((position, 8 * offsets + bits))
    code = np.concatenate((code, ((1 << pad) - 1).astype(np.uint64)))
    length = np.concatenate((length, pad))
    wide = code << (64 - (position & 31) - length).astype(np.uint64) % np.uint64(64)
    wide[length == 0] = 0
    n = int(sizes.sum()) // 4 + 2
    word = position >> 5
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    data = words.astype(np.uint64).astype(">u4").tobytes()
    return [data[a:b] for a, b in zip(offsets.tolist(), (offsets + sizes).tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One or more frames, end to end, for each payload, a multiple of ROW bytes long."""
    frames: list[tuple[int, bytes]] = []
    for k, p in enumerate(payloads):
        frames += [(k, p[at : at + FRAME]) for at in range(0, len(p), FRAME)]
    out: list[list[bytes]] = [[] for _ in payloads]
    lo = 0
    while lo < len(frames):
        hi, size = lo, 0
        while hi < len(frames) and (hi == lo or size + len(frames[hi][1]) <= _STEP):
            size += len(frames[hi][1])
            hi += 1
        levels = np.frombuffer(b"".join(f for _, f in frames[lo:hi]), np.uint8)
        starts, counts, at = [], [], 0
        for _, f in frames[lo:hi]:
            starts += range(at, at + len(f), INTERVAL)
            counts.append(-(-len(f) // INTERVAL))
            at += len(f)
        scans = iter(_scan_bytes(levels, np.array(starts, np.int64)))
        for (k, f), n in zip(frames[lo:hi], counts):
            parts = [_header(len(f) // ROW)]
            for i in range(n):
                parts += [next(scans).replace(b"\xff", b"\xff\x00"), bytes((0xFF, 0xD0 + i % 8 if i + 1 < n else 0xD9))]
            out[k].append(b"".join(parts))
        lo = hi
    return [b"".join(x) for x in out]


class NotBaseline(ValueError):
    """The bytes are not a complete baseline frame."""


@dataclass
class Frame:
    width: int
    height: int
    pattern: tuple  # of each block of an MCU: (component, DC table, AC table)
    tables: tuple  # the Huffman tables that the scan uses, as (bits, symbols)
    quant: int  # the luminance DC step
    grid: tuple[int, int]  # luminance blocks by row and column, padded to whole MCUs
    sampling: tuple[int, int]
    intervals: list[bytes]
    mcus: list[int]  # of each interval


_MARK = re.compile(rb"\xff[\xd0-\xd7]")
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The frame that begins at a place of data, and where it ends. Whatever is wrong with the bytes is NotBaseline."""
    try:
        return _parse(data, at)
    except (KeyError, IndexError, ValueError, ZeroDivisionError, struct.error) as e:
        raise NotBaseline(str(e)) from e


def _parse(data: bytes, at: int) -> tuple[Frame, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    quant, huff, parts, restart, size = {}, {}, {}, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise NotBaseline("a marker is missing")
        mark, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise NotBaseline("a quantization table is broken")
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                m = sum(body[1:17])
                huff[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + m]))
                body = body[17 + m :]
        elif mark == 0xC0:
            size = struct.unpack(">HH", body[1:5])
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                parts[c] = (hv >> 4, hv & 15, q)
        elif 0xC1 <= mark <= 0xCF:
            raise NotBaseline("not a baseline frame")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            break
    if size is None or not parts or body[0] != len(parts):
        raise NotBaseline("one scan of all components is needed")
    if not all(1 <= h <= 4 and 1 <= v <= 4 for h, v, _ in parts.values()) or 0 in size:
        raise NotBaseline("the frame's size or sampling is not one of a picture")
    names, pattern = [], []
    for i in range(body[0]):
        c, t = body[1 + 2 * i : 3 + 2 * i]
        h, v, _ = parts[c]
        pair = (huff[t >> 4], huff[0x10 | t & 15])
        if pair not in names:
            names.append(pair)
        pattern += [(i, names.index(pair))] * (h * v if len(parts) > 1 else 1)
    h, v, q = next(iter(parts.values())) if len(parts) > 1 else (1, 1, next(iter(parts.values()))[2])
    hm, vm = (max(p[0] for p in parts.values()), max(p[1] for p in parts.values())) if len(parts) > 1 else (1, 1)
    height, width = size
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    end = _END.search(data, at)
    if not end:
        raise NotBaseline("no end of image")
    intervals = [s.replace(b"\xff\x00", b"\xff") for s in _MARK.split(data[at : end.start()])]
    total = across * down
    each = restart or total
    mcus = [min(each, total - k * each) for k in range(len(intervals))]
    if len(intervals) != -(-total // each):
        raise NotBaseline("restart intervals are missing")
    if any(2 * m * len(pattern) > 8 * len(s) for m, s in zip(mcus, intervals)):  # a block has two codes at least
        raise NotBaseline("the scan is too short for its frame")
    return Frame(width, height, tuple(pattern), tuple(names), quant[q], (down * v, across * h), (v, h), intervals, mcus), end.end()


def _lookup(table) -> np.ndarray:
    """Length * 256 + symbol for each 16 bits that begin with a code; 0 where none does."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in huffman_codes(*table).items():
        if code >> n:
            raise NotBaseline("a table has too many codes")
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


def _decode_lanes(intervals: list[bytes], blocks: np.ndarray, pattern, tables) -> list[np.ndarray]:
    """DC levels of the first component of each interval, all intervals in step."""
    first = [c for c, _ in pattern].count(0)
    data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in intervals), np.uint8).astype(np.uint32)
    peek = np.zeros(len(data), np.uint32)
    peek[:-3] = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    lens = np.array([len(s) + 8 for s in intervals], np.int64)
    start = np.cumsum(lens) - lens
    limit = (start + lens) * 8
    lut = np.concatenate([_lookup(t) for pair in tables for t in pair])
    table_of = np.array([t for _, t in pattern], np.int64) * (2 << 16)
    comp_of = np.array([c for c, _ in pattern], np.int64)
    n = len(intervals)
    out = np.zeros((n, int(blocks.max()) // len(pattern) * first if n else 0), np.int32)
    lane = np.arange(n)
    pos, left = start * 8, blocks.copy()
    slot, k, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pred = np.zeros((n, int(comp_of.max()) + 1), np.int32)
    while len(lane):
        word = (peek[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.int64)
        is_dc = k == 0
        found = lut[word + table_of[slot] + np.where(is_dc, 0, 1 << 16)]
        symbol = found & 255
        pos += found >> 8
        bits = np.where(is_dc, symbol, symbol & 15)
        raw = (peek[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.int32) >> (16 - bits)
        pos += bits
        if (found == 0).any() or (pos > limit[lane]).any():
            raise NotBaseline("the scan cannot be decoded")
        at = np.flatnonzero(is_dc)
        if len(at):
            b = bits[at]
            value = np.where(raw[at] < (1 << b >> 1), raw[at] - (1 << b) + 1, raw[at])
            comp = comp_of[slot[at]]
            pred[lane[at], comp] += value
            lum = at[comp == 0]
            out[lane[lum], kept[lum]] = pred[lane[lum], 0]
            kept[lum] += 1
        run = symbol >> 4
        k = np.where(is_dc, 1, np.where(bits > 0, k + run + 1, np.where(run == 15, k + 16, 64)))
        done = k >= 64
        k[done] = 0
        slot[done] += 1
        slot[slot == len(pattern)] = 0
        left -= done
        live = left > 0
        if not live.all():
            lane, pos, left, slot, k, kept = lane[live], pos[live], left[live], slot[live], k[live], kept[live]
    return [out[i, : blocks[i] // len(pattern) * first] for i in range(n)]


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """DC-only luminance of each frame: one level of 0 to 255 for each 8x8 block."""
    out: list = [None] * len(frames)
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        kinds.setdefault((f.pattern, f.tables), []).append(i)
    for (pattern, tables), own in kinds.items():
        lo = 0
        while lo < len(own):
            hi, size = lo, 0
            while hi < len(own) and (hi == lo or size + sum(map(len, frames[own[hi]].intervals)) <= _STEP):
                size += sum(map(len, frames[own[hi]].intervals))
                hi += 1
            some = [frames[i] for i in own[lo:hi]]
            lanes = iter(_decode_lanes([s for f in some for s in f.intervals], np.array([m * len(pattern) for f in some for m in f.mcus], np.int64), pattern, tables))
            for i, f in zip(own[lo:hi], some):
                dc = np.concatenate([next(lanes) for _ in f.intervals])
                v, h = f.sampling
                rows, columns = f.grid
                dc = dc.reshape(rows // v, columns // h, v, h).transpose(0, 2, 1, 3).reshape(rows, columns)
                level = np.clip((dc.astype(np.int64) * f.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
                out[i] = level[: -(-f.height // 8), : -(-f.width // 8)]
            lo = hi
    return out


def read_all(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """Frames and thumbnails of each medium, which is one or more frames end to end."""
    frames, owner = [], []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            f, at = parse(data, at)
            frames.append(f)
            owner.append(k)
    out: list[list] = [[] for _ in media]
    for k, f, t in zip(owner, frames, thumbnails(frames)):
        out[k].append((f, t))
    return out
