"""Media columns: texts as baseline JPEG, and features of a JPEG column."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import texts_of

#: A payload is filled up with bytes of 255 to a positive multiple of this.
UNIT = 576


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % UNIT if text else UNIT)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media of each row of docs; null counts as empty."""

    def run(batches):
        for batch in batches:
            raw = texts_of(batch.column("text"))
            media = jpeg.encode([payload_of(t) for t in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def difference_hash(levels: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its right neighbour, as hex."""
    rows = (np.arange(8) * levels.shape[0]) // 8
    columns = (np.arange(9) * levels.shape[1]) // 9
    if levels.shape[0] < 8 or levels.shape[1] < 9:
        small = levels[np.ix_(rows, columns)].astype(np.float64)
    else:
        sums = np.add.reduceat(np.add.reduceat(levels, rows, axis=0, dtype=np.int64), columns, axis=1)
        small = sums / np.outer(np.diff(np.append(rows, levels.shape[0])), np.diff(np.append(columns, levels.shape[1])))
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def media_features(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, n_bytes, media): what its stored bytes hold, all of it read back from them.

    feature is width x height of the frames, their number and the difference hash of the DC-only
    luminance thumbnail. Media that are null or no baseline JPEG have null features; repeated rows
    give repeated results; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            media = batch.column("media").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for lo in range(0, len(media), 256):
                some = media[lo : lo + 256]
                for data, frames in zip(some, _frames(some)):
                    if not frames:
                        values = (None,) * 6
                    else:
                        levels = np.concatenate([t for _, t in frames]) if len({t.shape[1] for _, t in frames}) == 1 else frames[0][1]
                        payload = b"".join(t.tobytes() for _, t in frames)
                        name = f"{frames[0][0].width}x{sum(f.height for f, _ in frames)}:{len(frames)}:{difference_hash(levels)}"
                        values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), name)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _frames(media: list[bytes | None]) -> list[list]:
    try:
        return jpeg.read_all([m or b"" for m in media])
    except jpeg.NotBaseline:
        if len(media) == 1:
            return [[]]
        return [x for m in media for x in _frames([m])]
