"""Operator 1, media columns: bytes as lossless WebP pictures and back to pixel arrays.

A payload fills the pixels from the first row on, four samples (blue, green, red, alpha) a pixel.
The picture is sixteen pixels wide, or as much wider as its height of at most 16384 rows asks
for; what is left of its last rows is zero and is cut off when it is read, by the payload's length.
A payload of more than 16 MB is stored as several pictures, one file after another, so that a
task never holds the pixels of more than one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import text_or_empty

#: A payload's length is a positive multiple of this.
UNIT = 64
#: Bytes of a payload that one picture holds at most.
PART = 1 << 24
ROWS = 1 << 14
#: Bytes of the payloads whose files are read together at most.
HELD = 1 << 23
#: Of 256 parts so many get each kind of transforms.
TURNED = 4


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_picture(payload: bytes) -> np.ndarray:
    """The pixel array that holds a payload of whole units."""
    pixels = np.frombuffer(payload, "<u4")
    width = 16 * -(-len(pixels) // (16 * ROWS))
    height = -(-len(pixels) // width)
    return np.pad(pixels, (0, width * height - len(pixels))).reshape(height, width)


def from_picture(picture: np.ndarray, n: int) -> bytes:
    return picture.astype("<u4").tobytes()[:n]


def drawn(picture: np.ndarray, digest: bytes) -> dict[str, object] | None:
    """The transforms of the pictures that get some, by their payload's digest; None for all others."""
    if digest[0] >= 4 * TURNED:
        return None
    height, width = picture.shape
    sides, rng = (-(-height >> 4), -(-width >> 4)), np.random.default_rng(np.frombuffer(digest, np.uint32))
    modes = {"modes": rng.integers(0, 14, sides), "block": 4}
    elements = {"elements": rng.integers(0, 1 << 24, sides) | webp.BLACK, "block": 4}
    kinds = ({"green": True}, modes, elements, {"green": True, **modes, **elements, "cache_bits": 6, "references": True})
    return kinds[digest[0] // TURNED]


def store(payload: bytes) -> bytes:
    """Files of the payload's parts.

    A part's picture is stored with single pixels, with the colour cache and back-references, or with a palette, whichever is smallest.
    Text gains nothing from the transforms that suit photographs, so size alone would never choose them: TURNED of
    256 parts, by their digest, get each of subtracted green, predictors, cross-colour, and all of these together.
    """
    out = []
    for i in range(0, len(payload), PART):
        picture = to_picture(payload[i : i + PART])
        how = drawn(picture, hashlib.sha256(payload[i : i + PART]).digest())
        out.append(webp.smallest(picture) if how is None else webp.encode(picture, **how))
    return b"".join(out)


def files(media: bytes) -> Iterator[bytes]:
    """WebP files that follow each other; other bytes behind them are none."""
    at = 0
    while at == 0 or media[at : at + 4] == b"RIFF":
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if end <= at + 8:
            raise ValueError("a file has no length")
        yield media[at:end]
        at = end


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """The pictures of WebP files that follow each other."""
    return map(webp.decode, files(media))


def load(media: bytes, n: int) -> tuple[bytes, str]:
    """The payload of n bytes, and the feature of all its pictures."""
    return held_by(pictures(media), n)


def load_all(media: pa.Array, sizes: list[int]) -> Iterator[tuple[int, bytes, bytes, str]]:
    """Place, media, and what load() finds in it, of each of these; single files of like sizes are read together."""
    group: list[tuple[int, bytes]] = []
    held = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        stored = media[i].as_py()
        if sizes[i] > HELD or len(stored) != 8 + int.from_bytes(stored[4:8], "little"):
            yield i, stored, *load(stored, sizes[i])
            continue
        if held + sizes[i] > HELD or len(group) == webp.TOGETHER:
            yield from _loaded(group, sizes)
            group, held = [], 0
        group.append((i, stored))
        held += sizes[i]
    yield from _loaded(group, sizes)


def _loaded(group: list[tuple[int, bytes]], sizes: list[int]) -> Iterator[tuple[int, bytes, bytes, str]]:
    for (i, stored), picture in zip(group, webp.decode_together([x for _, x in group])):
        yield i, stored, *held_by([picture], sizes[i])


def held_by(pictures: Iterable[np.ndarray], n: int) -> tuple[bytes, str]:
    """The payload of n bytes that these pictures hold, and their feature."""
    parts, seen, left = [], [], n
    for picture in pictures:
        seen.append(sketch(picture))
        parts.append(from_picture(picture, min(PART, left)))
        left -= len(parts[-1])
    if left:
        raise ValueError(f"{left} bytes of a payload are missing")
    return b"".join(parts), joined(seen)


def sketch(picture: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Size, sum of each channel, and the luma (of 0 to 255) of each pixel."""
    samples = webp.channels(picture.ravel())
    blue, green, red = (samples[:, k].astype(np.uint16) for k in range(3))
    luma = (29 * blue + 150 * green + 77 * red) >> 8
    return f"{picture.shape[1]}x{picture.shape[0]}", samples.sum(0, dtype=np.int64), luma.astype(np.uint8)


def joined(seen: list[tuple[str, np.ndarray, np.ndarray]]) -> str:
    """Sizes, mean of each channel, and a mean hash: which of 64 parts of the luma are over its mean, over all pixels of the pictures."""
    luma = np.concatenate([x[2] for x in seen])
    starts = np.arange(64) * len(luma) // 64
    parts = np.add.reduceat(luma, starts, dtype=np.int64) if len(luma) >= 64 else np.resize(luma, 64).astype(np.int64)
    sizes = np.diff(np.append(starts, len(luma))) if len(luma) >= 64 else np.ones(64, np.int64)
    over = parts * len(luma) > luma.sum(dtype=np.int64) * sizes
    mean = sum(x[1] for x in seen) // len(luma)
    return f"{'+'.join(x[0] for x in seen)} {'.'.join(map(str, mean.tolist()))} {np.packbits(over).tobytes().hex()}"


def feature(picture: np.ndarray) -> str:
    """The feature of one picture."""
    return joined([sketch(picture)])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            data = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            media = [store(pad(x)) for x in data]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WebP file, of each document's whole text (null: empty).

    docs: doc_id and text; other columns are not read. Repeated rows and null ids get their rows. A text of more than PART bytes
    is several pictures in one file. No rows: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        sizes = [n + (-n % UNIT or (0 if n else UNIT)) for n in batch.column(1).to_pylist()]
        rows: list[tuple] = [()] * len(sizes)
        for i, media, payload, text in load_all(batch.column(2), sizes):
            rows[i] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), text
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def inspect(media: DataFrame) -> DataFrame:
    """Decodes each media file; its payload's and its own length and digest, and the features of all its pictures. Null ids and repeated files get their rows. No rows: no rows."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        ids = batch.column(0)

        def rows(held: list[tuple[int, int, np.ndarray | None]], ids: pa.Array = ids) -> pa.RecordBatch:
            side = lambda k: pa.array([None if p is None else p.shape[k] for _, _, p in held], pa.int32())
            values = pa.array([None if p is None else p.ravel().astype(np.int64) for _, _, p in held], kind)
            whose = ids.take(pa.array([i for i, _, _ in held], pa.int64()))
            return pa.RecordBatch.from_arrays([whose, side(1), side(0), values, pa.array([k for _, k, _ in held], pa.int32())], ["doc_id", "width", "height", "pixels", "part"])

        held, n = [], 0
        for i, media in enumerate(batch.column(1)):
            media = media.as_py()
            for k, picture in enumerate([None] if media is None else pictures(media)):
                held.append((i, k, picture))
                n += 0 if picture is None else picture.size
                if n >= PART // 4:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)


def decode(media: DataFrame) -> DataFrame:
    """doc_id, width, height, pixels (row by row, as unsigned ARGB) and part of any lossless WebP files; null media: nulls.

    Files that follow each other, as those of payloads over 16 MB, have a row each; part counts them from 0.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(_pixels, f"doc_id {kind}, width int, height int, pixels array<long>, part int")


def round_trip(docs: DataFrame) -> DataFrame:
    """inspect() of what encode() stores: null texts are empty, equal ones have equal values, long ones are several pictures, other columns are not read. No rows: no rows."""
    return inspect(encode(docs))


