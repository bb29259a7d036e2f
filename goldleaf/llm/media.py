"""Media columns: lossless grey PNG images in binary columns, and low-frequency cosine hashes of them.

The writer puts a payload into 8-bit grey rows of :data:`WIDTH` samples, picks a filter for each row
(none, sub or up, whichever has the least sum of absolute differences) and deflates it into IDAT
chunks. The reader walks the chunks, tests every checksum, inflates, and undoes all five row filters
with numpy. The perceptual hash takes the read image down to 32 x 32 block means and keeps the
signs of its lowest cosine frequencies against their median.

Defined results: a null or empty text becomes one block of padding; a very long text becomes one
image of as many rows as it takes; equal texts give equal values, and repeated rows a row each; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

#: The PNG file signature.
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])

#: Samples of an image row; payloads are padded to a multiple of it with PAD.
WIDTH = 576
PAD = 255

#: Most bytes of data in one IDAT chunk.
CHUNK = 1 << 20

SIDE, LOW = 32, 8


class BadImage(ValueError):
    """A file that isn't a whole PNG of the kind that this module reads."""


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, padded to a positive multiple of the row width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """A grey 8-bit PNG whose samples are ``data``, a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    made = np.stack([rows, rows - left, rows - above])
    cost = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    choice = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = choice  # 0 none, 1 sub, 2 up
    lines[:, 1:] = made[choice, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), level)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[at : at + CHUNK]) for at in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", header) + body + _chunk(b"IEND", b"")


def _chunks(file: bytes) -> Iterator[tuple[bytes, bytes]]:
    if file[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(file):
        if at + 12 > len(file):
            raise BadImage("cut inside a chunk")
        (size,) = struct.unpack_from(">I", file, at)
        if at + 12 + size > len(file):
            raise BadImage("cut inside a chunk")
        kind, data = file[at + 4 : at + 8], file[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", file, at + 8 + size)[0]:
            raise BadImage(f"wrong checksum of {kind!r}")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise BadImage("no IEND")


def _average_or_paeth(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out = np.zeros(len(line), np.uint8)
    left = corner = 0
    for i, (x, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            pa_, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if pa_ <= pb and pa_ <= pc else up if pb <= pc else corner
        left = (x + guess) & 255
        corner = up
        out[i] = left
    return out


def decode_png(file: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing, as a matrix."""
    shape, packed = None, []
    for kind, data in _chunks(file):
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not a grey 8-bit image without interlacing")
    width, height = shape[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != height * (width + 1):
        raise BadImage("the samples don't fill the image")
    lines = lines.reshape(height, width + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown row filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    for row in np.flatnonzero(kinds >= 2):  # these need the finished row above
        above = out[row - 1] if row else np.zeros(width, np.uint8)
        out[row] = out[row] + above if kinds[row] == 2 else _average_or_paeth(int(kinds[row]), out[row], above)
    return out


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


COSINES = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 64 lowest cosine frequencies exceed their median."""
    rows = np.linspace(0, image.shape[0], SIDE + 1).astype(np.int64)
    columns = np.linspace(0, image.shape[1], SIDE + 1).astype(np.int64)
    # Rows of the small image repeat where the large one has fewer rows than it.
    top = np.minimum(rows[:-1], image.shape[0] - 1)
    sums = np.add.reduceat(np.add.reduceat(image, columns[:-1], axis=1, dtype=np.int64), top, axis=0)
    count = np.maximum(rows[1:] - rows[:-1], 1)[:, None] * (columns[1:] - columns[:-1])[None, :]
    low = COSINES @ (sums / count) @ COSINES.T
    low = np.round(low, 6).ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (PNG bytes) of each document."""

    def convert(parts):
        for part in parts:
            ids, values = part.column(0), part.column(1)

            def rows(ids=ids, values=values):
                for i, text in zip(ids.to_pylist(), values, strict=True):
                    text = text.as_py()
                    yield i, len((text or "").encode("utf-8", "surrogatepass")), encode_png(payload(text))

            yield from batches(rows(), MEDIA, 200)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        convert, "doc_id long, n_bytes long, media binary"
    )


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload size and digests, media size and digest, and the feature."""

    def convert(parts):
        for part in parts:
            ids, sizes, files = (part.column(i) for i in range(3))

            def rows(ids=ids, sizes=sizes, files=files):
                for i, size, file in zip(ids.to_pylist(), sizes.to_pylist(), files, strict=True):
                    file = file.as_py()
                    image = decode_png(file)
                    data = image.tobytes()
                    yield (i, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file),
                           hashlib.sha256(file).hexdigest(), cosine_hash(image))

            yield from batches(rows(), READ)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        convert,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
