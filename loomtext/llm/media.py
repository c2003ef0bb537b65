"""Media columns: PNG images in binary columns, read back and hashed by their low frequencies.

A payload's bytes become the samples of an 8-bit grey image of WIDTH columns. The image is stored as
PNG: signature, header, one zlib stream in IDAT chunks, end; every chunk has its crc32. The reader
tests every chunk's checksum, joins and inflates the stream, checks its length and undoes the rows'
filters with numpy. The feature is a perceptual hash: the image is averaged down to SIDE x SIDE
cells, and the signs of its low-frequency cosine coefficients against their median are 64 bits.

Defined results: null and empty payloads have no sample rows until padded, so `pad` gives them one
block of zero bytes; a broken image (checksum, length, filter or header) raises MediaError, or gives
a null row where `errors="null"`; equal payloads give equal files and features; columns of the results' names are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import extended, sliced

WIDTH, BLOCK, SIDE, LOW = 64, 64, 32, 8
#: Fixed by the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_CHUNK = 1 << 20
FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


class MediaError(ValueError):
    """The stored bytes aren't a readable image."""


def pad(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of BLOCK."""
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    out = rows.copy()
    if kind == 1:
        out[:, 1:] -= rows[:, :-1]
    elif kind == 2:
        out[1:] -= rows[:-1]
    return out


def encode(payload: bytes, level: int = 1) -> bytes:
    """A padded payload as PNG. All rows take the one of the filters none, left and up whose residues are smallest."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    tried = [_filtered(rows, kind) for kind in range(3)]
    best = min(range(3), key=lambda k: (int(np.minimum(tried[k], -tried[k]).sum(dtype=np.int64)), k))
    stream = np.empty((len(rows), WIDTH + 1), np.uint8)
    stream[:, 0], stream[:, 1:] = best, tried[best]
    body = zlib.compress(stream.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[at : at + MOST_CHUNK]) for at in range(0, len(body), MOST_CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _unfilter(stream: np.ndarray) -> np.ndarray:
    """Rows without their filters; runs of one filter that needs only the row or only the column go at once."""
    kinds, rows = stream[:, 0], stream[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for low, high in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(kinds)]]).tolist(), strict=True):
        kind, part = int(kinds[low]) if len(kinds) else 0, rows[low:high]
        above = rows[low - 1] if low else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            if len(part):
                part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            part[:] = _by_diagonal(part, above, kind)
        elif kind:
            raise MediaError(f"unknown filter {kind}")
    return rows


def _by_diagonal(part: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Rows of a filter that needs what is left and above: a diagonal's samples depend on earlier diagonals only."""
    height, width = part.shape
    out = np.zeros((height + 1, width + 1), np.int16)
    out[0, 1:] = above
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c = d - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            far = np.stack([np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)])
            guess = np.choose(far.argmin(axis=0), [left, up, corner])
        out[r + 1, c + 1] = (part[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode(image: bytes) -> np.ndarray:
    """The samples, height x width; every checksum is tested."""
    if image[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise MediaError("a chunk is cut off")
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise MediaError("the header's length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an 8-bit grey image that isn't interlaced")
    try:
        stream = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    width, height = head[:2]
    if not width or not height:
        raise MediaError("no samples")
    if len(stream) != height * (width + 1):
        raise MediaError("wrong number of samples")
    return _unfilter(np.frombuffer(stream, np.uint8).reshape(height, width + 1))


@functools.cache
def _basis() -> np.ndarray:
    k, i = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))


def feature(samples: np.ndarray) -> str:
    """16 hex digits: signs of the LOW x LOW lowest cosine coefficients against their median.

    Rows and columns are averaged into SIDE bands in integers, so the same samples give the same bits.
    """
    height, width = samples.shape
    rows = np.add.reduceat(samples.astype(np.int64), np.arange(SIDE) * height // SIDE, axis=0) if height >= SIDE else samples[np.arange(SIDE) * height // SIDE].astype(np.int64)
    cells = np.add.reduceat(rows, np.arange(SIDE) * width // SIDE, axis=1) if width >= SIDE else rows[:, np.arange(SIDE) * width // SIDE]
    counts = np.maximum(1, np.diff(np.append(np.arange(SIDE) * height // SIDE, height)))[:, None] * np.maximum(1, np.diff(np.append(np.arange(SIDE) * width // SIDE, width)))
    low = np.round(_basis() @ (cells / counts) @ _basis().T, 6).ravel()
    bits = np.packbits(low > np.median(low[1:]))
    return bits.tobytes().hex()


def add_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """df with a binary column `media`: the PNG of each padded payload (null: empty)."""
    df = df.select(*(f"`{x}`" for x in df.columns if x.lower() != media.lower()))
    names = df.columns
    at = names.index(payload)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            images = [encode(pad(x or b"")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(images, pa.binary())], [*names, media])

    return df.mapInArrow(store, extended(df.schema, f"`{media}` binary"))


def media_features(df: DataFrame, media: str = "media", errors: str = "raise") -> DataFrame:
    """df's other columns with what the stored images hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = [x for x in df.columns if x != media and x.lower() not in FEATURES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            rows: list[tuple] = []
            for image in batch.column(len(names)).to_pylist():
                try:
                    samples = decode(image or b"")
                except MediaError:
                    if errors == "raise":
                        raise
                    rows.append((None,) * 6)
                    continue
                body = samples.tobytes()
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], [*names, *FEATURES])

    schema = extended(df.select(*(f"`{x}`" for x in names)).schema, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return df.select(*(f"`{x}`" for x in names), media).mapInArrow(read, schema)


def document_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes and media_features of its text in UTF-8."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    stored = add_media(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("payload")))
    return media_features(stored.select("doc_id", F.length("payload").cast("bigint").alias("n_bytes"), "media"))
