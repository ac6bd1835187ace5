"""Media columns: texts stored losslessly as PNG images in a binary column, read back and hashed.

encode_media() packs any UTF-8 text (or bytes) into an 8-bit greyscale PNG, 64
samples a row, zero padded to a positive multiple of 64. media_features() parses
the stored bytes again: it tests the signature and every chunk's CRC-32, inflates
the IDAT stream, undoes all five row filters with numpy and computes a perceptual
hash from the low-frequency corner of a discrete cosine transform.

Defined results: null text counts as empty (one row of 64 zero samples); repeated
rows give repeated results; an empty table gives an empty one; other columns of
the input are ignored, whatever their names. Bytes that are no valid greyscale PNG
raise ValueError in strict mode (the default); with strict=False they give a row of
nulls and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import pieces, table, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Size of an IDAT chunk, so that no chunk of a very long payload is unbounded.
IDAT_BYTES = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """An (h, w) uint8 array as an 8-bit greyscale PNG; each row takes the cheapest of the None, Sub and Up filters."""
    h, w = samples.shape
    sub = samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    rows = np.stack([samples, sub, up])
    cost = np.minimum(rows, 0 - rows).sum(axis=2, dtype=np.int64)  # absolute value as a signed byte
    kind = cost.argmin(axis=0)
    raw = np.empty((h, w + 1), np.uint8)
    raw[:, 0] = kind
    raw[:, 1:] = rows[kind, np.arange(h)]
    data = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    idat = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *idat, _chunk(b"IEND", b"")])


def _wave(block: np.ndarray, above: np.ndarray, paeth: bool) -> np.ndarray:
    """Undo the Average or Paeth filter for a run of rows, one anti-diagonal at a time (its pixels don't depend on each other)."""
    h, w = block.shape
    out = np.zeros((h + 1, w + 1), np.int32)
    out[0, 1:] = above
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        left, top, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        if paeth:
            p = left + top - corner
            pa_, pb, pc = abs(p - left), abs(p - top), abs(p - corner)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, top, corner))
        else:
            guess = (left + top) >> 1
        out[r + 1, c + 1] = (block[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(raw: np.ndarray) -> np.ndarray:
    """(h, 1 + w) filtered rows of one-byte pixels to (h, w) samples; runs of rows with one filter are undone together."""
    kinds, body = raw[:, 0], raw[:, 1:]
    if not kinds.any():
        return body
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    out = np.empty(body.shape, np.uint8)
    above = np.zeros(body.shape[1], np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)]):
        block = body[a:b]
        match int(kinds[a]):
            case 0:
                out[a:b] = block
            case 1:
                np.cumsum(block, axis=1, dtype=np.uint8, out=out[a:b])
            case 2:
                np.cumsum(block, axis=0, dtype=np.uint8, out=out[a:b])
                out[a:b] += above
            case kind:
                out[a:b] = _wave(block, above, kind == 4)
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale, non-interlaced PNG. ValueError where signature, chunk order, CRC or size is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("chunk cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data):
            raise ValueError("chunk cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at = end
    if not head or not ended:
        raise ValueError("no header or no end")
    w, h, *rest = head
    if rest != [8, 0, 0, 0, 0] or not w or not h:
        raise ValueError("not an 8-bit greyscale image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != h * (w + 1):
        raise ValueError("wrong length of image data")
    return unfilter(raw.reshape(h, w + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    x = (np.arange(n) + 0.5) * np.pi / n
    return np.cos(np.arange(k)[:, None] * x[None, :])


_COS = _cosines(32, 8)


def _resize(img: np.ndarray, n: int = 32) -> np.ndarray:
    """Area means over n x n cells; an axis shorter than n repeats its samples."""
    out = img.astype(np.float64)
    for axis in (0, 1):
        size = out.shape[axis]
        if size < n:
            out = out.take(np.arange(n) * size // n, axis=axis)
        elif size > n:
            cuts = np.arange(n) * size // n
            out = np.add.reduceat(out, cuts, axis=axis)
            counts = np.diff(np.append(cuts, size))
            out /= counts.reshape((-1, 1) if axis == 0 else (1, -1))
    return out


def cosine_hash(img: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients (but the mean) of the 32 x 32 image exceed their median."""
    low = _COS @ _resize(img) @ _COS.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


MEDIA = "id long, n_bytes long, payload_bytes long, media binary"
FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary, error string"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in pieces(big):
            ids, sizes, padded, media = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
                img = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)
                sizes.append(len(data))
                padded.append(size)
                media.append(encode_png(img))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "payload_bytes", "media"])


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): every text as a PNG in a binary column."""
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_encode, MEDIA)


def _feature_rows(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, column="media"):
                out = []
                for i, n, padded, media in zip(*(c.to_pylist() for c in batch.columns)):
                    row = {"id": i, "n_bytes": n, "payload_bytes": padded}
                    try:
                        img = decode_png(media if media is not None else b"")
                    except ValueError as e:
                        if strict:
                            raise
                        out.append(row | {"error": str(e)})
                        continue
                    payload = img.tobytes()
                    out.append(row | {
                        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "phash": cosine_hash(img),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("phash", pa.binary()), ("error", pa.string())])


def media_features(media: DataFrame, strict: bool = True) -> DataFrame:
    """Digests and the perceptual hash of each image in a (id, n_bytes, payload_bytes, media) table."""
    return media.select("id", "n_bytes", "payload_bytes", "media").mapInArrow(_feature_rows(strict), FEATURES)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media_features(encode_media(table(spark, sf_dir, "documents")))
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.lower(F.hex("phash")).alias("feature"))
