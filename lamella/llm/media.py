"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled as NPY, with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = (
    "struct<width:int,height:int,channels:int,maximum:int,samples:binary,samples_bytes:bigint,samples_sha256:string,tail_crc32:bigint,"
    "hash:string,tiles:array<struct<row:int,col:int,npy:binary,hash:string>>,tiles_crc32:bigint,error:string>"
)
HEAD = re.compile(rb"P([1-6])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)")


def decode(data: bytes) -> np.ndarray:
    """An array of height x width x channels (1 or 3) of 8 or 16 bits from Netpbm P1 to P6 or an uncompressed BMP of 8, 24 or 32 bits.

    Samples are as stored; ``decode_scaled`` also says what the largest may be. Raises
    ValueError for anything else and for data that is too short.
    """
    return decode_scaled(data)[0]


def decode_scaled(data: bytes) -> tuple[np.ndarray, int]:
    """``decode``'s array and the value that stands for full brightness: the header's maximum, 255 for bits and BMP."""
    if data[:2] == b"BM":
        return _bmp(data), 255
    m = HEAD.match(data)
    if not m:
        raise ValueError("neither Netpbm nor BMP")
    kind, width, height, at = int(m[1]), int(m[2]), int(m[3]), m.end()
    most = 1
    if kind not in (1, 4):
        m = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(data, at)
        if not m:
            raise ValueError("no maximum value")
        most, at = int(m[1]), m.end()
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind <= 3:
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        if kind == 1:
            values = np.frombuffer(bytes(c for c in text if c in b"01"), np.uint8)[:count] - 48
        else:
            values = np.array(text.split()[:count], dtype=np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, min(stride * height, len(data) - at - 1), at + 1)
        if len(rows) < stride * height:
            raise ValueError("too few samples")
        values = np.unpackbits(rows.reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        kind_of = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        there = (len(data) - at - 1) // kind_of.itemsize
        values = np.frombuffer(data, kind_of, min(count, max(0, there)), at + 1)
    if len(values) < count:
        raise ValueError("too few samples")
    if kind in (1, 4):
        values, most = (1 - values) * 255, 255
    elif not 0 < most < 65536:
        raise ValueError("a maximum value outside 1 to 65535")
    elif len(values) and values.max() > most:
        raise ValueError("a sample above the maximum value")
    return values.astype(np.uint16 if most > 255 else np.uint8).reshape(height, width, channels), most


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("too few bytes")
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a kind of BMP that is not supported")
    size, stride = bits // 8, -(-width * bits // 32) * 4
    if len(data) < start + stride * abs(height):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * size].reshape(abs(height), width, size)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        (header,) = struct.unpack_from("<I", data, 14)
        (colours,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, (colours or 256) * 4, 14 + header).reshape(-1, 4)
        rows = palette[rows[:, :, 0]]
    return rows[:, :, 2::-1].copy()


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each target cell's area, cells cut across pixels included, from an integral image (to any size, up or down)."""
    h, w, channels = pixels.shape
    total = np.zeros((h + 1, w + 1, channels))
    np.cumsum(pixels, axis=0, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * (n / cells)
        low = np.minimum(edge.astype(np.int64), n)
        return low, np.minimum(low + 1, n), edge - low

    y0, y1, fy = at(h, height)
    rows = total[y0] * (1 - fy)[:, None, None] + total[y1] * fy[:, None, None]
    x0, x1, fx = at(w, width)
    corners = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / (h / height * w / width)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 9 cells' means is less than that of its right neighbour.

    Means count to a millionth, so that equal cells stay equal however their sums were rounded.
    """
    grey = np.round(area_resize(pixels, 8, 9).mean(axis=2), 6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def features(media: Column, size: int = 64, tile: int = 32, keep: bool = True) -> Column:
    """Decodes a column of Netpbm or BMP bytes.

    Gives the samples as stored (rows from the top, channels together) with their length, SHA-256
    and the CRC-32 of the last 16, the whole image's difference hash, and the image area-resized to
    ``size`` x ``size`` 8-bit samples, scaled from the stored maximum to 255, as NPY tiles of
    ``tile`` x ``tile``, each with its own hash, and the CRC-32 of all of them. Without ``keep`` the
    bytes of samples and tiles stay in the worker, and only what is computed from them comes back.
    Null media give nulls; media that can't be decoded give ``error`` and null for the rest; an
    image without pixels has no tiles.
    """

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        try:
            pixels, most = decode_scaled(data)
        except (ValueError, OverflowError) as e:
            return {"error": str(e)}
        height, width, channels = pixels.shape
        samples = pixels.tobytes()
        out = {"width": width, "height": height, "channels": channels, "maximum": most, "samples": samples if keep else None, "hash": None, "tiles": [], "tiles_crc32": 0}
        out |= {"samples_bytes": len(samples), "samples_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:])}
        if pixels.size:
            out["hash"] = difference_hash(pixels)
            small = np.clip(np.rint(area_resize(pixels, size, size) * (255 / most)), 0, 255).astype(np.uint8)
            for r in range(0, size, tile):
                for c in range(0, size, tile):
                    part = small[r : r + tile, c : c + tile]
                    stored = npy(part)
                    out["tiles_crc32"] = zlib.crc32(stored, out["tiles_crc32"])
                    out["tiles"].append({"row": r // tile, "col": c // tile, "npy": stored if keep else None, "hash": difference_hash(part)})
        return out

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["width", "height", "channels", "maximum", "samples", "samples_bytes", "samples_sha256", "tail_crc32", "hash", "tiles", "tiles_crc32", "error"]
        for values in batches:
            rows = [one(v) or {} for v in values]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return run(media)


def text_as_ppm(text: Column, width: int = 64) -> Column:
    """The UTF-8 bytes of a text as an 8-bit colour Netpbm image of ``width`` pixels: spaces fill up the last row, and there is one row at least. Built-in functions only."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    row = 3 * width
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(row)).cast("int"))
    head = F.concat(F.lit(f"P6\n{width} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, F.rpad(raw, rows * row, F.lit(b" ")))


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as an image and read back: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    ``feature`` is the image's difference hash, then its tiles' hashes, then the CRC-32 of the
    NPY tiles. Everything from ``payload_bytes`` to ``tail_crc32`` is of the samples decoded from the
    stored bytes. Null texts are empty; equal texts give equal values; an empty table gives an empty table.
    """
    body = F.col(f"`{text}`")
    stored = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.octet_length(F.coalesce(body, F.lit(""))).cast("long").alias("n_bytes"), text_as_ppm(body).alias("media"))
    read = stored.withColumn("f", features(F.col("media"), keep=False))
    return read.select(
        "doc_id",
        "n_bytes",
        F.col("f.samples_bytes").alias("payload_bytes"),
        F.col("f.samples_sha256").alias("payload_sha256"),
        F.col("f.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("-", F.col("f.hash"), F.concat_ws("", F.transform(F.col("f.tiles"), lambda t: t["hash"])), F.hex(F.col("f.tiles_crc32"))).alias("feature"),
    )
