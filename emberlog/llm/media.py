"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROW = 64


def encode_netpbm(image: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array of 8-bit samples as raw PGM or PPM."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey or colour array as an uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    h, w = image.shape[:2]
    depth = 24 if image.ndim == 3 else 8
    body = image[::-1, :, ::-1] if depth == 24 else image[::-1]
    body = np.ascontiguousarray(body, np.uint8).reshape(h, -1)
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) if depth == 8 else np.zeros((0, 4), np.uint8)
    if depth == 8:
        palette[:, 3] = 0
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.nbytes, 0, 0, start, 40, w, h, 1, depth, 0, body.nbytes, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Raw or plain Netpbm (P1 to P6, up to 8 bits a sample) or uncompressed BMP (8, 24, 32 bits) as uint8 array."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if re.match(rb"P[1-6]\s", data[:3]):
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    bits, plain, colours = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    for _ in range(2 if bits else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut short")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = head[0], head[1], 1 if bits else head[2]
    if not 0 < most < 256:
        raise ValueError("samples of more than 8 bits")
    if plain:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        got = np.array([c - 48 for c in body if c in b"01"] if bits else body.split(), dtype=np.int64)
    elif bits:
        row = -(-w // 8)
        got = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        got = np.frombuffer(data, np.uint8, w * h * colours, at + 1)
    got = got[: w * h * colours].reshape((h, w, 3) if colours == 3 else (h, w))
    if bits:
        return (255 * (1 - got)).astype(np.uint8)
    return got.astype(np.uint8) if most == 255 else (got.astype(np.int64) * 255 // most).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    rows = abs(h)
    stride = -(-w * depth // 32) * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    body = body[::-1] if h > 0 else body
    if depth == 8:
        count = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * count, 14 + size).reshape(count, 4)
        grey = bool((palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all())
        index = body[:, :w]
        return palette[index, 0] if grey else palette[index][:, :, 2::-1]
    return body[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output pixel covers, read from an integral image with interpolated edges."""
    grey = image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    if h == 0 or w == 0:
        return np.zeros((height, width))
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    down = np.zeros((h + 1, w), np.float64)
    np.cumsum(grey, axis=0, dtype=np.float64, out=down[1:])
    i = np.minimum(ys.astype(np.int64), h - 1)
    at = down[i] + (ys - i)[:, None] * (down[i + 1] - down[i])
    both = np.zeros((height + 1, w + 1))
    np.cumsum(at, axis=1, out=both[:, 1:])
    j = np.minimum(xs.astype(np.int64), w - 1)
    full = both[:, j] + (xs - j) * (both[:, j + 1] - both[:, j])
    return np.diff(np.diff(full, axis=0), axis=1) / ((h / height) * (w / width))


def to_uint8(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each pixel of an 8 x 9 reduction is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def payload_of(text: str | None, row: int = ROW) -> bytes:
    """UTF-8 bytes, padded by zeros to a positive multiple of ``row``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % row if raw else row)


def media_columns(df: DataFrame, text_col: str = "text", kind: str = "pgm", tile: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Store each text as an image of 64 samples a row, read it back and append what was found.

    Appends ``media`` (the stored PGM or BMP), ``payload`` (the bytes decoded from it), ``tile`` (an NPY file of the
    area-resized image) and ``feature`` (difference hash and mean brightness). One pass without a shuffle. A null
    text counts as empty, whose payload is 64 zero bytes. A text of any length is one image, in one worker. Repeated rows
    give repeated results, an empty table an empty one. Input columns with the outputs' names are replaced.
    """
    fields = [T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("tile", T.BinaryType()), T.StructField("feature", T.StringType())]
    encode = {"pgm": encode_netpbm, "bmp": encode_bmp}[kind]

    def make():
        def one(text):
            stored = encode(np.frombuffer(payload_of(text), np.uint8).reshape(-1, ROW))
            image = decode(stored)
            small = area_resize(image, tile, tile)
            return stored, image.tobytes(), npy(to_uint8(small)), f"{difference_hash(image)}-{int(to_uint8(small.mean())):02x}"

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    return common.map_text(df, text_col, fields, make, keep)


def image_columns(df: DataFrame, media_col: str, tile: int = 16) -> DataFrame:
    """For a column of Netpbm or BMP files: ``height``, ``width``, ``tile`` (NPY) and ``feature``; nulls where a file is null or broken."""
    keep = common.without(df, ["height", "width", "tile", "feature"])
    src = df.select(*keep, F.base64(df[media_col]).alias("__b64"))
    fields = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("tile", T.BinaryType()), T.StructField("feature", T.StringType())]

    def make():
        import base64

        def one(text):
            try:
                image = decode(base64.b64decode(text))
            except (ValueError, TypeError, struct.error, IndexError):
                return None, None, None, None
            return image.shape[0], image.shape[1], npy(to_uint8(area_resize(image, tile, tile))), difference_hash(image)

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    return common.map_text(src, "__b64", fields, make, keep)


def digests(df: DataFrame) -> DataFrame:
    """The columns of the query, from stored forms and payloads that were read back."""
    return df.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )
