"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY
tiles with difference hashes. Work is per row: no shuffle."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import slices, tidied

SIDE = 24
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary grey map (P5) of a height x width uint8 array."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette (2-D array) or 24 bits (height x width x 3, RGB)."""
    grey = pixels.ndim == 2
    height, width = pixels.shape[:2]
    row = (width * (1 if grey else 3) + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    flat = pixels if grey else pixels[:, :, ::-1].reshape(height, width * 3)
    body[:, : flat.shape[1]] = flat
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    offset = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", offset + body.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + body[::-1].tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not 0 < top < 256:
        raise ValueError("only samples of 8 bits")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind == b"P1":
        values = (1 - np.frombuffer(re.sub(rb"[^01]", b"", data[at:])[:n], np.uint8) + 48).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        values = np.array(data[at:].split()[:n], dtype=np.int64).astype(np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = 1 - np.unpackbits(bits, axis=1)[:, :width].ravel()
    elif kind in (b"P5", b"P6"):
        values = np.frombuffer(data, np.uint8, n, at + 1)
    else:
        raise ValueError("no Netpbm kind")
    if len(values) < n:
        raise ValueError("Netpbm data ends early")
    if top != 255:
        values = (values.astype(np.int64) * 255 // top).astype(np.uint8)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    row = (width * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    body = body[::-1] if height > 0 else body
    if bits == 24:
        return body[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, (offset - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
    if len(palette) == 256 and (palette[:, :3] == np.arange(256)[:, None]).all():
        return body[:, :width]
    return palette[body[:, :width]][:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Pixels of Netpbm (P1 to P6, up to 8 bits) or BMP (8 or 24 bits, uncompressed): height x width of grey, or
    height x width x 3 of RGB, uint8. Raises ValueError for anything else."""
    try:
        return _decode_bmp(data) if data[:2] == b"BM" else _decode_netpbm(data)
    except struct.error as e:
        raise ValueError(str(e)) from e


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean grey of each cell of a height x width grid laid over the picture, exact on fractional borders:
    the integral image is interpolated at the grid's lines."""
    grey = pixels.astype(np.float64) if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    whole = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=whole[1:, 1:])

    def lines(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = lines(grey.shape[0], height), lines(grey.shape[1], width)
    rows = whole[y] * (1 - fy)[:, None] + whole[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return sums * (height * width / grey.size)


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: in each of 8 rows of 9 area means, whether a mean is over its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, side: int = SIDE) -> bytes:
    """An NPY file of all side x side tiles in reading order, shape (tiles, side, side[, 3]); edges are filled with 0."""
    height, width = (-(-n // side) * side for n in pixels.shape[:2])
    full = np.zeros((height, width, *pixels.shape[2:]), np.uint8)
    full[: pixels.shape[0], : pixels.shape[1]] = pixels
    tiles = full.reshape(height // side, side, width // side, side, *pixels.shape[2:]).swapaxes(1, 2)
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tiles.reshape(-1, side, side, *pixels.shape[2:])), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def media_tiles(rows: DataFrame, column: str = "media", side: int = SIDE) -> DataFrame:
    """Adds height, width, npy (binary), n_tiles, dhash and error to rows with a binary ``column`` of pictures.

    Null, empty or broken pictures keep their row: the new columns are null and ``error`` says why. New columns
    replace old ones of the same name; all others stay.
    """
    new = "height int, width int, npy binary, n_tiles int, dhash string, error string"
    kept = rows.drop("height", "width", "npy", "n_tiles", "dhash", "error")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20, column):
            out = []
            for data in batch.column(column).to_pylist():
                try:
                    pixels = decode(data or b"")
                    npy = npy_tiles(pixels, side)
                    n = -(-pixels.shape[0] // side) * -(-pixels.shape[1] // side)
                    out.append((*pixels.shape[:2], npy, n, difference_hash(pixels), None))
                except ValueError as e:
                    out.append((None, None, None, None, None, str(e)))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.string())
            arrays = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], [*names, "height", "width", "npy", "n_tiles", "dhash", "error"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, {new}")


def texts_as_media(docs: DataFrame, unit: int = SIDE * SIDE) -> DataFrame:
    """doc_id, n_bytes and ``media``: the UTF-8 bytes of each text (null: empty), filled with 255 to a positive
    multiple of ``unit``, as a binary grey map of width 24."""

    size = F.octet_length(F.coalesce(docs["text"], F.lit("")))
    full = F.greatest(F.lit(1), F.ceil(size / unit)).cast("int") * unit
    fill = F.unhex(F.repeat(F.lit("FF"), full - size))
    head = F.concat(F.lit(f"P5\n{SIDE} "), (full / SIDE).cast("int").cast("string"), F.lit("\n255\n")).cast("binary")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        size.cast("long").alias("n_bytes"),
        F.concat(head, F.coalesce(docs["text"], F.lit("")).cast("binary"), fill).alias("media"),
    )


def text_media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text as a grey map, decodes it, cuts it into NPY tiles, reads both back and returns digests.

    The stored form is the grey map; ``npy_sha256`` and ``n_tiles`` describe the tiles, whose samples in reading
    order must equal the payload. Null and empty texts are one unit of bytes 255; long texts are taken whole, one picture each;
    repeated rows give repeated rows; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint,"
        " media_sha256 string, feature string, n_tiles bigint, npy_sha256 string"
    )
    out_schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
            ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
            ("n_tiles", pa.int64()), ("npy_sha256", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20, "media"):
            out = []
            for data in batch.column("media").to_pylist():
                pixels = decode(data)
                npy = npy_tiles(pixels)
                tiles = read_npy(npy)
                payload = tiles.tobytes()  # the width is one tile, so tiles are in the payload's order
                if payload != pixels.tobytes():
                    raise ValueError("tiles differ from the picture")
                out.append(
                    (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                        hashlib.sha256(data).hexdigest(), difference_hash(pixels), len(tiles), hashlib.sha256(npy).hexdigest(),
                    )
                )
            arrays = [pa.array([x[i] for x in out], f.type) for i, f in enumerate(list(out_schema)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], schema=out_schema)

    return texts_as_media(docs).mapInArrow(tidied(run), schema)
