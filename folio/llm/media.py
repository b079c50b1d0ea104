"""Media columns: Netpbm and BMP images as bytes, numpy arrays, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, slices, stored

WIDTH = 64
TILE = 64


class BadImage(ValueError):
    pass


def encode_pgm(samples: np.ndarray) -> bytes:
    """An (h, w) array of 8-bit samples as binary PGM."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An (h, w) array of grey samples as 8-bit BMP with a palette, or (h, w, 3) as 24-bit BMP."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples.reshape(h, -1) if grey else samples[:, :, ::-1].reshape(h, -1)
    line = -(-rows.shape[1] // 4) * 4
    full = np.zeros((h, line), np.uint8)
    full[:, : rows.shape[1]] = rows[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHI", b"BM", start + full.nbytes, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, full.nbytes, 2835, 2835, len(palette), 0)
    return head + info + palette.tobytes() + full.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    fields, at = [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        if not (m := re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(raw, at)):
            raise BadImage("header cut short")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    n = w * h * depth
    if not 0 < top < 65536:
        raise BadImage("largest sample out of range")
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n\r]*", b"", raw[at:])
        numbers = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if len(numbers) < n:
            raise BadImage("samples cut short")
        samples = np.array(numbers[:n], dtype="S5").astype(np.int64)
    elif kind == 4:
        line = -(-w // 8)
        if len(raw) < at + 1 + line * h:
            raise BadImage("samples cut short")
        samples = np.unpackbits(np.frombuffer(raw, np.uint8, line * h, at + 1).reshape(h, line), axis=1)[:, :w].ravel()
    else:
        item = 1 if top < 256 else 2
        if len(raw) < at + 1 + n * item:
            raise BadImage("samples cut short")
        samples = np.frombuffer(raw, np.uint8 if item == 1 else ">u2", n, at + 1)
    if kind in (1, 4):
        samples = 1 - samples.astype(np.int64)  # 1 is black
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape((h, w) if depth == 1 else (h, w, 3))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise BadImage("header cut short")
    start = struct.unpack_from("<I", raw, 10)[0]
    size, w, h, _, depth, packing, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", raw, 14)
    if packing or depth not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise BadImage(f"{depth} bits, packing {packing}")
    line = (w * depth + 31) // 32 * 4
    if len(raw) < start + line * abs(h):
        raise BadImage("samples cut short")
    rows = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if depth >= 24:
        return np.ascontiguousarray(rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1])
    places = rows if depth == 8 else np.packbits(np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth), axis=2) >> (8 - depth)
    places = places.reshape(abs(h), -1)[:, :w]
    palette = np.frombuffer(raw, np.uint8, (used or 1 << depth) * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if places.max(initial=0) >= len(palette):
        raise BadImage("a colour outside the palette")
    return places if len(palette) == 256 and (palette == np.arange(256)[:, None]).all() else palette[places]


def decode(raw: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP (1, 4, 8, 24 and 32 bits, not packed) as an array of 8-bit samples."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise BadImage("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else ((image.astype(np.int64) * (299, 587, 114)).sum(axis=2) + 500) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new sample covers, from an integral image; parts of samples count as such."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    iy, ix = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = y - iy, x - ix
    rows = total[iy] + (total[iy + 1] - total[iy]) * fy[:, None]
    corner = rows[:, ix] + (rows[:, ix + 1] - rows[:, ix]) * fx
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: in an 8 by 9 resize, is each sample less than the one to its right?"""
    small = area_resize(grey(image), 8, 9)
    return int.from_bytes(np.packbits((np.diff(small, axis=1) > 1e-9).ravel()).tobytes(), "big")


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def thumbnail(image: np.ndarray, side: int = TILE, enlarge: bool = True) -> bytes:
    """The image resized to a square of grey samples, as an NPY tile; a side that is shorter stays so without ``enlarge``."""
    height, width = (side, side) if enlarge else (min(side, n) for n in image.shape[:2])
    return npy(np.rint(area_resize(grey(image), height, width)).astype(np.uint8))


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text as UTF-8, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _as_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        both = [payload(t) for t in b["text"].to_pylist()]
        media = [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in both]
        yield pa.record_batch([b["doc_id"], pa.array([n for n, _ in both], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def texts_as_images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a binary PGM of 64 columns, a sample a byte.

    A null or empty text is one row of 64 zeros; repeated ids and rows keep a row each.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_as_images, "doc_id long, n_bytes long, media binary")


def features(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Of images in a column: id, height, width, dhash, tile (NPY), error.

    Null, empty and broken images have null features and a text in ``error``; all rows come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for k, raw in zip(b["id"].to_pylist(), b["media"].to_pylist()):
                row = {"id": k, "height": None, "width": None, "dhash": None, "tile": None, "error": None}
                try:
                    image = decode(raw or b"")
                    if not image.size:
                        raise BadImage("no samples")
                    row |= {"height": image.shape[0], "width": image.shape[1], "dhash": f"{difference_hash(image):016x}", "tile": thumbnail(image)}
                except (BadImage, struct.error) as e:
                    row["error"] = str(e)
                out.append(row)
            kinds = [("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tile", pa.binary()), ("error", pa.string())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    rows = pick(df, id=id_col, media=media_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "id long, height int, width int, dhash string, tile binary, error string")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for doc, n, raw in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist()):
            image = decode(raw)
            own = image.tobytes()
            out.append((doc, n, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{difference_hash(image):016x}", thumbnail(image, enlarge=False)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as images in the shared folder, read back from there and described, with their NPY tiles.

    The tiles and hashes are written to the shared folder too, and the rows returned are read from there. Most
    images are lower than a tile: they keep their height, as more rows would be made up.
    A null or empty text is an image of 64 zeros. Rows are handled one by one, so repeated ids and rows
    keep a row each; equal texts have equal values. Other columns are not read.
    """
    media = stored(texts_as_images(df, id_col, text_col), "media")
    return stored(media.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"), "tiles")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir)).withColumn("tile", F.crc32("tile")).withColumnRenamed("tile", "tile_crc32")


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
