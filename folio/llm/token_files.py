"""Token ids in files of patched frame-of-reference blocks.

A segment holds whole documents, in this order (all numbers little-endian):

* head: magic ``FTS1``, unsigned 32-bit: documents, blocks, exceptions, length of the packed part; 64-bit: ids
* by document: 64-bit doc_id (the smallest value stands for null), 32-bit number of ids
* by block of 256 ids: 32-bit minimum, 8-bit width, 32-bit start of its packed bits, 32-bit first exception
* exceptions: 8-bit places in their blocks, then 32-bit values
* packed part: 256 numbers of the block's width each

Numbers are ids less the block's minimum. The width is that of the block's 90th percentile; numbers
that need more are exceptions, stored whole and packed as 0. The last block is filled up with its last
id. Any block can be read by itself from the index of starts.

A file of segments is a Parquet part, written by Spark's own commit protocol to any file system that
Spark reaches; segments of a file are numbered in ascending doc_id order and so are files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, shared_dir, slices
from folio.llm.tokens import BATCH, END_ID, default_path, encoder, with_end

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
HEAD = struct.Struct("<4sIIIIQ")
MAGIC = b"FTS1"
NULL_ID = -(1 << 63)
SEGMENTS = "part int, segment int, first_id long, n_ids long, n_docs int, payload binary"


def _bits(top: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.searchsorted(1 << np.arange(33, dtype=np.uint64), top.astype(np.uint64), "right").astype(np.uint8)


def _spread(width: int) -> Iterator[tuple[int, int, int, int]]:
    """Eight numbers take ``width`` bytes: for each number its place, first byte, shift there, and bytes that it touches."""
    for k in range(8 if width else 0):
        first, shift = divmod(k * width, 8)
        yield k, first, shift, -(-(shift + width) // 8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Blocks of numbers to blocks of bytes, lowest bits first."""
    eights = rows.reshape(len(rows), BLOCK // 8, 8)
    kind = np.uint32 if width <= 24 else np.uint64
    out = np.zeros((len(rows), BLOCK // 8, width), np.uint8)
    for k, first, shift, touched in _spread(width):
        moved = eights[:, :, k].astype(kind) << kind(shift)
        for j in range(touched):
            out[:, :, first + j] |= (moved >> kind(8 * j)).astype(np.uint8)
    return out.reshape(len(rows), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    eights = packed.reshape(len(packed), BLOCK // 8, width)
    kind = np.uint32 if width <= 24 else np.uint64
    out = np.zeros((len(packed), BLOCK // 8, 8), "<u4")
    for k, first, shift, touched in _spread(width):
        found = eights[:, :, first].astype(kind)
        for j in range(1, touched):
            found |= eights[:, :, first + j].astype(kind) << kind(8 * j)
        out[:, :, k] = (found >> kind(shift)) & kind((1 << width) - 1)
    return out.reshape(len(packed), BLOCK)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    kind = "<u2" if not n or ids.max() < 1 << 16 else "<u4"
    rows = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1] if n else 0, ids.dtype)]).astype(kind).reshape(blocks, BLOCK)
    least = rows.min(axis=1, initial=np.iinfo(kind).max)
    rows = rows - least[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    width = _bits(np.partition(rows, at, axis=1)[:, at])
    odd = rows.astype(np.uint64 if kind == "<u4" else np.uint32) >= (1 << width.astype(np.uint64 if kind == "<u4" else np.uint32))[:, None]
    block_of, place = np.nonzero(odd)
    values = rows[odd].astype("<u4")
    rows[odd] = 0
    starts, body, size = np.zeros(blocks, "<u4"), [], 0
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        starts[own] = size + np.arange(len(own)) * (BLOCK // 8 * int(w))
        body.append(_pack(rows[own], int(w)).tobytes())
        size += len(body[-1])
    first = np.searchsorted(block_of, np.arange(blocks)).astype("<u4")
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), blocks, len(values), size, n),
            doc_ids.astype("<i8").tobytes(),
            lengths.astype("<u4").tobytes(),
            least.astype("<u4").tobytes(),
            width.tobytes(),
            starts.tobytes(),
            first.tobytes(),
            place.astype(np.uint8).tobytes(),
            values.tobytes(),
            *body,
        ]
    )


class Segment:
    """A segment's bytes, read."""

    def __init__(self, raw: bytes):
        magic, docs, self.blocks, odd, size, self.n = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.lengths = take("<i8", docs), take("<u4", docs)
        self.least, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.starts, self.first = take("<u4", self.blocks), take("<u4", self.blocks)
        self.place, self.values = take("u1", odd), take("<u4", odd)
        self.body = take("u1", size)

    def _unpacked(self, own: np.ndarray, w: int) -> np.ndarray:
        each = BLOCK // 8 * w
        return _unpack(self.body[int(self.starts[own[0]]) :][: each * len(own)].reshape(len(own), each), w)

    def block(self, i: int) -> np.ndarray:
        """The ids of one block, from its own bytes."""
        found = self._unpacked(np.array([i]), int(self.width[i]))[0]
        end = int(self.first[i + 1]) if i + 1 < self.blocks else len(self.values)
        found[self.place[int(self.first[i]) : end]] = self.values[int(self.first[i]) : end]
        return (found + self.least[i])[: self.n - i * BLOCK]

    def ids(self) -> np.ndarray:
        rows = np.zeros((self.blocks, BLOCK), "<u4")
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            rows[own] = self._unpacked(own, int(w))
        block = np.searchsorted(self.first, np.arange(len(self.values)), "right") - 1
        rows[block, self.place] = self.values
        rows += self.least[:, None]
        return rows.ravel()[: self.n]


def _written(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        docs, raws, held, segment, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, raws, held, segment, first
            ids = np.frombuffer(b"".join(raws), "<u4")
            lengths = np.array([len(r) // 4 for r in raws], "<u4")
            payload = encode_segment(np.array(docs, np.int64), lengths, ids)
            row = [[part], [segment], [first], [len(ids)], [len(docs)], [payload]]
            docs, raws, held, segment, first = [], [], 0, segment + 1, first + len(ids)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, kinds)], ["part", "segment", "first_id", "n_ids", "n_docs", "payload"])

        for b in slices(batches, BATCH):
            for doc, raw in zip(b["doc_id"].to_pylist(), enc.encode(b["text"])):
                docs.append(NULL_ID if doc is None else doc)
                raws.append(with_end(raw, end_id))
                held += len(raws[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_files(df: DataFrame, to: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all documents to files in the folder ``to``, in ascending doc_id order.

    Rows without an id come first; repeated ids and rows are written each for itself, in any order among them. A null
    text is the end id alone. An empty table gives a folder without documents.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_written(path or default_path(), end_id), SEGMENTS).write.option("compression", "none").parquet(to)


def read_files(spark: SparkSession, at: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, in file order by start."""
    files = spark.read.schema(SEGMENTS).parquet(at)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a file
    base, so_far = {}, 0
    for r in totals:
        base[r["part"]], so_far = so_far, so_far + r["n"]
    known = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for part, first, payload in zip(b["part"].to_pylist(), b["first_id"].to_pylist(), b["payload"].to_pylist()):
                s = Segment(payload)
                raw, ends = s.ids().tobytes(), np.cumsum(s.lengths.astype(np.int64))
                starts = ends - s.lengths
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]
                doc = pa.array(s.doc_ids.astype(np.int64), mask=s.doc_ids == NULL_ID)
                yield pa.record_batch([doc, pa.array(starts + first + known.value[part]), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "first_id", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents written to files in the shared folder and read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Rows without an id come first; rows with one id keep a
    place each, next to one another. Other columns are not read. An empty table gives no rows.
    """
    to = f"{shared_dir(df.sparkSession)}/folio-tokens-{uuid.uuid4().hex}"
    write_files(df, to, path, id_col, text_col)
    return read_files(df.sparkSession, to)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))


QUERIES = {"op6_token_files": op6_token_files}
ORACLES: dict[str, str] = {}
