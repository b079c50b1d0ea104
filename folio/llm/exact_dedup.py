"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

The hashes are cut into blocks of about BLOCK, each with a Bloom filter of its own, of two planes of
bits: set once, and set twice or more. In the first pass every part of the rows (what one task wrote)
sends the hashes it has to their blocks, once each, and they set their bits. In the second pass a
block looks its hashes up in the plane of repeats and tells the parts which of theirs may have a copy
(see ``told``). A row with a hash that its part was not told of passes straight through; the others
are grouped by their whole SHA-256, so that a false alarm costs a shuffled row and never a wrong
result. There are as many filters as the rows need, none is collected or broadcast, and rows stay
where they are.

Groups are counted before they shuffle, and large ones are broadcast to their rows (see ``with_group``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, numbered, pick, slices, stored, with_group
from folio.llm.told import Told

BITS_PER_ROW = 16
PROBES = 4
BLOCK = 1 << 18
FLUSH = 1 << 20

DIGEST = "doc_id long, text_sha256 binary, h long, part int"
LEAST = -(1 << 63)


def _digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().lower()).digest()  # bytes.lower() changes A-Z only


def _hashed(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """SHA-256 of the texts and, as the hash, its first eight bytes."""
    found = [_digest(x) for x in texts.to_pylist()]
    return pa.array(found, pa.binary()), pa.array(np.array([int.from_bytes(x[:8], "little", signed=True) for x in found], np.int64))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for b in slices(batches, 1024):
        yield pa.record_batch([b["doc_id"], *_hashed(b["text"]), pa.array(np.full(b.num_rows, part, np.int32))], ["doc_id", "text_sha256", "h", "part"])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, h, part) of the texts, A-Z lower-cased; a null text counts as empty."""
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_digests, DIGEST)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits that a hash sets in the filter of its block: PROBES by rows."""
    u = h.view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)])


def _sent(blocks: int):
    """(block, part, h, again) of a part's hashes, once each; ``again`` where the part has one twice."""
    shift = np.uint64(64 - (blocks.bit_length() - 1))

    def messages(part: int, h: np.ndarray) -> pa.RecordBatch:
        h, n = np.unique(h, return_counts=True)
        block = (h.view(np.uint64) >> shift if blocks > 1 else np.zeros(len(h))).astype(np.int64)
        return pa.record_batch([pa.array(block), pa.array(np.full(len(h), part, np.int32)), pa.array(h), pa.array(n > 1)], ["block", "part", "h", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for b in batches:
            part, h = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "h"))
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append(h[part == p])
            size += len(h)
            if size >= FLUSH:
                yield from (messages(p, np.concatenate(x)) for p, x in held.items())
                held, size = {}, 0
        yield from (messages(p, np.concatenate(x)) for p, x in held.items())

    return run


def _repeated(bits_per_row: int):
    """Of a block's messages: (part, n) for the hashes whose bits are all set twice."""

    def run(rows: pa.Table) -> pa.Table:
        part, h, again = (rows[c].to_numpy() for c in ("part", "h", "again"))
        bits = 1 << max(6, (len(h) * bits_per_row - 1).bit_length())
        at = positions(h, bits)
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for probe in at:
            seen, first, n = np.unique(probe, return_index=True, return_counts=True)
            twice[seen[(n > 1) | once[seen]]] = True
            once[seen] = True
        twice[at[:, again]] = True
        maybe = twice[at].all(axis=0)
        return pa.table({"part": pa.array(part[maybe], pa.int32()), "n": pa.array(h[maybe], pa.int64())})

    return run


def repeats(keys: DataFrame, bits_per_row: int = BITS_PER_ROW, block: int = BLOCK) -> Told:
    """What each part of ``keys`` (columns h and part, stored) is told of: its hashes that may be repeated."""
    blocks = 1 << max(0, -(-keys.count() // block) - 1).bit_length()
    sent = keys.select("part", "h").mapInArrow(_sent(blocks), "block long, part int, h long, again boolean")
    return Told(sent.groupBy("block").applyInArrow(_repeated(bits_per_row), "part int, n long"), "repeats")


def _with_keepers(flagged: DataFrame, keep: Column) -> DataFrame:
    """``flagged`` (stored) with the largest ``keep`` of the rows of one text, and their number as ``size``."""
    keepers = stored(flagged.groupBy("text_sha256").agg(F.max(keep).alias("keep"), F.count("*").alias("size")), "keepers")
    return with_group(flagged, keepers, "text_sha256")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so null and
    empty texts are copies of each other. The largest doc_id stays. A null doc_id counts as the
    smallest; ``keep_id`` is null where all ids are. Where the id that stays is itself repeated,
    each of its rows is marked as kept (``unique_rows`` keeps one). Other columns are not read. An
    empty table gives no rows.
    """
    keys = stored(digests(df, id_col, text_col), "digests")
    marked = stored(keys.select("doc_id", "text_sha256", repeats(keys).column("part", "h").alias("maybe")), "marked")
    sha = F.lower(F.hex("text_sha256")).alias("text_sha256")
    alone = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    own = F.coalesce("doc_id", F.lit(LEAST))
    grouped = _with_keepers(marked.where("maybe").drop("maybe"), own)
    return alone.unionByName(grouped.select("doc_id", F.nullif("keep", F.lit(LEAST)).alias("keep_id"), F.col("size").alias("group_size"), (own == F.col("keep")).alias("kept"), sha))


def unique_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``decide`` drops, all columns as they were, one row of each text.

    Rows are written once, with their digests, and stay in their parts: only the digests of possible
    copies shuffle, and each part is told which of its rows go.
    """
    rows, names = numbered(df)

    @F.arrow_udf("sha binary, h long")
    def look(texts: pa.Array) -> pa.Array:
        parts = [_hashed(texts.slice(i, 512)) for i in range(0, max(1, len(texts)), 512)]
        return pa.StructArray.from_arrays([pa.concat_arrays([p[k] for p in parts]) for k in (0, 1)], ["sha", "h"])

    c_id, c_text = (F.col(f"c{names.index(x)}") for x in (id_col, text_col))
    rows = stored(rows.select("*", look(c_text).alias("look"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "hashed")
    keys = rows.select(F.col("look.sha").alias("text_sha256"), F.col("look.h").alias("h"), "part", "n", F.coalesce(c_id.cast("long"), F.lit(LEAST)).alias("ord"))
    marked = keys.select("*", repeats(keys).column("part", "h").alias("maybe"))
    flagged = stored(marked.where("maybe").drop("maybe", "h"), "flagged")
    gone = _with_keepers(flagged, F.struct("ord", "n")).where("n <> keep.n").select("part", "n")
    return rows.where(~Told(gone, "gone").column("part", "n")).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d"""
}
