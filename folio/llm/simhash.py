"""SimHash near-dedup with the pigeonring filter.

A fingerprint of 64 bits is a ring of eight boxes of eight bits. If two fingerprints differ in at
most three bits, some box starts a chain whose first ``l`` boxes differ in at most ``3 * l / 8`` bits
together, for every ``l`` (the strong form of the pigeonhole principle on a ring). From such a start
the first two boxes are equal, and of the next three at most one differs. So the pair meets under one
of two keys of that start: boxes 0-2 equal, or boxes 0, 1, 3, 4 equal. Pairs that meet are checked
box by box against the budgets, and only those that survive count as links.

Only distinct fingerprints are compared, each named by the smallest id that has it. A key with over
``BUCKET`` fingerprints is dealt out in blocks, every pair of blocks to its own task, so no link is
lost and no task grows. A bucket hands on a star for each of its groups, not all pairs.

Three bits of 64 find only texts that are nearly the same. With more ``draws`` a text has as many
fingerprints, each from the same hashes mixed anew, and texts link that are within three bits in any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, numbered, pick, slices, stored, with_group
from folio.llm.components import components
from folio.llm.told import Told

SHINGLE = 3
DRAWS = 1
#: For stages on word shingles: words of a shingle, fingerprints of a text.
STAGE_SHINGLE, STAGE_DRAWS = 5, 8
DIFFER = 3
BUCKET = 4096
BOXES = 8
BUDGETS = [DIFFER * n // BOXES for n in range(1, BOXES + 1)]
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _mixed(h: np.ndarray, draw: int) -> np.ndarray:
    """The hashes of a draw; those of the first are the hashes themselves."""
    if not draw:
        return h
    x = h + np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE, draws: int = DRAWS) -> np.ndarray:
    """A fingerprint a draw. Words end at ASCII white space; a bit is set if set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(draws, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.concatenate([_mixed(np.array([h(line, 42)], np.uint64), k) for k in range(draws)])
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1]).tolist()]
    hashes = np.array([h(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros((draws, 64), np.int64)
    for i in range(0, len(hashes), 1 << 14):
        for k in range(draws):
            part = np.ascontiguousarray(_mixed(hashes[i : i + (1 << 14)], k))
            counts[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(texts: pa.Array, shingle: int, draws: int) -> pa.Array:
    found = [fingerprint(x, shingle, draws) for x in texts.to_pylist()]
    flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * draws + 1, draws, dtype=np.int32)), pa.array(flat))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, draws: int = DRAWS) -> DataFrame:
    """doc_id, fps: a fingerprint a draw; zeros for a text without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b["doc_id"], _fingerprints(b["text"], shingle, draws)], ["doc_id", "fps"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, fps array<long>")


def _keys() -> F.Column:
    """The sixteen keys of ``fp``: two for each start, with the draw and four bits of name above the boxes."""
    box = lambda i: F.shiftrightunsigned("fp", 8 * (i % BOXES)).bitwiseAND(F.lit(255))
    found = []
    for i in range(BOXES):
        for kind, own in ((0, (0, 1, 2)), (1, (0, 1, 3, 4))):
            key = F.lit(2 * i + kind).cast("long")
            for k in own:
                key = F.shiftleft(key, 8).bitwiseOR(box(i + k))
            key = key.bitwiseOR(F.lit(1 << 40)) if kind else key
            found.append(F.struct(F.lit(i).alias("start"), key.bitwiseOR(F.shiftleft(F.col("draw").cast("long"), 41)).alias("key")))
    return F.array(*found)


def _linked(left: np.ndarray, right: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose chain from ``start`` stays within every budget."""
    boxes = [(start + k) % BOXES for k in range(BOXES)]
    a, b = left.view(np.uint8).reshape(-1, 8), right.view(np.uint8).reshape(-1, 8)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    differ = np.zeros(len(i), np.uint8)
    for box, most in zip(boxes, BUDGETS):
        differ += ONES[a[i, box] ^ b[j, box]]
        stay = differ <= most
        if not stay.all():
            i, j, differ = i[stay], j[stay], differ[stay]
    return i, j


def _stars_of(fp: np.ndarray, rep: np.ndarray, side: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a bucket (or from its one block to its other) as (rep, smallest rep reached)."""
    order = np.argsort(rep, kind="stable")
    fp, rep, side = np.ascontiguousarray(fp[order]), rep[order], side[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own, other = (np.flatnonzero(side == k) for k in (0, 1))
    target = other if len(other) else own
    for i in range(0, len(own), 512):
        for j in range(0, len(target), 512):
            if not len(other) and j < i:
                continue
            x, y = _linked(fp[own[i : i + 512]], fp[target[j : j + 512]], start)
            found.append((own[i + x], target[j + y]))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (np.empty(0, int),) * 2
    a, b = a[a != b], b[a != b]
    least = np.arange(len(fp))
    while len(a):
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(fp)))
    return rep[moved], rep[least[moved]]


def _to_first(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Does each row link to the first one of its bucket, at ``first``? All at once."""
    differ = ONES[np.ascontiguousarray(rows[:, 5] ^ rows[first, 5]).view(np.uint8).reshape(-1, BOXES)]
    chain = (rows[:, 4:5] + np.arange(BOXES)) % BOXES
    return (np.take_along_axis(differ, chain, axis=1).cumsum(axis=1) <= BUDGETS).all(axis=1)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, c, start, fp, rep), sorted by bucket, to the links within each bucket."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
        edges = np.concatenate([[0], cuts, [len(rows)]])
        size, first = np.diff(edges), np.repeat(edges[:-1], np.diff(edges))
        ok = _to_first(rows, first)
        whole = np.logical_and.reduceat(ok, edges[:-1])  # these buckets are stars of their first rows
        star = np.repeat(whole, size) & (first != np.arange(len(rows)))
        x, y = rows[star, 6], rows[first[star], 6]
        a, b = [np.maximum(x, y)], [np.minimum(x, y)]
        for k in np.flatnonzero((size > 2) & ~whole):
            r = rows[edges[k] : edges[k + 1]]
            side = (r[:, 3] == r[:, 2]) & (r[:, 1] != r[:, 2])
            x, y = _stars_of(np.ascontiguousarray(r[:, 5]).view(np.uint64), r[:, 6], side.astype(int), int(r[0, 4]))
            a.append(x)
            b.append(y)
        if sum(map(len, a)):
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=LINKS)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        rows = np.concatenate(held)
        last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1]) + 1 if (rows[0, :3] != rows[-1, :3]).any() else 0
        if last:
            yield from solve(rows[:last])
        held = [rows[last:]]
    if held:
        yield from solve(held[0])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): stars that connect just the reps of (draw, fp, rep) whose fingerprints of a draw link, directly or on."""
    keyed = distinct.select("fp", "rep", F.explode(_keys()).alias("k")).select("k.key", "k.start", "fp", "rep")
    hot = stored(keyed.groupBy("key").count().where(F.col("count") > bucket), "hot")
    if hot.isEmpty():
        dealt = keyed.select("key", *[F.lit(0).cast("long").alias(x) for x in ("lo", "hi", "c")], "start", "fp", "rep")
    else:
        blocks = F.coalesce(F.ceil(F.col("count") / bucket), F.lit(1)).cast("long")
        own = keyed.join(hot, "key", "left").withColumn("n", blocks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")))
        own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
        dealt = own.select("key", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"), "c", "start", "fp", "rep")
    sorted_rows = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sorted_rows.mapInArrow(_buckets, "a long, b long")


def _grouped(prints: DataFrame, bucket: int, draws: int) -> DataFrame:
    """``prints`` (stored, with doc_id and fps) with component_id."""
    distinct = stored(prints.groupBy("fps").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "distinct")
    each = distinct.where("rep IS NOT NULL").select("rep", F.posexplode("fps").alias("draw", "fp"))
    if draws == 1:
        edges = links(each, bucket)
    else:  # texts that differ in one draw may be the same in another
        heads = stored(each.groupBy("draw", "fp").agg(F.min("rep").alias("rep")), "heads")
        same = each.withColumnRenamed("rep", "a").join(heads.withColumnRenamed("rep", "b"), ["draw", "fp"]).where("a <> b").select("a", "b")
        edges = links(heads, bucket).unionByName(same)
    named = components(edges)
    whole = distinct.join(named, distinct.rep == named.node, "left").select("fps", "size", F.coalesce("component", "rep").alias("component_id"))
    return with_group(prints, stored(whole, "components"), "fps")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, shingle: int = SHINGLE, draws: int = DRAWS) -> DataFrame:
    """One row per row of ``df``: doc_id, fps, component_id (smallest id reachable, its own included).

    A null text counts as empty; texts without a word have fingerprints of zero and link like any other.
    Rows without an id take part in no search: their component is that of the rows with the same
    fingerprints, null if only such rows have them. Repeated ids and rows keep one row each. Other columns
    are not read. An empty table gives no rows.
    """
    prints = stored(fingerprints(df, id_col, text_col, shingle, draws), "fingerprints")
    return _grouped(prints, bucket, draws).select("doc_id", "fps", "component_id")


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, draws: int = STAGE_DRAWS) -> DataFrame:
    """``df`` with the smallest id of each group, all columns as they were.

    Rows without an id stay, and so do all rows that have the id of their group. Rows are written once, with
    their fingerprints, and stay in their parts: each part is told which of its rows go.
    """
    rows, names = numbered(df)

    @F.arrow_udf("array<long>")
    def look(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_fingerprints(texts.slice(i, 256), shingle, draws) for i in range(0, max(1, len(texts)), 256)])

    c_id, c_text = (F.col(f"c{names.index(x)}") for x in (id_col, text_col))
    rows = stored(rows.select("*", look(c_text).alias("fps"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "printed")
    groups = _grouped(rows.select(c_id.cast("long").alias("doc_id"), "fps", "part", "n"), BUCKET, draws)
    gone = Told(groups.where("doc_id <> component_id").select("part", "n"), "gone")
    return rows.where(~gone.column("part", "n")).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
