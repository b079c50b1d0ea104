"""Best-fit packing: bulk-synchronous rounds over range-sorted pieces and gaps.

Pieces and gaps are two tables of rows. A round range-sorts both together by size and sweeps every
part from small to large: a gap takes the longest piece before it that is free, so each piece that is
taken gets a gap that is its successor in the order. What a part cannot settle goes on: the gaps that
found no piece are counted, and the pieces left over, and from these numbers a part the rank of each
says which gap of a later part takes which pieces of an earlier one. Gaps shrink by what they took,
pieces without a gap and the shrunk gaps meet again in the next round.

It starts with as many gaps as the tokens fill. When a round places under one in SLOW of the pieces
that are left, too few of the gaps fit them: these close, and as many new ones open as the pieces fill.

When what is left fits in one part, its rounds need no exchange and go on in the task that holds it.

So that short pieces do not take a round each, those under one in SHORT of a sequence go in bundles of up to
that length until bundles no longer fit, and a gap takes several of up to one in MANY of a sequence in a round.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, slices, stored
from folio.llm.tokens import BATCH, END_ID, default_path, encoder, held, with_end

CAPACITY = 4096
SHORT = 16
MANY = 4
SLOW = 10
#: Rows that a task sweeps, about.
ROWS = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, BATCH):
            ids, out = b["doc_id"].to_pylist(), [[] for _ in range(5)]
            for doc, raw in zip(ids, enc.encode(b["text"])):
                raw = with_end(raw, end_id)
                n = len(raw) // 4
                for k in range(0, n, capacity):
                    part = raw[4 * k : 4 * (k + capacity)]
                    for col, v in zip(out, (doc, k // capacity, k, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids, with the end id, in pieces of at most ``capacity``.

    A null text has the end id alone; repeated ids and rows have pieces of their own.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_cut(path, capacity, end_id), PIECES)


def _bundled(limit: int):
    """Pieces with a number ``n``, and the number and place in it of their bundle of at most ``limit``, that of its first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("packing",), dict)  # what the encoder held goes
        n = TaskContext.get().partitionId() << 33
        own, used = n, limit
        for b in batches:
            bundle, inner = [], []
            for k, length in enumerate(b["length"].to_pylist(), n):
                if length >= limit:
                    bundle.append(k)
                    inner.append(0)
                    continue
                if used + length > limit:
                    own, used = k, 0
                bundle.append(own)
                inner.append(used)
                used += length
            numbers = pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.record_batch([*b.columns, numbers, pa.array(bundle, pa.int64()), pa.array(inner, pa.int64())], [*b.schema.names, "n", "bundle", "inner"])

    return run


SWEPT = pa.schema([("item", pa.int64()), ("length", pa.int64()), ("gap", pa.int64()), ("room", pa.int64()), ("after", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def _matches(rows: Iterable[tuple[bool, int, int]], free: list[tuple[int, int]], many: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(item, length, gap, room, after) of (is_gap, id, size) in order, and the gaps that found none; ``free`` holds the items that are free."""
    taken, lone = [], []
    for is_gap, number, size in rows:
        if not is_gap:
            free.append((number, size))
        elif free:
            item, length = free.pop()
            while free and free[-1][1] <= min(size - length, many):
                taken.append((item, length, number, size, None))
                size -= length
                item, length = free.pop()
            taken.append((item, length, number, size, size - length))
        else:
            lone.append((number, size))
    return taken, lone


def _sweep(many: int):
    """One part, sorted by size: (item, length, gap, room, after) of matches; what is left has nulls, its part and its rank there.

    ``after`` is the room that a gap has at the end, in the row of the last item that it takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, free, alone = TaskContext.get().partitionId(), [], 0
        held(("packing",), dict)

        def rows(item: list, length: list, gap: list, room: list, after: list, rank: list) -> pa.RecordBatch:
            n = max(len(item), len(gap))
            full = lambda x: pa.array(x, pa.int64()) if x else pa.nulls(n, pa.int64())
            return pa.record_batch([*map(full, (item, length, gap, room, after)), pa.array(np.full(n, part, np.int32)), full(rank)], schema=SWEPT)

        for b in batches:
            taken, lone = _matches(zip(*(b[c].to_pylist() for c in ("is_gap", "id", "size"))), free, many)
            if taken:
                yield rows(*map(list, zip(*taken)), [])
            if lone:
                yield rows([], [], *map(list, zip(*lone)), [], list(range(alone, alone + len(lone))))
                alone += len(lone)
        for i in range(0, len(free), 1 << 16):
            own = free[i : i + (1 << 16)]
            yield rows(*map(list, zip(*own)), [], [], [], list(range(i, i + len(own))))

    return run


def _carried(left: list[tuple[int, int, int, int, int]], many: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """From (part, gaps left, least room of them, items left, longest of them) of all parts in order: which ranks meet.

    (part of the gaps, first rank, gaps; part of the items, rank after the last, items; items a gap): gaps take the
    longest items of earlier parts that are free, several where all of a part's are at most ``many`` long and fit. There
    are two runs a part at most.
    """
    free: list[list[int]] = []
    runs = []
    for part, gaps, room, items, longest in left:
        at = 0
        while at < gaps and free:
            own, n, size = free[-1]
            each = max(1, room // size) if size <= many else 1
            used = min(gaps - at, -(-n // each))
            take = min(n, used * each)
            runs.append((part, at, used, own, n, take, each))
            at += used
            free[-1][1] -= take
            if not free[-1][1]:
                free.pop()
        if items:
            free.append([part, items, longest])
    return runs


def _round(state: DataFrame, rows: int, many: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Of about so many rows (is_gap, id, size): matches (item, length, gap, room), the rows after them, how many matches and items left."""
    spark = state.sparkSession
    ordered = state.repartitionByRange(-(-rows // ROWS), "size", "is_gap", "id").sortWithinPartitions("size", "is_gap", "id")
    swept = stored(ordered.mapInArrow(_sweep(many), "item long, length long, gap long, room long, after long, part int, rank long"), "swept")
    here, gaps, items = "item IS NOT NULL AND gap IS NOT NULL", "item IS NULL", "gap IS NULL"
    counts = [F.count_if(F.expr(x)).alias(n) for x, n in ((here, "here"), (gaps, "gaps"), (items, "items"))]
    counts += [F.min(F.expr(f"if({gaps}, room, null)")).alias("least"), F.max(F.expr(f"if({items}, length, null)")).alias("longest")]
    parts = swept.groupBy("part").agg(*counts).orderBy("part").collect()
    runs, first, taken = [], 0, 0
    for run in _carried([(r["part"], r["gaps"], r["least"] or 0, r["items"], r["longest"] or 0) for r in parts], many):
        runs.append((*run, first))
        first, taken = first + run[2], taken + run[5]
    matched = swept.where(here).select("item", "length", "gap", "room", "after")
    left = swept.where(f"NOT ({here})")
    if runs:
        plan = F.broadcast(spark.createDataFrame(runs, "gap_part int, gap_rank long, used long, item_part int, item_rank long, take long, each long, first long"))
        gap_rows = swept.where(gaps).join(plan, F.expr("part = gap_part AND rank >= gap_rank AND rank < gap_rank + used"), "left")
        gap_rows = gap_rows.select("item", "length", "gap", "room", "rank", F.expr("first + rank - gap_rank").alias("meet"))
        item_rows = swept.where(items).join(plan, F.expr("part = item_part AND rank < item_rank AND rank >= item_rank - take"), "left")
        item_rows = item_rows.select("item", "length", "gap", "room", "rank", F.expr("first + (item_rank - 1 - rank) div each").alias("meet"))
        met = item_rows.where("meet IS NOT NULL").select("item", "length", "rank", "meet").join(gap_rows.where("meet IS NOT NULL").select("gap", "room", "meet"), "meet")
        met = met.withColumns({"so_far": F.expr("sum(length) over (partition by meet order by rank desc)"), "total": F.expr("sum(length) over (partition by meet)")})
        met = met.select("item", "length", "gap", F.expr("room - so_far + length").alias("room"), F.expr("if(so_far = total, room - total, null)").alias("after"))
        matched = stored(matched.unionByName(met), "matched")
        left = gap_rows.unionByName(item_rows).where("meet IS NULL")
    shrunk = matched.where("after > 0").select(F.lit(True).alias("is_gap"), F.col("gap").alias("id"), F.col("after").alias("size"))
    after = shrunk.unionByName(left.select(F.col("gap").isNotNull().alias("is_gap"), F.coalesce("gap", "item").alias("id"), F.coalesce("room", "length").alias("size")))
    n = sum(r["here"] for r in parts) + taken
    rest = sum(r["items"] for r in parts) - taken
    return matched, after, n, rest


def _alone(capacity: int, many: int, bundles: bool, opened: int):
    """All rounds of one part: (item, gap, room) of matches, and of what is left when bundles no longer fit either item or gap, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("packing",), dict)
        state, at = [x for b in batches for x in zip(*(b[c].to_pylist() for c in ("size", "is_gap", "id")))], opened

        def rows(*columns: Iterable) -> Iterator[pa.RecordBatch]:
            cols = [pa.array(c, pa.int64()) for c in columns]
            yield pa.record_batch(cols, ["item", "gap", "room", "size"])

        while state:
            state.sort()
            free: list[tuple[int, int]] = []
            taken, lone = _matches(((is_gap, number, size) for size, is_gap, number in state), free, many)
            if taken:
                item, _, gap, room, _ = zip(*taken)
                yield from rows(item, gap, room, [None] * len(item))
            items = [(size, False, n) for n, size in free]
            gaps = [(size, True, n) for n, size in lone] + [(after, True, gap) for *_, gap, _, after in taken if after]
            if not items:
                return
            if len(taken) * SLOW < len(items):
                if bundles:
                    size, is_gap, number = zip(*items, *gaps)
                    yield from rows(*([n if g is x else None for g, n in zip(is_gap, number)] for x in (False, True)), [None] * len(size), size)
                    return
                new = -(-sum(size for size, *_ in items) // capacity)
                gaps = [(capacity, True, at + k) for k in range(new)]
                at += new
            state = items + gaps

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (columns of PIECES) with sequence_id and offset. Every round is written to the shared folder."""
    spark, short, many = cut.sparkSession, max(1, capacity // SHORT), max(1, capacity // MANY)
    cut = stored(stored(cut, "pieces").mapInArrow(_bundled(short), f"{PIECES}, n long, bundle long, inner long"), "bundled")
    total, rest = cut.agg(F.sum("length"), F.count_if(F.expr("n = bundle"))).first()
    items = lambda rows, by: rows.groupBy(by).agg(F.sum("length").alias("size")).select(F.lit(False).alias("is_gap"), F.col(by).alias("id"), "size")
    gaps = lambda a, b: spark.range(a, b).select(F.lit(True).alias("is_gap"), "id", F.lit(capacity).cast("long").alias("size"))
    opened = still = -(-(total or 0) // capacity)
    bundles, placed = True, []
    state = items(cut, "bundle").unionByName(gaps(0, opened))
    while rest:
        if alone := rest + still <= ROWS:
            done = stored(state.repartition(1).mapInArrow(_alone(capacity, many, bundles, opened), "item long, gap long, room long, size long"), "alone")
            matched = done.where("item IS NOT NULL AND gap IS NOT NULL")
            state = done.where("item IS NULL OR gap IS NULL").select(F.col("gap").isNotNull().alias("is_gap"), F.coalesce("gap", "item").alias("id"), "size")
            n, rest = 0, state.where("NOT is_gap").count() if bundles else 0
        else:
            matched, state, n, rest = _round(state, rest + still, many)
        if n or alone:
            placed.append(matched.select(F.lit(bundles).alias("bundles"), F.col("item").alias("id"), "gap", "room"))
        if rest and n * SLOW < rest:
            if bundles:
                left = state.where("NOT is_gap").select(F.col("id").alias("bundle"))
                state = stored(state.where("is_gap").unionByName(items(cut.join(left, "bundle", "left_semi"), "n")), "split")
                rest, bundles = state.where("NOT is_gap").count(), False
            else:
                left = state.where("NOT is_gap")
                still = -(-left.agg(F.sum("size")).first()[0] // capacity)
                state = left.unionByName(gaps(opened, opened + still))
                opened += still
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not placed:
        return cut.select(*names, *[F.lit(0).cast("long").alias(x) for x in ("sequence_id", "offset")])
    whole = F.struct(F.lit(True).alias("bundles"), F.col("bundle").alias("id"), "inner")
    single = F.struct(F.lit(False).alias("bundles"), F.col("n").alias("id"), F.lit(0).cast("long").alias("inner"))
    found = cut.select(*names, F.explode(F.array(whole, single)).alias("key")).select(*names, "key.*")
    found = found.join(functools.reduce(DataFrame.unionByName, placed), ["bundles", "id"])
    return found.select(*names, F.col("gap").alias("sequence_id"), (capacity - F.col("room") + F.col("inner")).alias("offset"))


def packed(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents over ``capacity`` ids are cut. Repeated
    ids and rows are packed like any others, each on its own; rows without an id keep a null doc_id.
    Other columns are not read. An empty table gives no rows.
    """
    return pack(pieces(df, path or default_path(), id_col, text_col, capacity), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
