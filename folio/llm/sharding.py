"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards hang in racks and racks in regions; a node weighs what its shards weigh together. A row goes
down from the top: at each level every child makes a draw from the row's key and the child's own name,
``-ln(u) / weight``, and the smallest draw wins. A child's draws do not depend on its siblings, so a
change of weight moves rows only into or out of the subtrees whose weights change; below a node whose
children keep their weights nothing moves. A shard that is added hangs in a region of its own, so it
takes rows only into itself.

A row's place in its shard (``slot``) is its rank by key: rows are range-partitioned by shard and key, and
the rows of a shard in earlier parts are counted, so no task holds a whole shard.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, stored

SHARDS = 16
RACKS, LEAVES = 2, 2  # of a region, of a rack
#: 13 hexadecimal digits, which a double holds without loss.
STEPS = float(1 << 52)


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, added: int = 0) -> list[Shard]:
    """Regions of RACKS racks of LEAVES shards; each shard ``added`` later has a region of its own."""
    each = RACKS * LEAVES
    first = [Shard(i, f"r{i // each}", f"r{i // each}/k{i % each // LEAVES}") for i in range(shards)]
    return first + [Shard(i, f"r+{i}", f"r+{i}/k0") for i in range(shards, shards + added)]


def _draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / (STEPS + 1)
    return -F.log(u) / F.lit(weight)


def _choice(key: Column, children: dict[str, float], then: dict[str, Column]) -> Column:
    """What ``then`` has for the child whose draw is smallest; of equal draws the name that sorts first."""
    names = sorted(n for n, w in children.items() if w > 0)
    if len(names) == 1:
        return then[names[0]]
    won = F.array_min(F.array(*[F.struct(_draw(key, n, children[n]).alias("draw"), F.lit(n).alias("name")) for n in names]))["name"]
    found = then[names[-1]]
    for n in names[:-1]:
        found = F.when(won == n, then[n]).otherwise(found)
    return found


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key (a string column): the descent through region, rack and shard."""
    regions: dict[str, dict[str, list[Shard]]] = defaultdict(lambda: defaultdict(list))
    for s in shards:
        regions[s.region][s.rack].append(s)
    weigh = lambda own: sum(s.weight for s in own)
    by_region = {}
    for region, racks in regions.items():
        by_rack = {}
        for rack, own in racks.items():
            leaves = {f"{rack}/s{s.shard}": s for s in own}
            by_rack[rack] = _choice(key, {n: s.weight for n, s in leaves.items()}, {n: F.lit(s.shard) for n, s in leaves.items()})
        by_region[region] = _choice(key, {k: weigh(own) for k, own in racks.items()}, by_rack)
    return _choice(key, {r: sum(weigh(own) for own in racks.values()) for r, racks in regions.items()}, by_region)


def with_slots(df: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """``df`` with ``slot``: each row's rank in its shard by ``key``, gapless from 0.

    Rows whose key is null come first. Rows with equal keys have places next to each other, in any order;
    they may lie in several parts, as the order of input decides between them.
    """
    ordered = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shard, key, "_tie").sortWithinPartitions(shard, key, "_tie").drop("_tie")
    placed = stored(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    sizes = placed.groupBy(shard, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = sizes.withColumn("_ahead", F.expr(f"sum(_n) over (partition by {shard} order by _part) - _n - _first")).drop("_n", "_first")
    found = placed.join(F.broadcast(ahead), [shard, "_part"])  # a row for each part, and one for each shard
    return found.withColumn("slot", F.col("_ahead") + F.col("_at")).drop("_part", "_at", "_ahead")


def sharded(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards decide. A null doc_id is a key of its own. A null
    text has size 1 and the checksum of no bytes. Repeated ids share a shard and have a slot each.
    Other columns are not read. An empty table gives no rows.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce("text", F.lit(""))
    placed = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree(shards)).alias("shard"),
        place(key, tree(shards, 1)).alias("grown_shard"),
    )
    return with_slots(placed).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
