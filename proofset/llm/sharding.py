"""Consistent-hash ring with virtual nodes and bounded loads.

Every row's key hashes to an arc of the ring; the arc's virtual node names the shard that should hold it.
A shard takes rows up to its capacity; what does not fit walks clockwise, virtual node by virtual node, to the
next shard with room. Only counts per (arc, cell) reach the driver (a number set by parameters, not by the
data); it settles the overflow on whole intervals of ranks, and each row finds its interval by rank.

Law of the result: `rows`. Capacities are the row count divided by the shards, the first (rows mod shards)
shards hold one more, so counts are at most one apart. Rows of equal text hash to the same arc and lie next to
each other; a group is only split where an arc overflows.

Defined cases: a null text hashes and counts as an empty one, size 16; a null id is a key like any other;
equal rows are placed as separate rows with slots of their own; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from proofset.llm.common import table

RING = 1 << 32


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Positions of all virtual nodes in ascending order, and the shard of each."""
    nodes = sorted({xxhash.xxh3_64_intdigest(f"shard {s} node {v}".encode()) % RING: s for s in range(shards) for v in range(vnodes)}.items())
    return [p for p, _ in nodes], [s for _, s in nodes]


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def settle(counts: dict[tuple[int, int], int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Place the counted cells: rows (arc, cell, first rank, end rank, shard, first slot).

    Home claims come first (so a row moves only if its own shard is full); then overflow walks clockwise,
    nearest arcs first. Work and result are bounded by cells x virtual nodes, not by rows."""
    room, used, out, over = list(room), [0] * len(room), [], []

    def take(arc: int, cell: int, at: int, left: int, shard: int) -> int:
        n = min(left, room[shard])
        if n:
            out.append((arc, cell, at, at + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    for (arc, cell), n in sorted(counts.items()):
        got = take(arc, cell, 0, n, owners[arc])
        if got < n:
            over.append((arc, cell, got, n - got))
    step = 1
    while over:
        still = []
        for arc, cell, at, left in over:
            got = take(arc, cell, at, left, owners[(arc + step) % len(owners)])
            if got < left:
                still.append((arc, cell, at + got, left - got))
        over, step = still, step + 1
    return out


def shard_bounded(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", vnodes: int = 32, cells: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, home_shard. vnodes: per shard; cells: parts into which the
    rows of an arc are dealt by id, so that no arc (one group of copies may hold a third of all rows) is ranked
    by one task alone."""
    spark = docs.sparkSession
    positions, owners = ring(shards, vnodes)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("pos"),
    )
    # the arc of a position: the first virtual node at or after it, clockwise
    at = F.pmod(F.col("pos"), F.lit(RING))
    rows = rows.withColumn("arc", _arc(at, positions)).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    counted = {(r.arc, r.cell): r.n for r in rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most shards x vnodes x cells rows
    placed = settle(counted, owners, capacities(sum(counted.values()), shards))
    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("arc", "cell", "shard") else T.LongType(), False) for n in ("arc", "cell", "first", "end", "shard", "base")])
    intervals = F.broadcast(spark.createDataFrame(placed, schema))  # bounded by the cells, see settle()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("pos", "doc_id", "size")).cast("long") - 1)
    homes = F.element_at(_numbers(owners, "int"), F.col("arc") + 1)
    joined = ranked.join(intervals, ["arc", "cell"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), homes.alias("home_shard"))


def _arc(at, positions: list[int]):
    """Index of the first virtual node at or after a position, wrapping round. 256 slots of the ring each keep
    the index at their start; inside a slot the few nodes are counted."""
    slots = 256
    width = RING // slots
    first = [bisect_right(positions, k * width - 1) for k in range(slots)]
    within = [[p for p in positions if k * width <= p < (k + 1) * width] for k in range(slots)]
    slot = F.floor(at / width).cast("int")
    start = F.element_at(_numbers(first, "int"), slot + 1)
    nodes = F.element_at(F.array(*[_numbers(w, "bigint") for w in within]), slot + 1)
    return F.pmod(start + F.size(F.filter(nodes, lambda p: p < at)), F.lit(len(positions))).cast("int")


def _numbers(values: list[int], kind: str):
    """An array literal, parsed from one string: a call into the JVM for each number would take seconds."""
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<{kind}>)")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_bounded(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
