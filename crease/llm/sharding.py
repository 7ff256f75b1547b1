"""Operator 7: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring cut into 2**16 cells; a row's key
hashes to a cell and belongs to the first shard clockwise.  A shard takes at
most its quota, and what overflows continues clockwise to the next shard with
room, so the balance is guaranteed whatever the keys are.

On Spark only counts per cell (at most 65,536 numbers, whatever the input)
meet on the driver.  They are enough to fill the ring: all rows of one cell
have the same clockwise order of shards, so a cell's rows are cut by rank into
a few runs, one per shard.  Rows get their rank inside their cell by a window
over (cell), about rows / 65,536 in a group.

Defined cases.  Null keys hash by the other carried columns, so they spread
over the ring.  Rows equal in every carried column are counted before any
shuffle, ranked as one run and expanded again in bounded pieces, so one
repeated row may hold a third of the table.  Empty table: no rows.  Only
``key`` and ``carry`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crease.llm.common import only, stored

CELL_BITS = 16
PIECE = 10_000  # repeated rows expanded by one task at a time


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


class Ring:
    """Cells of the ring and the clockwise order of shards seen from each."""

    def __init__(self, n_shards: int, vnodes: int):
        owner: dict[int, tuple[int, int]] = {}
        for shard in range(n_shards):
            for k in range(vnodes):
                h = _hash(f"{shard}/{k}")
                cell, tie = h >> (64 - CELL_BITS), (h, shard)
                if cell not in owner or tie < owner[cell]:
                    owner[cell] = tie
        self.n_shards = n_shards
        self.points = sorted(owner)
        self.owners = [owner[c][1] for c in self.points]
        self._orders: dict[int, list[int]] = {}

    def order(self, cell: int) -> list[int]:
        """Shards clockwise from ``cell``, nearest first."""
        at = bisect_left(self.points, cell) % len(self.points)
        if at not in self._orders:
            turn = self.owners[at:] + self.owners[:at]
            found = list(dict.fromkeys(turn))
            self._orders[at] = found + [s for s in range(self.n_shards) if s not in set(found)]
        return self._orders[at]


def quotas(total: int, demand: list[int], load_factor: float) -> list[int]:
    """Rows a shard may take.  A load factor of 1 gives counts at most one apart."""
    n = len(demand)
    if load_factor > 1:
        return [int(-(-total * load_factor // n))] * n
    most_wanted = sorted(range(n), key=lambda s: (-demand[s], s))
    extra = set(most_wanted[: total % n])
    return [total // n + (s in extra) for s in range(n)]


def fill(counts: dict[int, int], n_shards: int, vnodes: int = 64, load_factor: float = 1.0) -> list[tuple]:
    """Runs (cell, first rank, end rank, shard, first slot) from the counts per cell."""
    ring = Ring(n_shards, vnodes)
    demand = [0] * n_shards
    for cell, n in counts.items():
        demand[ring.order(cell)[0]] += n
    room = quotas(sum(counts.values()), demand, load_factor)
    used: dict[int, int] = defaultdict(int)
    runs = []
    for cell in sorted(counts, key=lambda c: (_hash(f"cell {c}"), c)):  # arrival order: no part of the ring is favoured
        rank, left = 0, counts[cell]
        for shard in ring.order(cell):
            take = min(left, room[shard] - used[shard])
            if take > 0:
                runs.append((cell, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank, left = rank + take, left - take
            if not left:
                break
    return runs


RUNS = T.StructType(
    [
        T.StructField("_cell", T.IntegerType()),
        T.StructField("_from", T.LongType()),
        T.StructField("_end", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("_slot", T.LongType()),
    ]
)


def assign_shards(
    df: DataFrame, key: str, carry: list[str], n_shards: int, vnodes: int = 64, load_factor: float = 1.0
) -> DataFrame:
    """Columns ``key`` and ``carry`` of every row with its ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    names = [key, *carry]
    inner = [f"_c{i}" for i in range(len(names))]
    rows = only(df, *names).toDF(*inner)
    ring_hash = F.when(F.col("_c0").isNull(), F.xxhash64(F.lit("no key"), *inner[1:])).otherwise(F.xxhash64("_c0"))
    cell = F.shiftrightunsigned(ring_hash, 64 - CELL_BITS).cast("int")
    counted = stored(rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", cell), "ring-rows")

    counts = {r["_cell"]: r["n"] for r in counted.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}
    spark = df.sparkSession
    runs = F.broadcast(spark.createDataFrame(fill(counts, n_shards, vnodes, load_factor), RUNS))  # at most 2**16 + shards

    before = Window.partitionBy("_cell").orderBy(F.xxhash64(*inner), *inner).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = (
        ranked.join(runs, "_cell")
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") + F.col("_n") > F.col("_from")))
        .withColumn("_lo", F.greatest("_rank", "_from"))
        .withColumn("_hi", F.least(F.col("_rank") + F.col("_n"), "_end"))
        .withColumn("_first", F.col("_slot") + F.col("_lo") - F.col("_from"))
        .withColumn("_many", F.col("_hi") - F.col("_lo"))
        .select(*inner, "shard", "_first", "_many")
    )
    cut = stored(cut, "ring-runs")
    single = cut.where("_many = 1").select(*inner, "shard", F.col("_first").alias("slot"))
    pieces = cut.where("_many > 1").withColumn("_at", F.explode(F.expr(f"sequence(0L, _many - 1, {PIECE}L)")))
    repeated = pieces.repartition("shard", "_first", "_at").select(
        *inner,
        "shard",
        F.explode(F.expr(f"sequence(_first + _at, _first + least(_at + {PIECE}L, _many) - 1)")).alias("slot"),
    )
    return single.unionByName(repeated).toDF(*names, "shard", "slot")
