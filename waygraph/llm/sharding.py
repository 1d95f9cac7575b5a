"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws
-ln(u) / weight, u being a hash of the row's key and the child; the least draw
wins, so that a child's share follows its weight.  Shards added later keep the
draws of the tree as it was: each added shard makes one draw of its own weight,
the same at all levels.  Where it beats the least draw of a level, the path leads
to it; else the path stays as before.  So only the added shard takes rows, and
only subtrees whose weight changed see movement.

Defined results: a null text has no bytes; a null key is a key of its own;
repeated rows go to one shard and get slots of their own; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waygraph.llm.common import materialize, table

#: Rows of one slot bucket, which one task numbers.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class ShardTree:
    """regions[r][k] has the weights of the shards in rack k of region r; added has the weights of shards that came later."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[float, ...] = field(default=())

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> ShardTree:
        return ShardTree(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    @property
    def n_base(self) -> int:
        return sum(len(k) for r in self.regions for k in r)

    def grow(self, weight: float = 1.0) -> ShardTree:
        return ShardTree(self.regions, (*self.added, weight))


def _draw(key: Column, child: Column, weight: Column) -> Column:
    unit = (F.pmod(F.xxhash64(key, child), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(unit) / weight


def _best(key: Column, level: int, parent: Column, weights: list[list[float]]) -> Column:
    """struct(draw, child) of the least draw among the parent's children; weights by parent."""
    width = max(len(w) for w in weights)
    grid = F.array(*(F.array(*(F.lit(float(x)) for x in [*w, *[0.0] * (width - len(w))])) for w in weights))
    draws = []
    for c in range(width):
        weight = F.element_at(F.element_at(grid, parent + 1), F.lit(c + 1))
        child = F.lit(level * 1_000_003) + parent * 1_009 + F.lit(c)
        draws.append(F.when(weight > 0, F.struct(_draw(key, child, weight).alias("draw"), F.lit(c).alias("child"))))
    return F.least(*draws) if len(draws) > 1 else draws[0]


def assign(rows: DataFrame, key: Column, tree: ShardTree, out: str, path: bool = False) -> DataFrame:
    """rows with column out: the shard; with path also region and rack (null for added shards)."""
    racks = [[sum(k) for k in r] for r in tree.regions]
    leaves = [list(k) for r in tree.regions for k in r]
    first_rack, first_leaf, n = [], [], 0
    for r in racks:
        first_rack.append(n)
        n += len(r)
    n = 0
    for k in leaves:
        first_leaf.append(n)
        n += len(k)
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    got = rows.withColumn("__region", _best(key, 1, F.lit(0), [[sum(r) for r in racks]]))
    got = got.withColumn("__rack", _best(key, 2, F.col("__region.child"), racks))
    got = got.withColumn("__k", at(first_rack, F.col("__region.child")) + F.col("__rack.child"))
    got = got.withColumn("__leaf", _best(key, 3, F.col("__k"), leaves))
    shard, least = at(first_leaf, F.col("__k")) + F.col("__leaf.child"), F.col("__region.draw")
    for i, weight in enumerate(tree.added):
        draw = _draw(key, F.lit(9_000_000_007 + i), F.lit(float(weight)))
        shard, least = F.when(draw < least, F.lit(n + i)).otherwise(shard), F.least(draw, least)
    got = got.withColumn(out, shard.cast("int"))
    if path:
        base = F.col(out) < n
        got = got.withColumn("region", F.when(base, F.col("__region.child"))).withColumn("rack", F.when(base, F.col("__k")))
    return got.drop("__region", "__rack", "__k", "__leaf")


def with_slots(rows: DataFrame, shard: str, order: list[str], n_shards: int) -> DataFrame:
    """rows with slot: gapless from 0 in each shard. Rows are numbered in hash buckets; a bucket starts where those before it end.

    A row's place in what is written here parts equal rows, however many there are.
    """
    rows = materialize(rows.withColumn("__place", F.monotonically_increasing_id()), "shards")
    n = rows.count()
    buckets = max(1, -(-n // (n_shards * BUCKET_ROWS)))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*order, "__place"), F.lit(buckets)))
    sizes = rows.groupBy(shard, "__b").count()
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("__s"), F.col("__b").alias("__sb"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(shard, "__b").orderBy(*order, "__place")))
    joined = numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col("__b") == F.col("__sb")))
    return joined.withColumn("slot", F.col("__start") + F.col("__n") - 1).drop("__place", "__b", "__n", "__s", "__sb", "__start")


#: 5 regions of 2 racks of 4 shards.
TREE = ShardTree.even(5, 2, 4)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(rows, F.col("doc_id"), TREE, "shard", path=True)
    rows = assign(rows, F.col("doc_id"), TREE.grow(), "grown_shard")
    return with_slots(rows, "shard", ["doc_id", "text_crc32"], TREE.n_base)
