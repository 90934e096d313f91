"""Sharding by a weighted hash tree: region, then rack, then shard.

At each level a key draws once for each child of where it stands, an exponential waiting time at the child's weight, and descends to
the least. A child's weight is that of all shards below it. A draw depends on the key and the child alone. So where a weight changes, the
draws of all other children stay: a key moves only into or out of a subtree whose weight has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, parts

RACKS, SHARDS = 2, 4  # racks of a region, shards of a rack

Tree = list[list[list[int]]]


def layout(n: int, racks: int = RACKS, shards: int = SHARDS) -> Tree:
    """The tree of n shards, filled in order: regions of racks of shards."""
    if n < 1:
        raise ValueError("at least one shard")
    rack = [list(range(a, min(a + shards, n))) for a in range(0, n, shards)]
    return [rack[a : a + racks] for a in range(0, len(rack), racks)]


def _draw(key: Column, level: str, child: Column, weight: Column) -> Column:
    """A key's waiting time for a child of a level: exponential, at a rate that is the child's weight."""
    u = (F.shiftrightunsigned(F.xxhash64(F.concat_ws("/", key, F.lit(level), child.cast("string"))), 11).cast("double") + 1.0) / float(1 << 53)
    return -F.ln(u) / weight


def _children(level: list[list[tuple[int, float]]]) -> Column:
    """As a constant: for each node of the level above, its children's numbers and weights."""
    return F.array(*[F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in own]) for own in level])


def _descended(key: Column, level: str, children: Column) -> Column:
    """draw and child of the least draw; a tie goes to the smaller number."""
    draws = F.transform(children, lambda c: F.struct(_draw(key, level, c["child"], c["weight"]).alias("draw"), c["child"].alias("child")))
    return F.array_min(draws)


def descend(key: Column, tree: Tree, weights: list[float]) -> Column:
    """Where a key comes to: draw (its region's) and shard. The expression has one step a level, however many shards there are."""
    racks = [rack for region in tree for rack in region]
    number = iter(range(len(racks)))
    of_region = [[(next(number), sum(weights[s] for s in rack)) for rack in region] for region in tree]
    top = [[(i, sum(w for _, w in own)) for i, own in enumerate(of_region)]]
    of_rack = [[(s, weights[s]) for s in rack] for rack in racks]
    region = F.array(_descended(key, "region", _children(top)[0]))

    def below(r: Column) -> Column:
        rack = F.array(_descended(key, "rack", F.get(_children(of_region), r["child"])))
        shard = F.transform(rack, lambda k: _descended(key, "shard", F.get(_children(of_rack), k["child"]))["child"])[0]
        return F.struct(r["draw"].alias("draw"), shard.alias("shard"))

    # each level's draws are made once: a lambda's variable holds them
    return F.transform(region, below)[0]


def place(key: Column, n: int, weights: list[float] | None = None) -> Column:
    """The shard of a key."""
    return descend(key, layout(n), weights or [1.0] * n)["shard"]


def assign(docs: DataFrame, n: int, weights: list[float] | None = None, id_col: str = "doc_id", added: float = 1.0) -> DataFrame:
    """docs with shard and grown_shard (with one shard more, of weight ``added``), by the id alone; no shuffle.

    A shard that comes to a tree is a region of its own: so only the new region's draw is new, and rows move only into the new shard.
    Null ids share one shard. Repeated ids are together. Columns of these names in docs are replaced. Texts aren't read, so their length
    doesn't matter. Empty table: no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    (found,) = fresh(docs, "found")
    tree = layout(n)
    new = _draw(key, "region", F.lit(len(tree)), F.lit(float(added)))
    out = docs.withColumn(found, descend(key, tree, weights or [1.0] * n))
    shard = F.col(f"{found}.shard")
    return out.withColumns({"shard": shard, "grown_shard": F.when(new < F.col(f"{found}.draw"), F.lit(n)).otherwise(shard)}).drop(found)


def numbered(sharded: DataFrame, order: list[str]) -> DataFrame:
    """With slot: each shard's rows from 0 without gaps.

    A shard is dealt into lanes by a hash of ``order``; a row's slot is its place in its lane after the rows of the lanes before.
    So no task holds a shard. Rows equal in all of ``order`` are interchangeable and share a lane. A column slot is replaced, all others stay.
    """
    lanes = max(16, parts(sharded.sparkSession))
    sharded = sharded.drop("slot")
    lane, inside, before = fresh(sharded, "lane", "inside", "before")
    dealt = sharded.withColumn(lane, F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("int"))
    counts = dealt.groupBy("shard", lane).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", lane, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    row = F.row_number().over(Window.partitionBy("shard", lane).orderBy(*order)) - 1
    both = dealt.withColumn(inside, row).join(offsets, ["shard", lane])
    return both.withColumn("slot", (F.col(before) + F.col(inside)).cast("long")).select(*sharded.columns, "slot")
