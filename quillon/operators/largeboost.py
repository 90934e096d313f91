"""Boosted trees for tables of any size: values are dealt into bins by quantiles, and the gradients of each bin are added up over the executors.

A level of a tree is one pass over the binned rows. A task sends a histogram for each open node, whatever its number of rows; these are added up by
node, and the driver, which gets nothing else, takes the best splits. Where a column has no more values than bins, splits are those of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.boosting import BoostedTrees, Node
from quillon.scratch import dropped, written

#: Bins of a column, and trees between two writings of the rows' scores.
BINS, TREES_A_WRITE = 256, 10


@dataclass
class Bins:
    """A column's bin values, in order: a value belongs to the first that isn't below it. ``whole``: they are all of its values."""

    values: np.ndarray
    whole: bool

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.values, x, side="left"), len(self.values) - 1).astype(np.uint8)

    def cut(self, low: int, high: int) -> float:
        """What parts bin ``low`` from the next that has rows: a value below it goes left."""
        return float(self.values[low] + self.values[high]) / 2 if self.whole else float(
            np.nextafter(self.values[low], np.inf)
        )


def bins(rows: DataFrame, columns: list[str]) -> list[Bins]:
    """Each column's bins: all values of a column with few, else quantiles. Two passes; the driver gets some BINS values a column."""
    guess = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    few = [c for c in columns if guess[c] <= BINS * 0.9]
    shares = [i / (BINS - 1) for i in range(BINS - 1)] + [1.0]
    asked = [
        F.collect_set(c).alias(c) if c in few else F.percentile_approx(c, shares, 20 * BINS).alias(c) for c in columns
    ]
    found = rows.agg(*asked).first()
    return [
        Bins(np.unique(np.array(found[c] or [0.0], float))[:BINS], c in few and len(found[c]) <= BINS) for c in columns
    ]


@dataclass
class _Tree:
    """A tree over bins as arrays: a node's column (-1: a leaf), the last bin that goes left, its branches and weight."""

    column: list[int]
    last: list[int]
    left: list[int]
    right: list[int]
    weight: list[float]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins comes to."""
        column, last, left, right = (np.array(a) for a in (self.column, self.last, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (go := column[at] >= 0).any():
            rows = np.flatnonzero(go)
            node = at[rows]
            at[rows] = np.where(x[rows, column[node]] <= last[node], left[node], right[node])
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.weight)[self.leaves(x)]


def _uniform(ids: np.ndarray, key: int) -> np.ndarray:
    """A number in [0, 1) for each id, by a key."""
    x = ids.astype(np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _binned(found: list[Bins], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([b.of(batch.column(c).to_numpy()) for b, c in zip(found, names, strict=True)])
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("target"), rows, pa.array(np.zeros(len(x)))],
                ["id", "target", "bins", "score"],
            )

    return run


def _scored(trees: list[_Tree], rate: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            score = batch.column("score").to_numpy() + rate * sum((t.scores(x) for t in trees), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("target"), batch.column("bins"), pa.array(score)],
                ["id", "target", "bins", "score"],
            )

    return run


def _histograms(trees: list[_Tree], tree: _Tree, open_: list[int], model: BoostedTrees, number: int, width: int):
    """For each open node: by column and bin, the sums of gradients and curvatures and the number of rows."""
    place = {n: i for i, n in enumerate(open_)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_), width, BINS, 3))
        for batch in batches:
            y, x = batch.column("target").to_numpy(), _matrix(batch, width)
            score = batch.column("score").to_numpy() + model.rate * sum((t.scores(x) for t in trees), np.zeros(len(x)))
            p, weight = 1 / (1 + np.exp(-score)), np.where(y > 0, model.positive, 1.0)
            sampled = _uniform(batch.column("id").to_numpy(), model.seed * 1_000_003 + number) < model.rows
            leaf = tree.leaves(x)
            for node, i in place.items():
                own = np.flatnonzero(sampled & (leaf == node))
                g, h = (weight * (p - y))[own], (weight * p * (1 - p))[own]
                for j in range(width):
                    b = x[own, j]
                    for k, values in enumerate((g, h, None)):
                        total[i, j, :, k] += np.bincount(b, values, BINS)
        used = [i for i in range(len(open_)) if total[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([open_[i] for i in used], pa.int32()), pa.array([total[i].tobytes() for i in used], pa.binary())],
            ["node", "sums"],
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for node, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[node] = total.get(node, 0.0) + np.frombuffer(sums.as_py())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
        ["node", "sums"],
    )


def _best(model: BoostedTrees, sums: np.ndarray, found: list[Bins], picked: np.ndarray) -> tuple | None:
    """gain, column, last bin that goes left, cut, and the sums of both sides, of the best split; None if none gains."""
    g, h = sums[0, :, 0].sum(), sums[0, :, 1].sum()
    best, out = 0.0, None
    for j in picked:
        used = np.flatnonzero(sums[j, :, 2] > 0)
        if len(used) < 2:
            continue
        left_g, left_h = np.cumsum(sums[j, used, 0])[:-1], np.cumsum(sums[j, used, 1])[:-1]
        gain = (
            model.worth(left_g, left_h) + model.worth(g - left_g, h - left_h) - model.worth(np.array(g), np.array(h))
        ) / 2
        gain = np.where((left_h >= model.least_weight) & (h - left_h >= model.least_weight), gain, 0.0)
        if gain[at := int(gain.argmax())] > best + 1e-12:
            best = float(gain[at])
            out = best, int(j), int(used[at]), found[j].cut(used[at], used[at + 1]), (left_g[at], left_h[at]), (
                g - left_g[at], h - left_h[at]
            )
    return out


def fit_large(rows: DataFrame, columns: list[str], target: str, model: BoostedTrees | None = None) -> BoostedTrees:
    """The model, fitted on all rows whose columns are finite numbers and whose target (0 or 1) isn't null.

    Its parameters are those of ``BoostedTrees``. Rows of a tree are drawn by a hash of their place, so a task that runs again draws the same. The driver
    holds the bins, the trees and one level's histograms. Without rows: no trees.
    """
    model = model or BoostedTrees()
    names = [f"c{i}" for i in range(len(columns))]
    kept = rows.select(
        *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)],
        F.col(target).cast("double").alias("target"),
    ).where("target is not null")
    for n in names:
        kept = kept.where(F.abs(F.col(n)) < float("inf"))
    kept = written(kept.withColumn("id", F.monotonically_increasing_id()), "training")
    width, rng = len(columns), np.random.default_rng(model.seed)
    model.grown, model.gain, model.uses = [], np.zeros(width), np.zeros(width)
    if not kept.limit(1).count():
        return model
    found = bins(kept, names)
    kinds = "id long, target double, bins binary, score double"
    table = written(kept.mapInArrow(_binned(found, names), kinds), "binned")
    dropped(kept)
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending: list[_Tree] = []
    for number in range(model.trees):
        picked = np.sort(rng.choice(width, max(1, round(model.columns * width)), replace=False))
        tree, nodes, open_ = _Tree([-1], [0], [0], [0], [0.0]), [Node(0.0)], [0]
        for depth in range(model.depth):
            made = table.mapInArrow(_histograms(pending, tree, open_, model, number, width), "node int, sums binary")
            sums = {
                r.node: np.frombuffer(r.sums).reshape(width, BINS, 3)
                for r in made.repartition(min(spread, len(open_)), "node").mapInArrow(
                    _added, "node int, sums binary"
                ).collect()
            }
            following = []
            for n in open_:
                if n not in sums:
                    continue
                if depth == 0:
                    nodes[n].weight = tree.weight[n] = model.leaf(sums[n][0, :, 0].sum(), sums[n][0, :, 1].sum())
                split = _best(model, sums[n], found, picked) if sums[n][0, :, 2].sum() >= 2 else None
                if split is None:
                    continue
                gain, j, last, cut, low, high = split
                model.gain[j] += gain
                model.uses[j] += 1
                nodes[n].feature, nodes[n].cut = j, cut
                tree.column[n], tree.last[n] = j, last
                for side, (g, h) in (("left", low), ("right", high)):
                    child = Node(float(model.leaf(g, h)))
                    getattr(tree, side)[n] = len(nodes)
                    following.append(len(nodes))
                    setattr(nodes[n], side, child)
                    nodes.append(child)
                    for a, v in (
                        (tree.column, -1), (tree.last, 0), (tree.left, 0), (tree.right, 0), (tree.weight, child.weight)
                    ):
                        a.append(v)
            open_ = following
            if not open_:
                break
        model.grown.append(nodes[0])
        pending.append(tree)
        if len(pending) == TREES_A_WRITE and number + 1 < model.trees:
            again = written(table.mapInArrow(_scored(pending, model.rate, width), kinds), "binned")
            dropped(table)
            table, pending = again, []
    dropped(table)
    return model
