"""Correlations of all pairs of tickers by sums of products: over a whole history in tiles, and over a window that moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import written

#: Tickers of a tile's side, and calendar days of a chunk of history. A task holds a tile's chunk, however many tickers or years there are.
TILE, CHUNK_DAYS = 256, 1024
#: A variance of less than this share of the squares is that of a flat series.
FLAT = 1e-12
#: Sums that have shrunk to this share of what they have been are made anew, as what is left of their digits isn't enough.
WORN = 1e-9


class Sums:
    """Of two blocks of columns, for each pair of columns, over the rows where both have a value: their number, and the sums of x, y, xx, yy and xy.

    Columns are centred near their means first (by the caller); rows come and go one by one.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        m, k, a, b = self._split(x, y)
        self.all = [m.T @ k, a.T @ k, m.T @ b, (a * a).T @ k, m.T @ (b * b), a.T @ b]
        self.peak = np.maximum(self.all[3], self.all[4])

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        return m, k, np.nan_to_num(x), np.nan_to_num(y)

    def moved(self, new: tuple[np.ndarray, np.ndarray], old: tuple[np.ndarray, np.ndarray]) -> None:
        """A row comes and a row goes: a product of rank two for each sum."""
        m, k, a, b = self._split(np.stack([new[0], old[0]]), np.stack([new[1], old[1]]))
        sign = np.array([[1.0], [-1.0]])
        for total, left, right in zip(self.all, (m, a, m, a * a, m, a), (k, k, b, k, b * b, b), strict=True):
            total += (left * sign).T @ right
        np.maximum(self.peak, np.maximum(self.all[3], self.all[4]), out=self.peak)

    def worn(self, least: int) -> bool:
        n, _, _, _, _, _ = self.all
        vx, vy = self._variances()
        return bool(((n >= least) & (np.minimum(vx, vy) < WORN * self.peak)).any())

    def _variances(self) -> tuple[np.ndarray, np.ndarray]:
        n, sx, sy, sxx, syy, _ = self.all
        with np.errstate(divide="ignore", invalid="ignore"):
            return sxx - sx * sx / n, syy - sy * sy / n

    def correlations(self, least: int) -> np.ndarray:
        """NaN for pairs with fewer than ``least`` common rows, and with a flat column."""
        n, sx, sy, sxx, syy, sxy = self.all
        vx, vy = self._variances()
        with np.errstate(divide="ignore", invalid="ignore"):
            rho = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        return np.where((n >= max(least, 1)) & (vx > FLAT * sxx) & (vy > FLAT * syy), rho, np.nan)


def centred(x: np.ndarray) -> np.ndarray:
    there = ~np.isnan(x)
    return x - np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)


def tiles(columns: int, side: int = TILE) -> Iterator[tuple[slice, slice]]:
    """The blocks of columns that hold every pair once; a block with itself holds its pairs twice."""
    for p in range(0, columns, side):
        for q in range(p, columns, side):
            yield slice(p, p + side), slice(q, q + side)


def upper(values: np.ndarray, p: slice, q: slice) -> np.ndarray:
    """A tile's pairs, each once."""
    return values[np.triu_indices(len(values), 1)] if p == q else values.ravel()


def pair_values(x: np.ndarray, least: int, block: int = TILE) -> np.ndarray:
    """The correlations of all pairs of columns over the rows where both have a value, from ``least`` such rows on; flat pairs have none."""
    c = centred(x)
    found = [upper(Sums(c[:, p], c[:, q]).correlations(least), p, q) for p, q in tiles(x.shape[1], block)]
    every = np.concatenate(found) if found else np.empty(0)
    return every[~np.isnan(every)]


class Moving:
    """The sums of all pairs over a window of rows, which moves on by a row."""

    def __init__(self, x: np.ndarray, window: int, side: int = TILE):
        self.x, self.window, self.at = centred(x), window, -1
        self.tiles = list(tiles(x.shape[1], side))

    def _rows(self, end: int) -> np.ndarray:
        return self.x[end - self.window + 1 : end + 1]

    def correlations(self, end: int, least: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """The tiles' correlations over the window that ends with a row. After the row before, sums are changed; else they are made anew."""
        own = self._rows(end)
        if end != self.at + 1 or self.at < 0:
            self.sums = [Sums(own[:, p], own[:, q]) for p, q in self.tiles]
        else:
            new, old = self.x[end], self.x[end - self.window]
            for s, (p, q) in zip(self.sums, self.tiles, strict=True):
                s.moved((new[p], new[q]), (old[p], old[q]))
        self.at = end
        for i, (p, q) in enumerate(self.tiles):
            if self.sums[i].worn(least):
                self.sums[i] = Sums(own[:, p], own[:, q])
            yield p, q, self.sums[i].correlations(least)


def _chunk_sums(side: int):
    def run(part: pa.Table) -> pa.Table:
        frame = part.to_pandas()
        p, q, chunk = (int(frame[c].iloc[0]) for c in ("p", "q", "chunk"))
        place = pd.factorize(frame["date"])[0]
        both = []
        for block in (p, q):
            own = (frame["i"] // side == block).to_numpy()
            x = np.full((place.max() + 1, side), np.nan)
            x[place[own], frame["i"].to_numpy()[own] - block * side] = frame["v"].to_numpy()[own]
            both.append(x)
        sums = np.stack(Sums(*both).all)
        return pa.table(
            {
                "p": pa.array([p], pa.int32()),
                "q": pa.array([q], pa.int32()),
                "chunk": pa.array([chunk], pa.int32()),
                "sums": pa.array([sums.tobytes()], pa.binary()),
            }
        )

    return run


def _tile_pairs(side: int, least: int):
    def run(part: pa.Table) -> pa.Table:
        p, q = part["p"][0].as_py(), part["q"][0].as_py()
        order = np.argsort(part["chunk"].to_numpy())
        total = Sums(np.empty((0, side)), np.empty((0, side)))
        sums = part["sums"].combine_chunks()
        for k in order:
            for own, more in zip(total.all, np.frombuffer(sums[int(k)].as_py()).reshape(6, side, side), strict=True):
                own += more
        n, rho = total.all[0], total.correlations(least)
        i, j = np.nonzero((n > 0) & (np.arange(side)[:, None] < np.arange(side)[None, :] if p == q else True))
        value = rho[i, j]
        columns = [
            pa.array(i + p * side, pa.int32()),
            pa.array(j + q * side, pa.int32()),
            pa.array(n[i, j].astype(np.int64)),
            pa.array(value, mask=np.isnan(value)),
        ]
        return pa.Table.from_arrays(columns, ["i", "j", "n", "rho"])

    return run


def correlation(returns: DataFrame, value: str = "ret", least: int = 30) -> DataFrame:
    """a, b, n, rho over all dates on which both have a value (a < b, one date at least); rho is null for fewer than ``least`` and for a flat ticker.

    Tickers are dealt into blocks, dates into chunks. A tile is two blocks; its sums of products are made a chunk a task and added
    up by tile, so no row is made for a pair and a date, and a task's rows are bounded by the tile's side and the chunk. What is shuffled are the
    values, once for each block that theirs meets, and six numbers for each pair and chunk.
    """
    own = returns.where(F.col(value).isNotNull()).select("ticker", "date", F.col(value).cast("double").alias("v"))
    # a row a ticker, numbered by name
    names = written(
        own.groupBy("ticker").agg(F.avg("v").alias("mean")).withColumn(
            "i", F.row_number().over(Window.orderBy("ticker")) - 1
        ),
        "tickers",
    )
    n = names.count()
    side = max(1, min(TILE, n))
    blocks = -(-n // side)
    rows = own.join(names, "ticker").select(
        "date",
        "i",
        (F.col("v") - F.col("mean")).alias("v"),
        F.floor(F.unix_date("date") / CHUNK_DAYS).cast("int").alias("chunk"),
    )
    block = F.floor(F.col("i") / side).cast("int")
    met = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))),
            lambda o: F.struct(F.least(block, o).alias("p"), F.greatest(block, o).alias("q")),
        )
    )
    dealt = rows.withColumn("tile", met).select("date", "i", "v", "chunk", "tile.p", "tile.q")
    sums = dealt.groupBy("chunk", "p", "q").applyInArrow(_chunk_sums(side), "p int, q int, chunk int, sums binary")
    found = sums.groupBy("p", "q").applyInArrow(_tile_pairs(side, least), "i int, j int, n long, rho double")
    first, second = names.select("i", F.col("ticker").alias("a")), names.select(
        F.col("i").alias("j"), F.col("ticker").alias("b")
    )
    return found.join(first, "i").join(second, "j").select("a", "b", "n", "rho")
