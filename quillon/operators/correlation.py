"""Correlation of tickers: pairs, rolling mean and median, residuals, clusters, principal component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rolling import ratio
from quillon.operators.graph import components
from quillon.operators.pairs import Moving, correlation, pair_values, upper
from quillon.scratch import dropped, written

__all__ = [
    "average_linkage",
    "clusters",
    "correlation",
    "distance",
    "pair_values",
    "residualize",
    "rolling_mean",
    "rolling_median",
    "rolling_pca",
]


def distance(rho_pairs: DataFrame) -> DataFrame:
    """With distance = sqrt(2 (1 - rho)); no correlation counts as -1."""
    rho = F.coalesce("rho", F.lit(-1.0))
    return rho_pairs.withColumn("distance", F.sqrt(F.greatest(2 * (1 - F.least(rho, F.lit(1.0))), F.lit(0.0))))


def _chunked(returns: DataFrame, window: int, value: str) -> DataFrame:
    """ticker, date, v, k (the date's number), chunk: dates dealt into chunks of a window, each with the window before it."""
    days = returns.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)
    # a row a date: the calendar, whatever the number of tickers
    rows = returns.select("ticker", "date", F.col(value).alias("v")).join(F.broadcast(days), "date")
    chunks = F.sequence(F.floor(F.col("k") / window), F.floor((F.col("k") + window - 1) / window))
    return rows.withColumn("chunk", F.explode(chunks))


def _windows(part: pd.DataFrame, window: int) -> Iterator[tuple[object, pd.DataFrame]]:
    """Each of a chunk's dates that a full window ends with, and the window: dates by tickers."""
    wide = part.pivot(index="k", columns="ticker", values="v").sort_index()
    date = part.drop_duplicates("k").set_index("k")["date"]
    first = int(part["chunk"].iloc[0]) * window
    for k in wide.index[(wide.index >= first) & (wide.index < first + window) & (wide.index >= window - 1)]:
        yield date[k], wide.loc[k - window + 1 : k]


def _ends(part: pd.DataFrame, window: int) -> tuple[np.ndarray, list[tuple[object, int]]]:
    """A chunk's values, dates by tickers, and each of its dates that a full window ends with, with its row."""
    wide = part.pivot(index="k", columns="ticker", values="v").sort_index()
    date = part.drop_duplicates("k").set_index("k")["date"]
    first = int(part["chunk"].iloc[0]) * window
    return wide.to_numpy(float), [
        (date[k], at) for at, k in enumerate(wide.index) if first <= k < first + window and k >= window - 1
    ]


def rolling_mean(returns: DataFrame, window: int = 60) -> DataFrame:
    """date, average_pairwise_correlation: over tickers with half a window of values, once a window is full. Only the mean leaves a task.

    A chunk's task makes the sums of products of its first window and changes them by the row that comes and the one that goes, so a date costs
    a number for each pair, whatever the window. It holds six numbers for each pair.
    """

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        x, ends = _ends(part, window)
        moving, out = Moving(x, window), []
        for date, at in ends:
            kept = (~np.isnan(x[at - window + 1 : at + 1])).sum(axis=0) >= window // 2
            total, n = 0.0, 0
            for p, q, rho in moving.correlations(at, 2):
                values = upper(np.where(kept[p][:, None] & kept[q][None, :], rho, np.nan), p, q)
                values = values[~np.isnan(values)]
                total, n = total + float(values.sum()), n + len(values)
            if kept.sum() > 1:
                out.append((date, total / n if n else None))
        return pd.DataFrame(out, columns=["date", "average_pairwise_correlation"])

    return _chunked(returns, window, "ret").groupBy("chunk").applyInPandas(
        mean, "date date, average_pairwise_correlation double"
    )


def rolling_median(returns: DataFrame, window: int = 60) -> DataFrame:
    """date, median_pairwise_correlation: over pairs with max(10, half a window) common values, once a window is full. Only the median leaves a task.

    Sums are kept and changed as in ``rolling_mean``.
    """

    def median(part: pd.DataFrame) -> pd.DataFrame:
        x, ends = _ends(part, window)
        moving, out = Moving(x, window), []
        for date, at in ends:
            values = [upper(rho, p, q) for p, q, rho in moving.correlations(at, max(10, window // 2))]
            every = np.concatenate(values)
            every = every[~np.isnan(every)]
            if x.shape[1] > 1:
                out.append((date, float(np.median(every)) if len(every) else None))
        return pd.DataFrame(out, columns=["date", "median_pairwise_correlation"])

    return _chunked(returns, window, "ret").groupBy("chunk").applyInPandas(
        median, "date date, median_pairwise_correlation double"
    )


def residualize(returns: DataFrame, factor: DataFrame, value: str = "log_ret", least: int = 30) -> DataFrame:
    """returns with resid: what a line on factor (date, f) over all common dates leaves; as it is for fewer than ``least`` dates or a flat factor."""
    both = returns.join(F.broadcast(factor), "date", "left")
    used = F.col(value).isNotNull() & F.col("f").isNotNull()
    x, y = F.when(used, F.col("f")), F.when(used, F.col(value))
    fit = both.groupBy("ticker").agg(
        F.count(x).alias("n"),
        F.covar_pop(x, y).alias("c"),
        F.var_pop(x).alias("v"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
    )
    fitted = both.join(fit, "ticker").withColumn("slope", ratio(F.col("c"), F.col("v")))
    line = F.col("my") + F.col("slope") * (F.col("f") - F.col("mx"))
    return fitted.withColumn(
        "resid", F.when((F.col("n") < least) | F.col("slope").isNull(), F.col(value)).otherwise(F.col(value) - line)
    ).drop("n", "c", "v", "mx", "my", "slope")


def average_linkage(names: list[str], dist: np.ndarray, cut: float) -> list[list[str]]:
    """Groups of average linkage that merge at or below the cut, by chains of nearest neighbours: quadratic in the names.

    A chain goes from a group to its nearest, and on, until two are each other's nearest; these merge. What merges elsewhere never brings a group
    nearer than its nearest was, so a group whose nearest is beyond the cut is finished.
    """
    n = len(names)
    groups: list[list[int]] = [[i] for i in range(n)]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    open_, chain = np.ones(n, bool), []
    while open_.any():
        if not chain:
            chain.append(int(np.argmax(open_)))
        x = chain[-1]
        y = int(np.argmin(d[x]))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
        if not d[x, y] <= cut:
            open_[x] = False
            d[x], d[:, x] = np.inf, np.inf
            chain.pop()
        elif len(chain) > 1 and y == chain[-2]:
            del chain[-2:]
            a, b = len(groups[x]), len(groups[y])
            row = (a * d[x] + b * d[y]) / (a + b)
            d[x], d[:, x] = row, row
            d[x, x] = np.inf
            d[y], d[:, y] = np.inf, np.inf
            open_[y] = False
            groups[x], groups[y] = groups[x] + groups[y], []
        else:
            chain.append(y)
    return sorted(sorted(names[k] for k in g) for g in groups if g)


def clusters(rho_pairs: DataFrame, threshold: float = 0.60, least: int = 3) -> DataFrame:
    """cluster, ticker, mean_correlation: groups of average linkage of ``least`` tickers whose mean correlation reaches the threshold.

    Groups that merge at or below the cut have a pair at or below it, so no merge leaves a connected component of such pairs: components are
    found first, and each is linked by a task of its own, which takes the pairs within it. A component of all tickers is the worst case: a
    number for each pair in one task. Clusters are numbered by their first tickers.
    """
    cut = float(np.sqrt(2 * (1 - threshold)))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(sorted(set(rows["a"]) | set(rows["b"])))
        rho = np.full((len(names), len(names)), np.nan)
        i, j = names.get_indexer(rows["a"]), names.get_indexer(rows["b"])
        rho[i, j] = rho[j, i] = rows["rho"].to_numpy(float)
        dist = np.sqrt(np.maximum(2 * (1 - np.where(np.isnan(rho), -1, rho)), 0))
        out = []
        for group in average_linkage(list(names), dist, cut):
            own = names.get_indexer(group)
            values = rho[np.ix_(own, own)][np.triu_indices(len(own), 1)]
            if len(group) < least or not np.isfinite(values).any() or np.nanmean(values) < threshold:
                continue
            out += [(group[0], t, float(np.nanmean(values))) for t in group]
        return pd.DataFrame(out, columns=["first", "ticker", "mean_correlation"])

    every = written(distance(rho_pairs), "pairs")
    found = components(every.where(F.col("distance") <= cut).select("a", "b"))
    inside = every.join(found.select(F.col("node").alias("a"), "component"), "a").join(
        found.select(F.col("node").alias("b"), "component"), ["b", "component"]
    )
    linked = written(
        inside.groupBy("component").applyInPandas(link, "first string, ticker string, mean_correlation double"),
        "linked",
    )
    # a row a cluster
    numbered = linked.select("first").distinct().withColumn(
        "cluster", (F.row_number().over(Window.orderBy("first")) - 1).cast("int")
    )
    dropped(every, found)
    return linked.join(numbered, "first").select("cluster", "ticker", "mean_correlation")


def rolling_pca(returns: DataFrame, window: int, value: str = "ret", complete: bool = False) -> DataFrame:
    """date, pca_factor, pca_explained_variance: of the first principal component of the last ``window`` dates' standardised values.

    Tickers with under 0.8 of the window are left out. With ``complete``, rows with a gap go, three tickers and half a window are
    needed, and the sign is that of the mean return; else gaps are filled by the mean, and loadings sum up to a positive number.
    Dates are dealt into chunks, and each chunk gets the window before it, so chunks are worked on at once.
    """
    def one(x: pd.DataFrame) -> tuple[float, float] | None:
        x = x.loc[:, x.notna().sum() >= (max(20, int(0.8 * window)) if complete else int(0.8 * window))]
        x = x.dropna() if complete else x.fillna(x.mean())
        x = x.loc[:, x.std(ddof=0) > 0]
        if x.shape[1] < (3 if complete else 2) or complete and len(x) < max(20, window // 2):
            return None
        z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
        # of the two matrices that have the same values, the smaller: dates by dates, or tickers by tickers
        wide = z.shape[1] > z.shape[0]
        values, vectors = np.linalg.eigh(z @ z.T if wide else z.T @ z)
        loading = z.T @ vectors[:, -1] / np.sqrt(max(values[-1], 1e-300)) if wide else vectors[:, -1]
        score = z @ loading
        sign = np.corrcoef(score, x.mean(axis=1))[0, 1] if complete else loading.sum()
        return (score[-1] if sign >= 0 else -score[-1]), values[-1] / values.sum()

    def component(part: pd.DataFrame) -> pd.DataFrame:
        found = [(date, one(x)) for date, x in _windows(part, window)]
        return pd.DataFrame(
            [(date, *f) for date, f in found if f is not None], columns=["date", "pca_factor", "pca_explained_variance"]
        )

    return _chunked(returns, window, value).groupBy("chunk").applyInPandas(
        component, "date date, pca_factor double, pca_explained_variance double"
    )
