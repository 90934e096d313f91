"""Deterministic bars for tests and demos: three regimes of drift and volatility, a beta and own noise for each ticker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Drift and volatility of the thirds of the period.
REGIMES = ((0.00045, 0.007), (-0.00035, 0.013), (0.00075, 0.009))


def frame(
    tickers: list[str], benchmark: str | None = "MARKET", periods: int = 1250, seed: int = 42, start: str = "2020-01-02"
) -> pd.DataFrame:
    rng, days = np.random.default_rng(seed), pd.bdate_range(start, periods=periods)
    edges = np.linspace(0, periods, len(REGIMES) + 1).astype(int)
    common = np.concatenate([rng.normal(m, s, b - a) for (m, s), a, b in zip(REGIMES, edges, edges[1:])])
    out = []
    for i, name in enumerate([*tickers, *([benchmark] if benchmark else [])]):
        own = common if name == benchmark else (0.75 + 0.12 * i) * common + rng.normal(0, 0.006, periods)
        close = 100 * np.exp(np.cumsum(own))
        before = np.concatenate([[close[0]], close[:-1]])
        out.append(
            pd.DataFrame(
                {
                    "ticker": name,
                    "date": days.date,
                    "open": before,
                    "high": np.maximum(close, before) * 1.01,
                    "low": np.minimum(close, before) * 0.99,
                    "close": close,
                    "volume": np.round(1e6 * np.exp(rng.normal(0, 0.2, periods))),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def bars(spark: SparkSession, tickers: list[str], **how) -> DataFrame:
    from quillon.sources.bars import BARS

    return spark.createDataFrame(frame(tickers, **how), BARS)
