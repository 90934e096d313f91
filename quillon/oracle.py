"""SQL of the queries over the test tables, for DuckDB. Written apart from the operators, to hold them against."""

_TRADES = """trades AS (SELECT n_name AS ticker, r_name AS cluster, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice AS amount, l_quantity AS quantity,
  row_number() OVER (PARTITION BY n_name, date_trunc('week', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_BARS = _TRADES + """, bars AS (SELECT ticker, any_value(cluster) AS cluster, date, max(amount / quantity) FILTER (k = 1) AS open, max(amount / quantity) AS high, min(amount / quantity) AS low,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / sum(quantity) AS close, sum(quantity) AS volume FROM trades GROUP BY ticker, date)"""
_MARKET = """market AS (SELECT date, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / sum(quantity) AS market FROM trades GROUP BY date)"""
_PANEL = _BARS + """, panel AS (SELECT t.ticker, t.cluster, d.date, b.close, b.volume, b.high, b.low FROM (SELECT DISTINCT ticker, cluster FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date)"""
_RETURNS = _PANEL + """, rets AS (SELECT *, close / lag(close) OVER t - 1 AS ret, ln(close) - ln(lag(close) OVER t) AS log_ret FROM panel WINDOW t AS (PARTITION BY ticker ORDER BY date))"""
_RESID = _RETURNS + ", " + _MARKET + """, bench AS (SELECT date, market / lag(market) OVER (ORDER BY date) - 1 AS bench FROM market),
  joined AS (SELECT r.*, bench FROM rets r LEFT JOIN bench b ON r.date = b.date),
  betas AS (SELECT *, CASE WHEN count(ret + bench) OVER f = 60 THEN covar_samp(ret, bench) OVER f END / nullif(CASE WHEN count(bench) OVER f = 60 THEN var_samp(bench) OVER f END, 0) AS beta
    FROM joined WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)),
  resid AS (SELECT *, ret - beta * bench AS resid FROM betas)"""


def _roll(agg: str, x: str, n: int, by: str = "PARTITION BY ticker ") -> str:
    f = f"OVER ({by}ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg.format(x)} {f} END"


def _q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}" if "RECURSIVE" in ctes else f"WITH {ctes} {select}"


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_GROUP = _RESID + f""", marks AS (SELECT *, {_roll('avg({})', 'close', 20)} AS ma20, {_roll('avg({})', 'close', 50)} AS ma50, {_roll('max({})', 'close', 5)} AS top5, volume / nullif({_roll('avg({})', 'volume', 20)}, 0) AS vr FROM resid),
  daily AS (SELECT date, avg(ret) AS r, avg(resid) AS x, avg(CASE WHEN resid > 0 THEN 1.0 ELSE 0.0 END) AS b, stddev_samp(resid) AS s, count(*) AS active_constituents, count(resid) AS present,
    CAST(count(*) FILTER (close > ma20) AS DOUBLE) / nullif(count(close + ma20), 0) AS breadth_above_ma20, CAST(count(*) FILTER (close > ma50) AS DOUBLE) / nullif(count(close + ma50), 0) AS breadth_above_ma50,
    CAST(count(*) FILTER (close >= top5) AS DOUBLE) / nullif(count(close + top5), 0) AS breadth_new_high_5, CAST(count(*) FILTER (ret > 0 AND vr > 1) AS DOUBLE) / nullif(count(ret + vr), 0) AS advancing_volume_breadth, median(vr) AS median_volume_ratio FROM marks GROUP BY date),
  kept AS (SELECT *, CASE WHEN present >= greatest(2, ceil(active_constituents * 0.8)) THEN r END AS group_return, CASE WHEN present >= greatest(2, ceil(active_constituents * 0.8)) THEN x END AS group_excess_return,
    CASE WHEN present >= greatest(2, ceil(active_constituents * 0.8)) THEN b END AS breadth_positive_1d, CASE WHEN present >= greatest(2, ceil(active_constituents * 0.8)) THEN s END AS cross_sectional_dispersion, CAST(present AS DOUBLE) / active_constituents AS constituent_coverage FROM daily)"""
_GROUP_OUT = "SELECT date, active_constituents, " + _rounded("group_return", "group_excess_return", "breadth_positive_1d", "cross_sectional_dispersion", "constituent_coverage", "breadth_above_ma20", "breadth_above_ma50", "breadth_new_high_5", "advancing_volume_breadth", "median_volume_ratio") + ", " + ", ".join(f"round({_roll('product(1 + {})', 'group_excess_return', n, '')} - 1, 6) AS relative_return_{n}" for n in (5, 20, 60)) + f", round({_roll('stddev_samp({})', 'group_return', 20, '')} * sqrt(252), 6) AS realized_volatility FROM kept"

_SECTOR = _PANEL + f""", filled AS (SELECT ticker, date, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING) AS close, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS through FROM panel),
  moved AS (SELECT *, close / lag(close) OVER t - 1 AS ret, through / lag(through, 5) OVER t - 1 AS c5, through / lag(through, 20) OVER t - 1 AS c20, {_roll('avg({})', 'close', 20)} AS ma20, {_roll('avg({})', 'close', 60)} AS ma60 FROM filled WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  day AS (SELECT date, avg(ret) AS sector_return_1d, CAST(count(*) FILTER (ret > 0) AS DOUBLE) / nullif(count(ret), 0) AS advance_fraction, CAST(count(*) FILTER (close > ma20) AS DOUBLE) / nullif(count(close), 0) AS breadth_above_short_ma,
    CAST(count(*) FILTER (close > ma60) AS DOUBLE) / nullif(count(close), 0) AS breadth_above_mid_ma, CAST(count(*) FILTER (c5 > 0) AS DOUBLE) / nullif(count(close), 0) AS breadth_positive_5d, CAST(count(*) FILTER (c20 > 0) AS DOUBLE) / nullif(count(close), 0) AS breadth_positive_20d,
    stddev_samp(ret) AS cross_section_dispersion, median(close * volume) AS median_dollar_volume, CAST(count(close) AS DOUBLE) / count(*) AS eligible_ticker_fraction FROM moved GROUP BY date),
  idx AS (SELECT *, product(1 + coalesce(sector_return_1d, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS sector_index FROM day),
  sector AS (SELECT *, sector_index / lag(sector_index, 5) OVER d - 1 AS sector_return_5d, sector_index / lag(sector_index, 20) OVER d - 1 AS sector_return_20d, sector_index / lag(sector_index, 60) OVER d - 1 AS sector_return_60d,
    {_roll('stddev_samp({})', 'sector_return_1d', 20, '')} * sqrt(252) AS realized_vol_20d, sector_index / {_roll('max({})', 'sector_index', 60, '')} - 1 AS drawdown_60d, sector_index / {_roll('max({})', 'sector_index', 120, '')} - 1 AS drawdown_long, breadth_positive_5d - lag(breadth_positive_5d, 5) OVER d AS breadth_thrust_5d FROM idx WINDOW d AS (ORDER BY date))"""
_SECTOR_OUT = "SELECT date, " + _rounded("sector_return_1d", "advance_fraction", "breadth_above_short_ma", "breadth_above_mid_ma", "breadth_positive_5d", "breadth_positive_20d", "cross_section_dispersion", "eligible_ticker_fraction", "sector_index", "sector_return_5d", "sector_return_20d", "sector_return_60d", "realized_vol_20d", "drawdown_60d", "drawdown_long", "breadth_thrust_5d") + ", round(median_dollar_volume, 3) AS median_dollar_volume, round(sector_return_20d / nullif(realized_vol_20d, 0), 6) AS short_trend_score, round(sector_return_60d / nullif(realized_vol_20d, 0), 6) AS mid_trend_score FROM sector"


def _pairs(window: int) -> str:
    f = f"(PARTITION BY x.ticker, y.ticker ORDER BY x.date ROWS {window - 1} PRECEDING)"
    return _RETURNS + f""", prs AS (SELECT x.ticker AS a, y.ticker AS b, x.date, x.ret AS x, y.ret AS y FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker),
  clean AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS p, CASE WHEN x IS NOT NULL THEN y END AS q FROM prs),
  rolled AS (SELECT a, b, date, count(p) OVER f AS n, covar_samp(p, q) OVER f / nullif(stddev_samp(p) OVER f * stddev_samp(q) OVER f, 0) AS rho, count(x) OVER f AS nx, count(y) OVER f AS ny, row_number() OVER (PARTITION BY a, b ORDER BY date) AS k FROM clean WINDOW f AS (PARTITION BY a, b ORDER BY date ROWS {window - 1} PRECEDING))"""


def _ewm(source: str, name: str, inputs: list[str], n: int, first: int = 1) -> str:
    """A recursion along k, from k = first on, over columns ticker, k and inputs of source."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in inputs)
    step = ", ".join(f"e.{x} * (1 - 1.0 / {n}) + s.{x} * (1.0 / {n})" for x in inputs)
    return f"{name} AS (SELECT ticker, k, {seed} FROM {source} WHERE k = {first} UNION ALL SELECT s.ticker, s.k, {step} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.k = e.k + 1)"


_RSI = _BARS + """, numbered AS (SELECT *, row_number() OVER t AS k, close - lag(close) OVER t AS delta FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  moves AS (SELECT ticker, k, greatest(delta, 0) AS g, greatest(-delta, 0) AS l FROM numbered WHERE k > 1), """ + _ewm("moves", "ew", ["g", "l"], 14, 2) + """,
  rsis AS (SELECT n.*, CASE WHEN e.l IS NULL THEN NULL WHEN e.l = 0 THEN 100.0 ELSE 100 - 100 / (1 + e.g / e.l) END AS rsi FROM numbered n LEFT JOIN ew e ON n.ticker = e.ticker AND n.k = e.k)"""
_INDICATORS = _RSI + f""", step1 AS (SELECT *, {_roll('min({})', 'low', 14)} AS lo, {_roll('max({})', 'high', 14)} AS hi, {_roll('avg({})', 'close', 60)} AS m60, {_roll('stddev_samp({})', 'close', 60)} AS s60, volume / nullif({_roll('median({})', 'volume', 20)}, 0) AS rel,
    {_roll('min({})', 'close', 20)} AS pl, {_roll('min({})', 'rsi', 20)} AS rl, {_roll('avg({})', 'close', 20)} AS ma FROM rsis),
  step2 AS (SELECT *, least(greatest(({_roll('max({})', 'rel', 10)} - 2) / 3, 0), 1) AS spike0, {_roll('max({})', 'rel', 10)} AS rel10, pl < lag(pl, 20) OVER t AND rl > lag(rl, 20) OVER t AS div0, close > lag(high) OVER t AS above, close > ma AND lag(close) OVER t <= lag(ma) OVER t AS reclaim FROM step1 WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  ind AS (SELECT ticker, cluster, date, close, rsi, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r, coalesce((close - m60) / nullif(s60, 0), 0) AS stretch_z,
    CASE WHEN rel10 IS NULL OR rel IS NULL OR rel = 0 THEN 0 ELSE 0.6 * spike0 + 0.4 * least(greatest((1 / rel - 1) / 1.5, 0), 1) END AS volume_signal, coalesce(div0, false) AS divergence, coalesce(above, false) OR coalesce(reclaim, false) AS confirmed FROM step2)"""

ORACLE_SQL = {
    "bars": _q(_BARS, "SELECT ticker, cluster, date, " + _rounded("open", "high", "low", "close", "volume") + " FROM bars"),
    "panel": _q(_PANEL, "SELECT ticker, cluster, date, round(close, 6) AS close, volume FROM panel"),
    "asof_truncate": _q(_BARS, "SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date <= DATE '1995-06-30'"),
    "half_open_range": _q(_BARS, "SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-06'"),
    "min_history": _q(_BARS, "SELECT ticker, count(close) AS n FROM bars GROUP BY ticker HAVING count(close) >= 350"),
    "coverage_gate": _q(_BARS, "SELECT ticker, count(close) AS n, count(close) >= 357 AS enough, sum(CASE WHEN count(close) >= 357 THEN 1 ELSE 0 END) OVER ()::BIGINT AS usable, sum(CASE WHEN count(close) >= 357 THEN 1 ELSE 0 END) OVER () >= greatest(3, ceil(25 * 0.8)) AS gate FROM bars GROUP BY ticker"),
    "returns": _q(_RETURNS, "SELECT ticker, date, " + _rounded("ret", "log_ret") + " FROM rets"),
    "beta_residual": _q(_RESID, "SELECT ticker, date, " + _rounded("bench", "beta", "resid") + " FROM resid"),
    "group_features": _q(_GROUP, _GROUP_OUT),
    "sector_features": _q(_SECTOR, _SECTOR_OUT),
    "pair_correlation": _q(_RETURNS, "SELECT a, b, n, round(CASE WHEN n >= 30 THEN c END, 6) AS rho, round(sqrt(2 * (1 - coalesce(CASE WHEN n >= 30 THEN c END, -1))), 6) AS distance FROM (SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, covar_samp(x.log_ret, y.log_ret) / nullif(stddev_samp(x.log_ret) * stddev_samp(y.log_ret), 0) AS c FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker WHERE x.log_ret IS NOT NULL AND y.log_ret IS NOT NULL GROUP BY 1, 2)"),
    "rolling_mean_correlation": _q(_pairs(60), "SELECT date, round(avg(CASE WHEN n >= 2 THEN rho END), 6) AS average_pairwise_correlation FROM rolled WHERE k >= 60 AND nx >= 30 AND ny >= 30 GROUP BY date"),
    "rolling_median_correlation": _q(_pairs(60), "SELECT date, round(median(CASE WHEN n >= 30 THEN rho END), 6) AS median_pairwise_correlation FROM rolled WHERE k >= 60 GROUP BY date"),
    "residualize": _q(_RETURNS + ", " + _MARKET + ", bench AS (SELECT date, ln(market) - ln(lag(market) OVER (ORDER BY date)) AS f FROM market), j AS (SELECT r.ticker, r.date, log_ret, f FROM rets r LEFT JOIN bench b ON r.date = b.date), fit AS (SELECT ticker, count(log_ret + f) AS n, regr_slope(log_ret, f) AS s, regr_intercept(log_ret, f) AS i FROM j GROUP BY ticker)", "SELECT j.ticker, date, round(CASE WHEN n < 30 OR s IS NULL THEN log_ret ELSE log_ret - (i + s * f) END, 6) AS resid FROM j JOIN fit ON j.ticker = fit.ticker"),
    "indicators": _q("RECURSIVE " + _INDICATORS, "").replace("WITH RECURSIVE RECURSIVE", "WITH RECURSIVE") + "SELECT ticker, date, " + _rounded("rsi", "williams_r", "stretch_z", "volume_signal") + ", divergence, confirmed FROM ind",
}

_PRSI = _PANEL + """, pnum AS (SELECT ticker, cluster, date, close, row_number() OVER t AS k, close - lag(close) OVER t AS delta FROM panel WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  pfirst AS (SELECT ticker, min(k) AS k0 FROM pnum WHERE delta IS NOT NULL GROUP BY ticker),
  pew AS (SELECT n.ticker, n.k, greatest(delta, 0) AS g, greatest(-delta, 0) AS l, 0 AS gap FROM pnum n JOIN pfirst f ON n.ticker = f.ticker AND n.k = f.k0
    UNION ALL SELECT n.ticker, n.k, CASE WHEN delta IS NULL THEN g ELSE (pow(13.0 / 14, gap + 1) * g + greatest(delta, 0) / 14) / (pow(13.0 / 14, gap + 1) + 1.0 / 14) END, CASE WHEN delta IS NULL THEN l ELSE (pow(13.0 / 14, gap + 1) * l + greatest(-delta, 0) / 14) / (pow(13.0 / 14, gap + 1) + 1.0 / 14) END, CASE WHEN delta IS NULL THEN gap + 1 ELSE 0 END
    FROM pew e JOIN pnum n ON n.ticker = e.ticker AND n.k = e.k + 1),
  prsi AS (SELECT n.*, CASE WHEN e.l IS NULL THEN NULL WHEN e.l = 0 THEN 100.0 ELSE 100 - 100 / (1 + e.g / e.l) END AS rsi FROM pnum n LEFT JOIN pew e ON n.ticker = e.ticker AND n.k = e.k),
  pma AS (SELECT *, """ + _roll("avg({})", "close", 60) + """ AS ma FROM prsi),
  wash AS (SELECT cluster, date, avg(CASE WHEN rsi < 35 AND close < ma THEN 1.0 ELSE 0.0 END) AS washout FROM pma GROUP BY cluster, date)"""
_ALARM = _INDICATORS + _PRSI[len(_BARS) :] + """, al0 AS (SELECT i.*, coalesce(w.washout, 0) AS washout, 100 * (0.25 * coalesce(w.washout, 0) + 0.20 * least(greatest(-stretch_z / 2, 0), 1) + 0.25 * coalesce(least(greatest((50 - rsi) / 30, 0), 1), 0) + 0.15 * volume_signal + 0.15 * (0.5 * CAST(confirmed AS INT) + 0.5 * CAST(divergence AS INT))) AS alarm FROM ind i LEFT JOIN wash w ON i.cluster = w.cluster AND i.date = w.date),
  al AS (SELECT *, washout > -0.5 AND alarm > 20 AND confirmed AS fired FROM al0)"""


def _r(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_ADX = _BARS + """, dm AS (SELECT ticker, row_number() OVER t AS k, high - lag(high) OVER t AS up, lag(low) OVER t - low AS dn, greatest(high - low, abs(high - lag(close) OVER t), abs(low - lag(close) OVER t)) AS tr FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  dm2 AS (SELECT ticker, k, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m, tr FROM dm), """ + _ewm("dm2", "de", ["p", "m", "tr"], 14) + """,
  dx AS (SELECT ticker, k, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM de), dxn AS (SELECT ticker, dx, row_number() OVER (PARTITION BY ticker ORDER BY k) AS k FROM dx WHERE dx IS NOT NULL), """ + _ewm("dxn", "ax", ["dx"], 14) + """,
  adxs AS (SELECT b.ticker, CASE WHEN b.n >= 29 THEN coalesce(a.dx, 0) ELSE 0 END AS adx FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) b LEFT JOIN (SELECT ticker, arg_max(dx, k) AS dx FROM ax GROUP BY ticker) a ON a.ticker = b.ticker)"""


def _slope(n: int, name: str) -> str:
    return f"""{name} AS (SELECT ticker, CASE WHEN count(*) < 3 OR var_pop(ln(close)) < 1e-16 THEN 0 ELSE regr_slope(ln(close), -CAST(k AS DOUBLE)) * 252 END AS slope, CASE WHEN count(*) < 3 OR var_pop(ln(close)) < 1e-16 THEN 0 ELSE greatest(pow(covar_pop(ln(close), -CAST(k AS DOUBLE)), 2) / (var_pop(ln(close)) * var_pop(CAST(k AS DOUBLE))), 0) END AS r2
      FROM (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= {n} GROUP BY ticker)"""


def _vote(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR abs({a} - {b}) <= 1e-9 * greatest(abs({b}), 1) THEN 0 WHEN {a} > {b} THEN 1 ELSE -1 END"


def _stack(short: int, mid: int, name: str) -> str:
    return f"""{name}a AS (SELECT ticker, date, close, {_roll('avg({})', 'close', short)} AS s, {_roll('avg({})', 'close', mid)} AS m FROM bars),
      {name}b AS (SELECT *, lag(s, 4) OVER t AS s4, lag(m, 4) OVER t AS m4, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM {name}a WINDOW t AS (PARTITION BY ticker ORDER BY date)),
      {name} AS (SELECT ticker, CASE WHEN n < {mid + 5} THEN 0.0 ELSE ({_vote('close', 's')} + {_vote('s', 'm')} + {_vote('s', 's4')} + {_vote('m', 'm4')}) / 4.0 END AS ma_stack FROM {name}b WHERE k = 1)"""


def _score(n: int, name: str) -> str:
    return _slope(n, f"sl{n}") + ", " + _stack(max(n // 3, 2), n, f"st{n}") + f""", vo{n} AS (SELECT ticker, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM (SELECT ticker, date, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM bars) WHERE r IS NOT NULL) WHERE k <= {n} GROUP BY ticker),
      {name} AS (SELECT s.ticker, s.r2, a.adx, t.ma_stack, least(greatest(100 * (0.40 * tanh(slope / vol) + 0.30 * r2 * sign(tanh(slope / vol)) + 0.15 * least(adx / 50, 1) * sign(tanh(slope / vol)) + 0.15 * ma_stack), -100), 100) AS score FROM sl{n} s JOIN vo{n} v ON s.ticker = v.ticker JOIN st{n} t ON s.ticker = t.ticker JOIN adxs a ON a.ticker = s.ticker)"""


_CAPTURE = """round(avg(CASE WHEN g > 0 THEN log_ret END) / avg(CASE WHEN g > 0 THEN g END), 6)""", """round(avg(CASE WHEN g < 0 THEN log_ret END) / avg(CASE WHEN g < 0 THEN g END), 6)"""
_GROUPED = _RETURNS + """, grp AS (SELECT cluster, date, avg(log_ret) AS g FROM rets GROUP BY cluster, date), both_ AS (SELECT r.*, g FROM rets r JOIN grp ON r.cluster = grp.cluster AND r.date = grp.date)"""


def _drawdown(source: str) -> str:
    return f"""dd0 AS (SELECT ticker, close, row_number() OVER t AS pos, max(close) OVER (t ROWS UNBOUNDED PRECEDING) AS peak FROM {source} WHERE close IS NOT NULL WINDOW t AS (PARTITION BY ticker ORDER BY date)),
      dd1 AS (SELECT *, close / peak - 1 AS dd FROM dd0), dd2 AS (SELECT ticker, dd, pos, peak FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dd, pos) AS k FROM dd1) WHERE k = 1),
      dd AS (SELECT t.ticker, t.dd AS max_drawdown, coalesce(min(d.pos) - t.pos, -1) AS recovery_days FROM dd2 t LEFT JOIN dd1 d ON d.ticker = t.ticker AND d.pos >= t.pos AND d.close >= t.peak GROUP BY t.ticker, t.dd, t.pos)"""


_BOTTOM = """coalesce(count({x}) OVER ({by} ORDER BY date ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) = 2 * {k} + 1 AND {x} = min({x}) OVER ({by} ORDER BY date ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AND lead({x}, {h}) OVER ({by} ORDER BY date) / {x} - 1 >= {r}, false)"""
_SIGNAL = _ALARM + ", sig AS (SELECT ticker, date, close, washout, alarm, confirmed, fired, " + _BOTTOM.format(
    x="close", by="PARTITION BY ticker", k=5, h=10, r=0.05
) + " AS label, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM al)"
_FORWARD = ", ".join(f"lead(close, {h}) OVER t / close - 1 AS h{h}" for h in (5, 10, 20))
_SAMPLES = _ALARM + f", fw AS (SELECT *, {_FORWARD} FROM al WINDOW t AS (PARTITION BY ticker ORDER BY date)), smp AS (SELECT h AS horizon, v AS value FROM (SELECT unnest([5, 10, 20]) AS h, unnest([h5, h10, h20]) AS v FROM fw WHERE fired) WHERE v IS NOT NULL)"
_ECON = "count(*) AS n, avg(value) AS mean_return, median(value) AS median_return, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate"


def _mix(key: str, r: int, v: str) -> str:
    a = f"(({key} + {r * 40503} + {v} * 2654435) % 2147483647)"
    b = f"(({a} * {a} + {key}) % 2147483647)"
    return f"(({b} * {b} + {v}) % 2147483647)"


def _drawn(draws: int) -> str:
    """Random days of each ticker, as many as it has signals, of those with room for the longest horizon: by 20 rounds of swap or not."""
    out = [
        "cand AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM fw)",
        "rooms AS (SELECT ticker, greatest(count(*) - 20, 1) AS n, least(count(*) FILTER (fired), greatest(count(*) - 20, 1)) AS wanted FROM cand GROUP BY ticker)",
        f"s0 AS (SELECT ticker, d, n, k AS x, ('0x' || substr(md5('0|' || d || '|' || ticker), 1, 7))::BIGINT AS key FROM (SELECT *, unnest(range(0, wanted)) AS k FROM rooms), (SELECT unnest(range(1, {draws} + 1)) AS d))",
    ]
    for r in range(20):
        other = f"SELECT *, (({_mix('key', r, 'n')} % n - x) % n + n) % n AS y FROM s{r}"
        out.append(f"s{r + 1} AS MATERIALIZED (SELECT ticker, d, n, key, CASE WHEN ({_mix('key', r, 'greatest(x, y)')} // 4096) % 2 = 1 THEN y ELSE x END AS x FROM ({other}))")
    return ", ".join(out) + ", drw AS (SELECT s.ticker, s.d, c.h5, c.h10, c.h20 FROM s20 s JOIN cand c ON c.ticker = s.ticker AND c.pos = s.x)"


_FOLDS = "folds AS (SELECT CAST(y - 1998 AS INT) AS fold, DATE '1995-01-02' AS fit_start, make_date(y, 1, 1) - 1 AS fit_end, make_date(y, 1, 1) AS test_start, least(make_date(y, 12, 31), DATE '2001-06-30') AS test_end, make_date(y, 12, 31) > DATE '2001-06-30' AS partial FROM (SELECT unnest(range(1998, 2002)) AS y))"
#: Written from the rules of the export's source: words that mark other securities, symbols of up to fifteen signs.
_NOT_COMMON = r"(?i)\b(warrants?|rights?|units?|preferred|preference|bonds?|debentures?)\b|\bnotes due\b"
_EXPORT = f"""raw AS (SELECT p_partkey AS place, upper(CASE WHEN p_partkey % 29 = 0 THEN '9' ELSE 's' END || (p_partkey % 700) || CASE WHEN p_partkey % 5 = 0 THEN '/b' WHEN p_partkey % 7 = 0 THEN '.c' ELSE '' END) AS own,
    CASE p_partkey % 13 WHEN 3 THEN 'United ' WHEN 8 THEN 'Bright ' ELSE '' END || p_name || CASE p_partkey % 13 WHEN 0 THEN ' Warrant' WHEN 1 THEN ' Warrants' WHEN 2 THEN ' Rights' WHEN 4 THEN ' Unit' WHEN 5 THEN ' Preference Shares' WHEN 6 THEN ' Depositary Shares' WHEN 7 THEN ' Notes Due 2030' WHEN 9 THEN ' Bonds' ELSE '' END AS name,
    p_type AS industry, p_brand AS sector, CASE WHEN p_size % 2 = 0 THEN 'France' ELSE 'Japan' END AS country, CAST(CAST(trunc(p_retailprice * 100) AS BIGINT) AS DOUBLE) AS market_cap FROM part),
  uni AS (SELECT symbol, name, industry, sector, country, market_cap, NOT regexp_matches(name, '{_NOT_COMMON}') AS eligible FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY market_cap DESC, name DESC, industry DESC, sector DESC, country DESC) AS k FROM (SELECT *, replace(replace(own, '/', '-'), '.', '-') AS symbol FROM raw WHERE regexp_full_match(own, '[A-Z][A-Z0-9.^/-]{{0,14}}'))) WHERE k = 1)"""
_COVER = "cov AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS s, CAST(ts AS DATE) + CAST(event_id % 4 AS INT) AS e FROM events WHERE event_id % 4 > 0), days AS (SELECT DISTINCT user_id, CAST(unnest(generate_series(s, e - 1, INTERVAL 1 DAY)) AS DATE) AS d FROM cov)"
_ISLANDS = "isl AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM {src})"
_MANIFEST = """cust AS (SELECT c_custkey AS k, c_name AS symbol, 'N' || c_custkey AS name, 'tech' AS sector, c_mktsegment AS industry, 'US' AS country, CASE WHEN c_custkey % 4 > 0 THEN 2010 + c_custkey % 14 END AS ipo_year, abs(c_acctbal) AS market_cap FROM customer), a AS (SELECT * FROM cust WHERE k % 3 <> 0), b AS (SELECT * REPLACE (market_cap + 1 AS market_cap) FROM cust WHERE k % 5 <> 0)"""
_PRED = """o AS (SELECT round(o_totalprice % 101 / 101, 2) AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS t, CAST(o_custkey % 21 AS DOUBLE) / 100.0 - 0.1 AS r FROM orders),
  rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rank FROM o), cum AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM (SELECT p, sum(t) AS pos, count(*) AS n FROM o GROUP BY p))"""

ORACLE_SQL |= {
    "cluster_washout": _r(_PRSI, "SELECT cluster, date, round(washout, 6) AS washout FROM wash"),
    "ticker_alarm": _r(_ALARM, "SELECT ticker, date, " + _rounded("washout", "alarm") + ", fired FROM al"),
    "adx": _r(_ADX, "SELECT ticker, round(adx, 6) AS adx FROM adxs"),
    "log_slope_r2": _q(_BARS + ", " + _slope(60, "sl"), "SELECT ticker, " + _rounded("slope", "r2") + " FROM sl"),
    "ma_stack": _q(_BARS + ", " + _stack(20, 60, "st"), "SELECT ticker, ma_stack FROM st"),
    "trend_table": _r(_ADX + ", " + _score(20, "a20") + ", " + _score(60, "a60"), "SELECT a.ticker, round(a.score, 6) AS short_score, round(b.score, 6) AS mid_score, round(a.r2, 6) AS short_r2, round(b.r2, 6) AS mid_r2, round(b.adx, 6) AS adx, b.ma_stack FROM a20 a JOIN a60 b ON a.ticker = b.ticker WHERE a.ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 65)"),
    "capture_ratios": _q(_GROUPED, f"SELECT ticker, {_CAPTURE[0]} AS up_capture, {_CAPTURE[1]} AS down_capture, count(*) FILTER (g > 0) AS up_days, count(*) FILTER (g < 0) AS down_days FROM both_ WHERE log_ret IS NOT NULL AND g IS NOT NULL GROUP BY ticker"),
    "drawdown_recovery": _q(_BARS + ", " + _drawdown("bars"), "SELECT ticker, round(max_drawdown, 6) AS max_drawdown, recovery_days FROM dd"),
    "strength_table": _q(_GROUPED + ", lastd AS (SELECT * FROM both_ WHERE date IN (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 120)), " + _drawdown("lastd") + ", cap AS (SELECT cluster, ticker, avg(CASE WHEN g > 0 THEN log_ret END) / avg(CASE WHEN g > 0 THEN g END) AS up_capture, avg(CASE WHEN g < 0 THEN log_ret END) / avg(CASE WHEN g < 0 THEN g END) AS down_capture FROM lastd WHERE log_ret IS NOT NULL AND g IS NOT NULL GROUP BY cluster, ticker)", "SELECT cap.cluster, cap.ticker, " + _rounded("up_capture", "down_capture", "max_drawdown") + ", round(up_capture - down_capture, 6) AS capture_spread, recovery_days, rank() OVER (PARTITION BY cluster ORDER BY up_capture - down_capture DESC) AS rank_in_cluster FROM cap JOIN dd ON cap.ticker = dd.ticker"),
    "rank_tickers": _q(
        _RETURNS + """, sec AS (SELECT date, avg(ret) AS g FROM rets GROUP BY date), thr AS (SELECT ticker, date, ret, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS through FROM rets), mom AS (SELECT *, through / lag(through, 20) OVER (PARTITION BY ticker ORDER BY date) - 1 AS momentum FROM thr),
      lst AS (SELECT m.*, g, product(1 + coalesce(ret, 0)) OVER t AS oi, product(1 + coalesce(g, 0)) OVER t AS si FROM mom m JOIN sec s ON m.date = s.date WHERE m.date IN (SELECT date FROM sec ORDER BY date DESC LIMIT 60) WINDOW t AS (PARTITION BY ticker ORDER BY m.date ROWS UNBOUNDED PRECEDING)),
      dds AS (SELECT *, oi / max(oi) OVER t - 1 AS od, si / max(si) OVER t - 1 AS sd FROM lst WINDOW t AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
      rk AS (SELECT ticker, avg(CASE WHEN g < 0 THEN ret END) / avg(CASE WHEN g < 0 THEN g END) AS downside_capture, avg(CASE WHEN g > 0 THEN ret END) / avg(CASE WHEN g > 0 THEN g END) AS upside_capture, min(od) - min(sd) AS relative_drawdown, arg_max(momentum, date) AS momentum_20d, corr(ret, g) AS sector_correlation FROM dds GROUP BY ticker),
      pct AS (SELECT *, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY round({c}, 9) NULLS LAST) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0) / count({c}) OVER () END AS p_{c}" for c in ("downside_capture", "relative_drawdown", "upside_capture", "momentum_20d")) + " FROM rk), scs AS (SELECT *, round(p_relative_drawdown - p_downside_capture, 9) AS f, round(p_upside_capture + p_momentum_20d, 9) AS u FROM pct)",
        "SELECT ticker, " + _rounded("downside_capture", "upside_capture", "relative_drawdown", "momentum_20d", "sector_correlation") + ", round(f, 6) AS fall_resistance_score, round(u, 6) AS rise_strength_score, CASE WHEN f IS NOT NULL THEN rank() OVER (ORDER BY f DESC NULLS LAST) END AS fall_resistance_rank, CASE WHEN u IS NOT NULL THEN rank() OVER (ORDER BY u DESC NULLS LAST) END AS rise_strength_rank FROM scs",
    ),
    "bottom_labels": _q(_BARS, "SELECT ticker, date, " + _BOTTOM.format(x="close", by="PARTITION BY ticker", k=5, h=10, r=0.05) + " AS label FROM bars"),
    "first_hit_labels": _q(_SECTOR + ", num AS (SELECT date, sector_index, drawdown_60d, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM sector), hits AS (SELECT a.k, min(b.k) FILTER (b.sector_index / a.sector_index - 1 >= 0.05) AS up, min(b.k) FILTER (b.sector_index / a.sector_index - 1 <= -0.03) AS dn FROM num a JOIN num b ON b.k BETWEEN a.k + 1 AND a.k + 10 GROUP BY a.k)", "SELECT date, CASE WHEN drawdown_60d <= -0.08 AND num.k + 10 <= n THEN CASE WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 1.0 ELSE 0.0 END END AS label FROM num LEFT JOIN hits ON num.k = hits.k"),
    "forward_returns": _q(_RETURNS, "SELECT ticker, date, round(lead(close, 5) OVER t / close - 1, 6) AS forward_5, round(CASE WHEN count(ret) OVER f = 5 THEN product(1 + ret) OVER f END - 1, 6) AS compound_5 FROM rets WINDOW t AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"),
    "signal_matches": _r(_SIGNAL + ", near AS (SELECT s.ticker, s.pos, l.pos AS label_pos, row_number() OVER (PARTITION BY s.ticker, s.pos ORDER BY abs(l.pos - s.pos), l.pos) AS k FROM sig s LEFT JOIN sig l ON l.ticker = s.ticker AND l.label WHERE s.fired)", "SELECT ticker, pos, label_pos, label_pos - pos AS lead, coalesce(abs(label_pos - pos) <= 10, false) AS matched FROM near WHERE k = 1"),
    "classification_scores": _r(_SIGNAL + ", near AS (SELECT s.ticker, s.pos, l.pos AS lp, row_number() OVER (PARTITION BY s.ticker, s.pos ORDER BY abs(l.pos - s.pos), l.pos) AS k FROM sig s LEFT JOIN sig l ON l.ticker = s.ticker AND l.label WHERE s.fired), cnt AS (SELECT count(*) AS signals, count(*) FILTER (abs(lp - pos) <= 10) AS true_positives, count(DISTINCT CASE WHEN abs(lp - pos) <= 10 THEN ticker || '|' || lp END) AS matched_labels, avg(CASE WHEN abs(lp - pos) <= 10 THEN lp - pos END) AS mean_lead_days FROM near WHERE k = 1), lab AS (SELECT count(*) FILTER (label) AS labels FROM sig)", "SELECT labels, signals, true_positives, matched_labels, round(mean_lead_days, 6) AS mean_lead_days, round(coalesce(true_positives / nullif(signals, 0), 0), 6) AS precision, round(coalesce(matched_labels / nullif(labels, 0), 0), 6) AS recall, round(coalesce(2.0 * true_positives / signals * matched_labels / labels / nullif(true_positives / signals + matched_labels / labels, 0), 0), 6) AS f1 FROM cnt, lab"),
    "economic_metrics": _r(_SAMPLES, f"SELECT CAST(horizon AS INT) AS horizon, n, " + _rounded("mean_return", "median_return", "hit_rate") + f" FROM (SELECT horizon, {_ECON} FROM smp GROUP BY horizon)"),
    "edge_table": _r(
        _SAMPLES + ", " + _drawn(50) + ", bsm AS (SELECT h AS horizon, v AS value FROM (SELECT unnest([5, 10, 20]) AS h, unnest([h5, h10, h20]) AS v FROM drw) WHERE v IS NOT NULL), " + f"own AS (SELECT horizon, {_ECON} FROM smp GROUP BY horizon), chance AS (SELECT horizon, {_ECON} FROM bsm GROUP BY horizon)",
        "SELECT CAST(o.horizon AS INT) AS horizon, o.n, " + ", ".join(f"round(o.{c}, 6) AS {c}" for c in ("mean_return", "median_return", "hit_rate")) + ", c.n AS n_baseline, " + ", ".join(f"round(c.{c}, 6) AS {c}_baseline" for c in ("mean_return", "median_return", "hit_rate")) + ", round(o.mean_return - c.mean_return, 6) AS mean_edge, round(o.hit_rate - c.hit_rate, 6) AS hit_rate_edge FROM own o JOIN chance c ON o.horizon = c.horizon",
    ),
    "random_baseline": _r(_SAMPLES + ", " + _drawn(200) + ", bsm AS (SELECT ticker, d, h AS horizon, v AS value FROM (SELECT ticker, d, unnest([5, 10, 20]) AS h, unnest([h5, h10, h20]) AS v FROM drw) WHERE v IS NOT NULL), " + f"each AS (SELECT ticker, horizon, d, {_ECON} FROM bsm GROUP BY ticker, horizon, d)", "SELECT ticker, CAST(horizon AS INT) AS horizon, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("n", "mean_return", "median_return", "hit_rate")) + " FROM each GROUP BY ticker, horizon"),
    "folds": _q(_FOLDS, "SELECT * FROM folds"),
    "gate_search": _r(_SIGNAL + ", " + _FOLDS + ", gates AS (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0])::DOUBLE AS gate), fit AS (SELECT fold, gate, ticker, date, label, washout > -0.5 AND alarm > gate AND confirmed AS s FROM sig, folds, gates WHERE date BETWEEN fit_start AND fit_end), pos AS (SELECT *, row_number() OVER (PARTITION BY fold, gate, ticker ORDER BY date) AS p FROM fit), near AS (SELECT x.fold, x.gate, x.ticker, x.p, l.p AS lp, row_number() OVER (PARTITION BY x.fold, x.gate, x.ticker, x.p ORDER BY abs(l.p - x.p), l.p) AS k FROM pos x LEFT JOIN pos l ON l.fold = x.fold AND l.gate = x.gate AND l.ticker = x.ticker AND l.label WHERE x.s), c1 AS (SELECT fold, gate, count(*) AS n, count(*) FILTER (abs(lp - p) <= 10) AS tp, count(DISTINCT CASE WHEN abs(lp - p) <= 10 THEN ticker || '|' || lp END) AS ml FROM near WHERE k = 1 GROUP BY ALL), c2 AS (SELECT fold, gate, count(*) FILTER (label) AS labels FROM pos GROUP BY ALL), f AS (SELECT c2.fold, c2.gate, coalesce(2.0 * (tp / n) * (ml / labels) / nullif(tp / n + ml / labels, 0), 0) AS f1 FROM c2 LEFT JOIN c1 ON c1.fold = c2.fold AND c1.gate = c2.gate)", "SELECT fold, gate, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, gate) AS k FROM f) WHERE k = 1"),
    "purged_splits": "SELECT CAST(i AS INT) AS split, greatest(300 - (4 - i) * 60 - 10, 0) AS train_end, 300 - (4 - i) * 60 AS test_start, 300 - (4 - i) * 60 + 60 AS test_end FROM (SELECT unnest(range(0, 4)) AS i)",
    "prediction_metrics": _q(_PRED, "SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (t = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy_at_0_5, round(avg((p - t) * (p - t)), 6) AS brier_score, count(*) FILTER (p >= 0.6) AS bullish_observations, count(*) FILTER (p <= 0.4) AS bearish_observations, round(avg(CASE WHEN p >= 0.6 THEN r END), 6) AS mean_forward_return_when_bullish, round(avg(CASE WHEN p <= 0.4 THEN r END), 6) AS mean_forward_return_when_bearish, round(avg(CASE WHEN p >= 0.6 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END), 6) AS bullish_hit_rate, round(avg(CASE WHEN p <= 0.4 THEN CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END END), 6) AS bearish_hit_rate, round((sum(t * rank) - sum(t) * (sum(t) + 1) / 2) / (sum(t) * (count(*) - sum(t))), 6) AS roc_auc, (SELECT round(sum(pos * tp / seen) / sum(pos), 6) FROM cum) AS average_precision, round(coalesce(count(*) FILTER (p >= 0.7 AND t = 1) / nullif(count(*) FILTER (p >= 0.7), 0), 0), 6) AS precision_at_threshold, round(coalesce(count(*) FILTER (p >= 0.7 AND t = 1) / nullif(count(*) FILTER (t = 1), 0), 0), 6) AS recall_at_threshold FROM rk"),
    "interval_union": _q(_COVER + ", " + _ISLANDS.format(src="days"), 'SELECT user_id, min(d) AS start, max(d) + 1 AS "end" FROM isl GROUP BY user_id, g'),
    "interval_gaps": _q(_COVER + ", users AS (SELECT DISTINCT user_id FROM events), gap AS (SELECT user_id, d FROM (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d FROM users) EXCEPT SELECT user_id, d FROM days), " + _ISLANDS.format(src="gap"), 'SELECT user_id, min(d) AS start, max(d) + 1 AS "end" FROM isl GROUP BY user_id, g'),
    "refresh_gaps": _q(_BARS + ", lim AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY ticker)", "SELECT ticker, 'leading' AS gap, DATE '1994-12-01' AS gap_start, lo - 1 AS gap_end FROM lim WHERE lo > DATE '1994-12-01' UNION ALL SELECT ticker, 'forward', hi + 1, DATE '2003-01-01' FROM lim WHERE hi < DATE '2003-01-01'"),
    "merge_keep_last": _q(_BARS, "SELECT ticker, date, round(CASE WHEN date >= DATE '1999-06-01' THEN close * 2 ELSE close END, 6) AS close FROM bars"),
    "checksums": "SELECT p_size, count(*) AS n, sha256(concat_ws('|', count(*)::VARCHAR, " + ", ".join(f"(sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT) % 4294967296)::BIGINT::VARCHAR" for i in range(8)) + ")) AS digest FROM (SELECT DISTINCT p_size, sha256(length(p_brand) || ':' || p_brand) AS d FROM part) GROUP BY p_size",
    "universe_normalised": _q(_EXPORT, "SELECT * FROM uni"),
    "industry_counts": _q(_EXPORT, "SELECT industry, count(*) AS n FROM uni WHERE eligible AND industry <> '' GROUP BY industry"),
    "industry_query": _q(_EXPORT, "SELECT symbol, industry, market_cap FROM uni WHERE eligible AND contains(regexp_replace(lower(industry), '[^a-z0-9]+', '-', 'g'), (SELECT regexp_replace(lower(min(industry)), '[^a-z0-9]+', '-', 'g') FROM uni)) ORDER BY market_cap DESC, symbol LIMIT 5"),
    "universe_screen": _q(_EXPORT, "SELECT own AS symbol, name, market_cap FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY place) AS k FROM raw WHERE country = 'France' AND market_cap >= 1000 AND NOT (lower(name) LIKE '%warrant%' OR lower(name) LIKE '%right%' OR lower(name) LIKE '%unit%' OR lower(name) LIKE '%preferred%')) WHERE k = 1 ORDER BY market_cap DESC, symbol LIMIT 50"),
    "universe_edit": "SELECT ticker, row_number() OVER (ORDER BY p) - 1 AS place FROM (SELECT ticker, min(p) AS p FROM (SELECT n_name AS ticker, n_nationkey AS p FROM nation UNION ALL SELECT 'ATLANTIS', 1000 UNION ALL SELECT 'FRANCE', 1001) WHERE ticker <> 'JAPAN' GROUP BY ticker) QUALIFY row_number() OVER (ORDER BY p) <= 20",
    "liquidity_reasons": _q(_BARS + ", st AS (SELECT ticker, median(close * volume) FILTER (k <= 60) AS median_dollar_volume, max(close) FILTER (k = 1) AS last_close, count(*) AS history_days FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) GROUP BY ticker), rs AS (SELECT *, concat_ws('; ', CASE WHEN NOT ticker < 'M' THEN 'off theme' END, CASE WHEN history_days < 357 THEN printf('insufficient history (%dd)', history_days) END, CASE WHEN last_close < 1000 THEN printf('price below floor (%.2f)', last_close) END, CASE WHEN median_dollar_volume < 300000 THEN printf('dollar_volume below floor (%.0f)', median_dollar_volume) END) AS reason FROM st)", "SELECT ticker, " + _rounded("median_dollar_volume", "last_close") + ", history_days, reason = '' AS included, reason FROM rs"),
    "theme_scope": "SELECT p_partkey, themes, p_brand = 'Brand#1' OR themes <> '' AS in_scope FROM (SELECT p_partkey, p_brand, concat_ws('|', CASE WHEN regexp_matches(t, '\\b(steel|tin|copper)s?\\b') THEN 'metal' END, CASE WHEN regexp_matches(t, '\\b(ring|bolt|gear)s?\\b') THEN 'shape' END, CASE WHEN regexp_matches(t, '\\b(large|small)s?\\b') THEN 'size' END) AS themes FROM (SELECT *, lower(p_name || ' ' || p_type) AS t FROM part))",
    "universe_sync": _q(_MANIFEST, "SELECT coalesce(a.symbol, b.symbol) AS symbol, " + ", ".join(f"CASE WHEN b.k IS NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in ("name", "sector", "industry", "country", "ipo_year")) + ", round(CASE WHEN b.k IS NULL THEN a.market_cap ELSE b.market_cap END, 6) AS market_cap, CASE WHEN a.k IS NULL THEN DATE '2024-02-15' ELSE DATE '2024-01-15' END AS discovered_at, CASE WHEN a.k IS NULL THEN DATE '2024-02-15' ELSE greatest(DATE '2018-01-01', coalesce(make_date(a.ipo_year, 1, 1), DATE '2018-01-01')) END AS effective_from, CASE WHEN b.k IS NULL THEN DATE '2024-01-15' ELSE DATE '2024-02-15' END AS last_seen, b.k IS NOT NULL AS active, 'snapshot' AS source FROM a FULL JOIN b ON a.symbol = b.symbol"),
    "snapshot_retention": _q(_MANIFEST, "SELECT count(*) AS previous, count(b.k) AS retained, round(count(b.k) / count(*), 6) AS share FROM a LEFT JOIN b ON a.symbol = b.symbol"),
    "membership_mask": _q(_PANEL + ", eff AS (SELECT min(date) + 700 AS e FROM panel)", "SELECT ticker, date, date >= e AS member, round(CASE WHEN date >= e THEN close END, 6) AS close FROM panel, eff"),
    "set_changes": _q(_MANIFEST, "SELECT symbol, 'added' AS change FROM (SELECT symbol FROM b EXCEPT SELECT symbol FROM a) UNION ALL SELECT symbol, 'removed' FROM (SELECT symbol FROM a EXCEPT SELECT symbol FROM b) UNION ALL SELECT symbol, 'kept' FROM (SELECT symbol FROM a INTERSECT SELECT symbol FROM b)"),
    "top_strength": None,
}
_SIGNALS = _GROUP + f", gf AS (SELECT date, breadth_above_ma20 AS br, {_roll('product(1 + {})', 'group_excess_return', 20, '')} - 1 AS tr, row_number() OVER (ORDER BY date) AS k FROM kept), given AS (SELECT date, br, tr, CASE WHEN k % 7 > 0 THEN (k % 10) / 10.0 END AS p, (k % 3) / 2.0 AS bull, (k % 4) / 3.0 AS bear FROM gf), sgn AS (SELECT date, CASE WHEN p IS NULL THEN 'unavailable' WHEN p <= 0.4 AND bear >= 0.5 AND br <= 0.5 AND tr < 0 THEN 'bearish' WHEN p >= 0.6 AND bull >= 0.5 AND br >= 0.5 AND tr > 0 THEN 'bullish' ELSE 'neutral' END AS signal FROM given)"
ORACLE_SQL["signals"] = _q(_SIGNALS, "SELECT date, signal FROM sgn")
ORACLE_SQL["latest_signal"] = _q(
    _SIGNALS, "SELECT date, signal FROM sgn WHERE signal <> 'unavailable' ORDER BY date DESC LIMIT 1"
)
_RANKS = ORACLE_SQL["rank_tickers"]
ORACLE_SQL[
    "top_strength"
] = f"SELECT ticker, rise_strength_rank FROM ({_RANKS}) ORDER BY rise_strength_rank NULLS FIRST, ticker LIMIT 3"
ORACLE_SQL["alerts"] = _q(
    _SECTOR + _pairs(60)[len(_PANEL) :] + ", med AS (SELECT date, median(CASE WHEN n >= 30 THEN rho END) AS c FROM rolled WHERE k >= 60 GROUP BY date), gv AS (SELECT s.date, drawdown_60d AS d, breadth_thrust_5d AS t, c, 1 / (1 + exp(-greatest(least(-4 * coalesce(drawdown_60d, 0) + 2 * coalesce(breadth_thrust_5d, 0) + 0.3, 10), -10))) AS p FROM sector s LEFT JOIN med ON s.date = med.date)",
    "SELECT date, round(p, 6) AS probability, coalesce(d <= -0.08 AND c >= -0.05, false) AS watch, coalesce(d <= -0.08 AND c >= -0.05 AND p >= 0.6 AND t >= 0.10, false) AS triggered FROM gv",
)
ORACLE_SQL["rebound_leaders"] = _q(
    _PANEL + ", lv AS (SELECT cluster, date, avg(close) AS level FROM panel GROUP BY cluster, date), ev AS (SELECT *, " + _BOTTOM.format(x="level", by="PARTITION BY cluster", k=5, h=20, r=0.05) + """ AS bottom, lead(level, 20) OVER (PARTITION BY cluster ORDER BY date) / level - 1 AS ahead FROM lv), ty AS (SELECT cluster, median(ahead) AS typical FROM ev WHERE bottom AND level > 0 GROUP BY cluster),
  pr AS (SELECT *, lead(close, 5) OVER t / close - 1 AS r5, lead(close, 10) OVER t / close - 1 AS r10, lead(close, 20) OVER t / close - 1 AS r20, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS fut FROM panel WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  evt AS (SELECT p.*, typical, CASE WHEN peak > 0 AND close / peak - 1 < 0 THEN r20 / abs(close / peak - 1) END AS eff, CASE WHEN peak > 0 THEN nullif(coalesce(list_position(list_transform(fut, lambda x: coalesce(x >= peak, false)), true), 0), 0) - 1 END AS days FROM pr p JOIN ev ON ev.cluster = p.cluster AND ev.date = p.date AND ev.bottom JOIN ty ON ty.cluster = p.cluster WHERE p.close > 0 AND len(fut) = 20),
  ag AS (SELECT cluster, ticker, count(*) AS events, median(r5) AS m5, median(r10) AS m10, median(r20) AS m20, median(eff) AS e, avg(CASE WHEN r20 > typical THEN 1.0 ELSE 0.0 END) AS c, coalesce(median(days), -1) AS d, median(r20) / nullif(any_value(typical), 0) AS ratio FROM evt GROUP BY cluster, ticker)""",
    "SELECT cluster, ticker, events, round(m5, 6) AS median_rebound_5d, round(m10, 6) AS median_rebound_10d, round(m20, 6) AS median_rebound_20d, round(e, 6) AS recovery_efficiency, round(c, 6) AS consistency, d AS median_days_to_recover, round(ratio, 6) AS rebound_ratio_20d, CASE WHEN events >= 3 THEN row_number() OVER (PARTITION BY cluster, events >= 3 ORDER BY ratio DESC NULLS LAST, c DESC NULLS LAST, ticker) END AS rank_in_cluster FROM ag",
)
_SCREEN = _ALARM + _ADX[len(_BARS) :] + ", " + _score(20, "a20") + ", " + _score(60, "a60") + _GROUPED[len(_PANEL) :] + ", lastd AS (SELECT * FROM both_ WHERE date IN (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 120)), " + _drawdown("lastd") + ", cap AS (SELECT cluster, ticker, avg(CASE WHEN g > 0 THEN log_ret END) / avg(CASE WHEN g > 0 THEN g END) - avg(CASE WHEN g < 0 THEN log_ret END) / avg(CASE WHEN g < 0 THEN g END) AS spread FROM lastd WHERE log_ret IS NOT NULL AND g IS NOT NULL GROUP BY cluster, ticker), newest AS (SELECT ticker, alarm, washout, fired FROM al QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"
ORACLE_SQL["screen"] = _r(
    _SCREEN.replace(
        "JOIN region ON n_regionkey = r_regionkey)",
        "JOIN region ON n_regionkey = r_regionkey WHERE CAST(date_trunc('week', l_shipdate) AS DATE) <= DATE '2001-06-30')",
    ),
    "SELECT a.ticker, round(a.score, 6) AS short_score, round(b.score, 6) AS mid_score, round(a.r2, 6) AS short_r2, round(b.r2, 6) AS mid_r2, round(b.adx, 6) AS adx, b.ma_stack, cap.cluster, round(spread, 6) AS capture_spread, round(max_drawdown, 6) AS max_drawdown, recovery_days, rank() OVER (PARTITION BY cap.cluster ORDER BY spread DESC) AS rank_in_cluster, round(alarm, 6) AS alarm, round(washout, 6) AS washout, fired FROM a20 a JOIN a60 b ON a.ticker = b.ticker JOIN cap ON cap.ticker = a.ticker JOIN dd ON dd.ticker = a.ticker JOIN newest n ON n.ticker = a.ticker WHERE a.ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 65)",
)


def _near(source: str, keys: str, tolerance: int, name: str) -> str:
    """Counts of signals (s) against labels by keys, from source (keys, ticker, p, s, label)."""
    k = keys.split(", ")
    same = " AND ".join(f"l.{c} = x.{c}" for c in [*k, "ticker"])
    return f"""{name}n AS (SELECT {", ".join("x." + c for c in k)}, x.ticker, x.p, l.p AS lp, row_number() OVER (PARTITION BY {", ".join("x." + c for c in k)}, x.ticker, x.p ORDER BY abs(l.p - x.p), l.p) AS j FROM {source} x LEFT JOIN {source} l ON {same} AND l.label WHERE x.s),
      {name}s AS (SELECT {keys}, count(*) AS signals, count(*) FILTER (abs(lp - p) <= {tolerance}) AS tp, count(DISTINCT CASE WHEN abs(lp - p) <= {tolerance} THEN ticker || '|' || lp END) AS ml, avg(CASE WHEN abs(lp - p) <= {tolerance} THEN lp - p END) AS lead FROM {name}n WHERE j = 1 GROUP BY ALL),
      {name} AS (SELECT {", ".join("b." + c for c in k)}, labels, coalesce(signals, 0) AS signals, coalesce(tp, 0) AS true_positives, coalesce(ml, 0) AS matched_labels, lead AS mean_lead_days, coalesce(tp / nullif(signals, 0), 0) AS precision, coalesce(ml / nullif(labels, 0), 0) AS recall FROM (SELECT {keys}, count(*) FILTER (label) AS labels FROM {source} GROUP BY ALL) b LEFT JOIN {name}s s ON {" AND ".join(f"s.{c} = b.{c}" for c in k)})"""


_F1 = "coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0)"
_BACKTEST = (
    _ALARM + ", sig AS (SELECT ticker, date, washout, alarm, confirmed, " + _BOTTOM.format(x="close", by="PARTITION BY ticker", k=5, h=20, r=0.05) + " AS label FROM al), " + _FOLDS
    + ", fit AS (SELECT fold, gate, ticker, label, washout > -0.5 AND alarm > gate AND confirmed AS s, row_number() OVER (PARTITION BY fold, gate, ticker ORDER BY date) AS p FROM sig, folds, (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0])::DOUBLE AS gate) WHERE date BETWEEN fit_start AND fit_end), "
    + _near("fit", "fold, gate", 5, "gt") + f", best AS (SELECT fold, gate FROM gt QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {_F1} DESC, gate) = 1)"
    + ", tst AS (SELECT f.fold, ticker, label, washout > -0.5 AND alarm > gate AND confirmed AS s, row_number() OVER (PARTITION BY f.fold, ticker ORDER BY date) AS p FROM sig, folds f JOIN best ON best.fold = f.fold WHERE date BETWEEN test_start AND test_end), "
    + _near("tst", "fold", 5, "tr")
)
ORACLE_SQL["backtest_folds"] = _r(
    _BACKTEST,
    f"SELECT f.*, gate, labels, signals, true_positives, matched_labels, round(mean_lead_days, 6) AS mean_lead_days, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM folds f JOIN best ON best.fold = f.fold LEFT JOIN tr ON tr.fold = f.fold",
)

_TESTED = _BACKTEST + f", fw AS (SELECT ticker, date, fired, {_FORWARD} FROM (SELECT ticker, date, close, washout > -0.5 AND alarm > gate AND confirmed AS fired FROM al, folds f JOIN best ON best.fold = f.fold WHERE date BETWEEN test_start AND test_end) WINDOW t AS (PARTITION BY ticker ORDER BY date)), smp AS (SELECT h AS horizon, v AS value FROM (SELECT unnest([5, 10, 20]) AS h, unnest([h5, h10, h20]) AS v FROM fw WHERE fired) WHERE v IS NOT NULL), ecos AS (SELECT h::INT AS horizon, coalesce(n, 0) AS n, mean_return, median_return, hit_rate FROM (SELECT unnest([5, 10, 20]) AS h) LEFT JOIN (SELECT horizon, {_ECON} FROM smp GROUP BY horizon) ON horizon = h)"
ORACLE_SQL["backtest_economics"] = _r(
    _TESTED, "SELECT horizon, n, " + _rounded("mean_return", "median_return", "hit_rate") + " FROM ecos"
)
ORACLE_SQL["backtest_edges"] = _r(
    _TESTED + ", " + _drawn(50) + f", bsm AS (SELECT h AS horizon, v AS value FROM (SELECT unnest([5, 10, 20]) AS h, unnest([h5, h10, h20]) AS v FROM drw) WHERE v IS NOT NULL), chance AS (SELECT h::INT AS horizon, coalesce(n, 0) AS n, mean_return, median_return, hit_rate FROM (SELECT unnest([5, 10, 20]) AS h) LEFT JOIN (SELECT horizon, {_ECON} FROM bsm GROUP BY horizon) ON horizon = h)",
    "SELECT o.horizon, o.n, " + ", ".join(f"round(o.{c}, 6) AS {c}" for c in ("mean_return", "median_return", "hit_rate")) + ", c.n AS n_baseline, " + ", ".join(f"round(c.{c}, 6) AS {c}_baseline" for c in ("mean_return", "median_return", "hit_rate")) + ", round(o.mean_return - c.mean_return, 6) AS mean_edge, round(o.hit_rate - c.hit_rate, 6) AS hit_rate_edge FROM ecos o JOIN chance c ON o.horizon = c.horizon",
)

_THEMED = "concat_ws('|', CASE WHEN regexp_matches(t, '\\b(steel|tin|copper)s?\\b') THEN 'metal' END, CASE WHEN regexp_matches(t, '\\b(ring|bolt|gear)s?\\b') THEN 'shape' END, CASE WHEN regexp_matches(t, '\\b(large|small)s?\\b') THEN 'size' END)"
_SYMBOLS = "syms AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'Tin Gear ' ELSE '' END || s_name || CASE WHEN s_suppkey % 9 = 0 THEN ' Warrant' ELSE '' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' END AS exchange, s_suppkey % 11 = 0 AS etf FROM supplier)"
ORACLE_SQL["universe_built"] = _q(
    _SYMBOLS + """, sb AS (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
  liq AS (SELECT ticker, median(close * volume) FILTER (k <= 60) AS dv, max(close) FILTER (k = 1) AS lc, count(*) AS hd FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM sb) GROUP BY ticker),
  prof AS (SELECT 'S' || p_partkey AS ticker, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS long_name, p_brand AS industry, p_type AS summary FROM part WHERE p_partkey % 3 <> 0),
  mrg AS (SELECT s.ticker, CASE WHEN coalesce(long_name, '') <> '' THEN long_name ELSE name END AS name, coalesce(industry, '') AS industry, coalesce(summary, '') AS summary, coalesce(exchange, '') AS exchange, coalesce(dv, 0) AS dv, coalesce(lc, 0) AS lc, coalesce(hd, 0) AS hd FROM syms s LEFT JOIN prof p ON p.ticker = s.ticker LEFT JOIN liq l ON l.ticker = s.ticker),
  thm AS (SELECT *, """ + _THEMED + """ AS themes FROM (SELECT *, lower(name || ' ' || summary) AS t FROM mrg)),
  why AS (SELECT *, concat_ws('; ', CASE WHEN NOT (industry IN ('Brand#1', 'Brand#23') OR themes <> '') THEN 'off theme' END, CASE WHEN hd < 160 THEN printf('insufficient history (%dd)', hd) END, CASE WHEN lc < 1400 THEN printf('price below floor (%.2f)', lc) END, CASE WHEN dv < 60000 THEN printf('dollar_volume below floor (%.0f)', dv) END) AS reason FROM thm)""",
    "SELECT ticker, name, industry, themes, exchange, round(dv, 3) AS median_dollar_volume, round(lc, 9) AS last_close, hd AS history_days, reason = '' AS included, reason FROM why",
)
ORACLE_SQL["enrichment_candidates"] = _q(
    _SYMBOLS,
    "SELECT ticker, name, exchange FROM (SELECT *, lower(name) AS t FROM syms) WHERE CASE WHEN ticker IN ('S11', 'S22') THEN true WHEN etf THEN false WHEN regexp_matches(name, '(?i)\\b(warrant|right|unit|preferred|notes\\s+due)s?\\b') THEN false WHEN ticker IN ('S5', 'S9', 'S33') THEN true ELSE " + _THEMED + " <> '' END",
)
ORACLE_SQL["day_files"] = _q(
    _BARS,
    "SELECT ticker, date, round(CAST(CAST(close AS FLOAT) AS DOUBLE), 3) AS close, round(CAST(CAST(volume AS FLOAT) AS DOUBLE), 3) AS volume FROM bars WHERE ticker IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_24') AND date BETWEEN DATE '1995-01-02' AND DATE '1997-06-30'",
)
_SPLITS = "; ".join(("l_quantity", "l_discount", "l_tax", "l_linenumber"))
ORACLE_SQL["large_split"] = (
    "WITH li AS (SELECT l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), vals AS ("
    + " UNION ALL ".join(f"SELECT {i} AS j, '{c}' AS feature, {c} AS v, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM li GROUP BY {c}" for i, c in enumerate(_SPLITS.split("; ")))
    + "), cum AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY j) AS gt, sum(h) OVER (PARTITION BY j) AS ht, lead(v) OVER (PARTITION BY j ORDER BY v) AS nv FROM vals WINDOW w AS (PARTITION BY j ORDER BY v ROWS UNBOUNDED PRECEDING)),"
    + " gains AS (SELECT *, (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2 AS gain FROM cum WHERE nv IS NOT NULL AND hl >= 1 AND ht - hl >= 1)"
    + " SELECT feature, round((v + nv) / 2, 6) AS cut, round(gain, 6) AS gain, round(-gl / (hl + 1), 6) AS left_weight, round(-(gt - gl) / (ht - hl + 1), 6) AS right_weight FROM gains WHERE gain > 1e-12 ORDER BY gain DESC, j, v LIMIT 1"
)
ORACLE_SQL["newest_listing"] = "SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100"
