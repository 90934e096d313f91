"""Parameters of the plans, from defaults, a file and a profile."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path


def bounded(
    what: str,
    value: float | None,
    low: float | None = None,
    high: float | None = None,
    above: float | None = None,
    below: float | None = None,
) -> None:
    """An error unless low <= value <= high and above < value < below, as far as these are given. None is no value."""
    if value is None:
        return
    if (low is not None and value < low) or (high is not None and value > high) or (
        above is not None and value <= above
    ) or (below is not None and value >= below):
        limits = [f"{sign} {v}" for sign, v in ((">=", low), ("<=", high), (">", above), ("<", below)) if v is not None]
        raise ValueError(f"{what} must be {' and '.join(limits)}, not {value}")


@dataclass(frozen=True)
class Features:
    """Windows of the group features, in rows."""

    beta: int = 60
    correlation: int = 60
    volatility: int = 20
    component: int = 126
    least_coverage: float = 0.80

    def __post_init__(self):
        bounded("features.beta", self.beta, 20)
        bounded("features.correlation", self.correlation, 20)
        bounded("features.volatility", self.volatility, 5)
        bounded("features.component", self.component, 60)
        bounded("features.least_coverage", self.least_coverage, above=0, high=1)


@dataclass(frozen=True)
class Regimes:
    """Hidden Markov models: states, rows before the first fit, rows between fits."""

    states: int = 3
    least: int = 252
    refit: int = 21

    def __post_init__(self):
        bounded("regimes.states", self.states, 2, 6)
        bounded("regimes.least", self.least, 126)
        bounded("regimes.refit", self.refit, 1)


@dataclass(frozen=True)
class Boosting:
    """The boosted classifier."""

    horizon: int = 20
    least: int = 504
    refit: int = 21
    trees: int = 400
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.8
    columns: float = 0.8

    def __post_init__(self):
        bounded("boosting.horizon", self.horizon, 1)
        bounded("boosting.least", self.least, 126)
        bounded("boosting.refit", self.refit, 1)
        bounded("boosting.trees", self.trees, 10)
        bounded("boosting.depth", self.depth, 1, 10)
        for name in ("rate", "rows", "columns"):
            bounded(f"boosting.{name}", getattr(self, name), above=0, high=1)


@dataclass(frozen=True)
class Signals:
    """Bounds of probability, regime and breadth of a signal."""

    high: float = 0.60
    low: float = 0.40
    regime: float = 0.50
    wide: float = 0.60
    narrow: float = 0.40

    def __post_init__(self):
        bounded("signals.high", self.high, above=0.5, below=1)
        bounded("signals.low", self.low, above=0, below=0.5)
        bounded("signals.regime", self.regime, above=0, below=1)
        bounded("signals.wide", self.wide, above=0.5, high=1)
        bounded("signals.narrow", self.narrow, 0, below=0.5)


@dataclass(frozen=True)
class Universe:
    """What a snapshot's group takes."""

    industries: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    sector: str | None = None
    least_cap: float = 0.0
    most: int | None = None
    least_retention: float = 0.80

    def __post_init__(self):
        bounded("universe.least_cap", self.least_cap, 0)
        bounded("universe.most", self.most, 2)
        bounded("universe.least_retention", self.least_retention, above=0, high=1)


@dataclass(frozen=True)
class Request:
    """A sector analysis as it is asked for: a group, a range of days, and its windows and bounds. Percentages are of 100."""

    industry: str = "semiconductor"
    start: str | None = None
    end: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    tail_days: int = 0
    most_tickers: int | None = None
    short: int = 20
    mid: int = 60
    long: int = 200
    correlation: int = 60
    component: int = 60
    states: int = 3
    capture: int = 60
    horizon: int = 10
    target_pct: float = 5.0
    adverse_pct: float = -3.0
    correction_pct: float = -8.0
    least_correlation: float = 0.55
    least_probability: float = 0.70
    least_thrust_pct: float = 10.0
    least_coverage_pct: float = 80.0

    #: The least and most of each number.
    BOUNDS = {
        "tail_days": (0, 90), "most_tickers": (3, 250), "short": (5, 63), "mid": (20, 126), "long": (60, 252), "correlation": (20, 252),
        "component": (40, 252), "states": (2, 6), "capture": (20, 252), "horizon": (5, 40), "target_pct": (2, 15), "adverse_pct": (-10, -1),
        "correction_pct": (-30, -3), "least_correlation": (0, 0.95), "least_probability": (0.5, 0.95), "least_thrust_pct": (5, 40), "least_coverage_pct": (70, 100),
    }

    def __post_init__(self):
        for name, (low, high) in self.BOUNDS.items():
            bounded(name, getattr(self, name), low, high)
        if not re.fullmatch(r"[A-Za-z0-9_:.-]+", self.industry):
            raise ValueError(f"{self.industry!r} names no industry")
        first, last = (date.fromisoformat(d) if d else None for d in (self.start, self.end))
        if first and last and first >= last:
            raise ValueError("start must be before end, which is exclusive")
        if last and last > datetime.now(UTC).date() + timedelta(days=1):
            raise ValueError("end, which is exclusive, can't be later than tomorrow")
        if not self.short < self.mid <= self.long:
            raise ValueError("windows must be short < mid <= long")
        if self.target_pct <= -self.adverse_pct:
            raise ValueError("the target must exceed the adverse return")
        for name in ("include", "exclude"):
            cleaned = tuple(t.strip().upper() for t in getattr(self, name) if t.strip())
            if len(cleaned) > 50:
                raise ValueError(f"at most 50 tickers to {name}")
            object.__setattr__(self, name, cleaned)
        if both := sorted(set(self.include) & set(self.exclude)):
            raise ValueError(f"{both} can't be both included and excluded")


@dataclass(frozen=True)
class Windows:
    short: int = 20
    mid: int = 60
    long: int = 120

    def __post_init__(self):
        if not 2 <= self.short < self.mid <= self.long:
            raise ValueError("windows must be 2 <= short < mid <= long")


@dataclass(frozen=True)
class Backtest:
    start: str = "2010-01-01"
    end: str = "2026-01-01"
    initial_years: int = 5
    step_years: int = 1
    half_window: int = 10
    ahead: int = 20
    least_return: float = 0.08
    horizons: tuple[int, ...] = (5, 10, 20)
    gates: tuple[float, ...] = (40, 50, 55, 60, 65, 70, 80)
    draws: int = 50


@dataclass(frozen=True)
class Config:
    windows: Windows = field(default_factory=Windows)
    backtest: Backtest = field(default_factory=Backtest)
    features: Features = field(default_factory=Features)
    regimes: Regimes = field(default_factory=Regimes)
    boosting: Boosting = field(default_factory=Boosting)
    signals: Signals = field(default_factory=Signals)
    universe: Universe = field(default_factory=Universe)
    threshold: float = 0.60
    least_cluster: int = 3
    washout_gate: float = 0.5
    alarm_gate: float = 60.0
    benchmark: str | None = None

    def __post_init__(self):
        if not -1 < self.threshold < 1 or self.least_cluster < 2:
            raise ValueError("threshold must be in (-1, 1) and clusters have two tickers at least")


def _merged(base: dict, more: dict) -> dict:
    """more over base, level by level."""
    return base | {
        k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()
    }


def load(path: str | None = None, profile: str | None = None) -> Config:
    """A JSON or YAML file with ``defaults`` and profiles; a profile goes over the defaults, unknown keys are errors."""
    config = Config()
    if path is None:
        return config
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    return _made(Config, asdict(config), _merged(raw.get("defaults", {}), raw.get(profile, {}) if profile else {}))


def _made(kind: type, base: dict, more: dict):
    """A dataclass of its defaults and what is given, level by level; lists become tuples."""
    known = {f.name: getattr(kind(), f.name) for f in fields(kind)}
    if unknown := set(more) - set(known):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    own = {
        k: _made(type(v), base[k], more.get(k, {})) if is_dataclass(v) else more.get(k, base[k])
        for k, v in known.items()
    }
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


def request(values: dict) -> Request:
    """A request from a dictionary, such as a parsed JSON body; unknown names are errors."""
    return _made(Request, asdict(Request()), values)


def shifted(day: date, years: int) -> date:
    """The same day so many years later (earlier, if negative); 29 February becomes the 28th in a year without it."""
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)
