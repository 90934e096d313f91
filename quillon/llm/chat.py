"""Chat formatting: a hidden Markov model recovers the turns of a transcript from its lines by Viterbi, then turns are rendered.

A hidden state is a role, and whether the line opens a turn of that role or goes on with it. A line shows a speaker marker (a usual name of a
role before a colon, or alone in brackets and the like; or none) and features: whether a piece of the transcript begins with it, its length
and its ending. Probabilities are learned by counting lines whose marker is sure, and those that follow them in their piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, small_batches, written

ROLES = ("system", "user", "assistant")
#: Usual names of the roles.
NAMES = {"system": ("system", "developer", "instructions"), "user": ("user", "human", "customer", "question", "q", "prompter"), "assistant": ("assistant", "ai", "bot", "model", "gpt", "agent", "answer", "a")}
_NUMBER = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
#: How often a marker is wrong, or stands in the middle of a turn.
MARKER_ERROR = 0.01
#: State i opens a turn of role i, state i + 3 goes on with it.
_N = len(ROLES)
_STATES, _LENGTHS, _ENDINGS = 2 * _N, (1, 12, 40, 120), 3
_SHAPES = 2 * (len(_LENGTHS) + 1) * _ENDINGS
_NEVER = -1e6  # the logarithm for what can't be
_BLOCK_BITS = 10  # lines of a block
_NAMED = re.compile(r"\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?([A-Za-z]{1,12})(?:\]|\|?>|\*\*)?\s*:(?:\*\*)?\s*")
_ALONE = re.compile(r"\s*(?:#{1,4}\s*|\[|<\|?|\*\*)([A-Za-z]{1,12})(?:\]|\|?>|\*\*)?\s*$")


def marker_of(line: str) -> tuple[int, str]:
    """The number of the role that the line's marker names (3: it has none), and the line without it."""
    for pattern in (_ALONE, _NAMED):
        if (m := pattern.match(line)) and m[1].lower() in _NUMBER:
            return _NUMBER[m[1].lower()], line[m.end() :]
    return _N, line


def shape_of(rest: str, begins: bool) -> int:
    words = len(rest.split())
    length = sum(words >= n for n in _LENGTHS)
    last = rest.rstrip()[-1:]
    ending = 0 if last == "?" else 1 if last in (":", ",", ";") else 2
    return (int(begins) * (len(_LENGTHS) + 1) + length) * _ENDINGS + ending


def parsed(text: str | None) -> list[tuple[int, str, int, int, int | None]]:
    """For each line: its number, its text without marker, marker, shape, and the state that is sure from markers (None: it isn't)."""
    out, now = [], None
    for i, line in enumerate(re.split(r"\r?\n", text or "")):
        marker, rest = marker_of(line)
        if marker < _N:
            now = marker
        state = None if now is None else now if marker < _N else now + _N
        out.append((i, rest, marker, shape_of(rest, i == 0), state))
    return out


_LINES = "none boolean, conv long, turn long, tie long, line int, text string, marker int, shape int, state int, prior int, final int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("turn", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("text", pa.string()), *[(c, pa.int32()) for c in ("marker", "shape", "state", "prior", "final")]])
    for batch in batches:
        rows: list[tuple] = []
        for *key, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            lines = parsed(text)
            final = lines[-1][4]
            rows += [(*key, *line, lines[i - 1][4] if i else None, final) for i, line in enumerate(lines)]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class RoleModel:
    """Logarithms of probabilities: start (state), step (from, to), shape (state, shape), marker (state, marker)."""

    start: np.ndarray
    step: np.ndarray
    shape: np.ndarray
    marker: np.ndarray

    def emission(self, markers: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return (self.marker[:, markers] + self.shape[:, shapes]).T


def learn(lines: DataFrame) -> RoleModel:
    """Counts over lines whose state is sure, smoothed by one. A piece follows the one with the number before.

    What comes to the driver is a row for each pair of states and for each state and shape. Without lines, all is equally likely.
    """
    sure = lines.where("state is not null")
    shape = np.ones((_STATES, _SHAPES))
    for r in sure.groupBy("state", "shape").count().collect():
        shape[r["state"], r["shape"]] += r["count"]
    step = np.ones((_STATES, _STATES))
    for r in sure.where("prior is not null").groupBy("prior", "state").count().collect():
        step[r["prior"], r["state"]] += r["count"]
    # each piece and the one after meet under the number of the latter; copies count once
    begins = lines.where("line = 0")
    pieces = begins.where("turn is not null").groupBy("none", "conv", "turn").agg(F.max("state").alias("first"), F.max("final").alias("final"))
    before = pieces.select("none", "conv", (F.col("turn") + 1).alias("turn"), F.col("final").alias("prior"))
    for r in pieces.join(before, ["none", "conv", "turn"]).where("first is not null and prior is not null").groupBy("prior", "first").count().collect():
        step[r["prior"], r["first"]] += r["count"]
    start = np.ones(_N)
    firsts = pieces.groupBy("none", "conv").agg(F.min_by("first", "turn").alias("first")).where(F.col("first") < _N)
    for r in firsts.groupBy("first").count().collect():
        start[r["first"]] += r["count"]
    shown = {bool(r["shown"]): r["count"] for r in begins.groupBy((F.col("marker") < _N).alias("shown")).count().collect()}
    hidden = (1 + shown.get(False, 0)) / (2 + sum(shown.values()))
    marker = np.full((_STATES, _N + 1), MARKER_ERROR / _N)
    marker[:, _N] = [hidden] * _N + [1 - MARKER_ERROR] * _N
    marker[range(_N), range(_N)] = max(1 - hidden - MARKER_ERROR, MARKER_ERROR)
    logs = [np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, step, shape, marker)]
    # a conversation begins with a turn, and only a role's own turn goes on
    logs[0] = np.concatenate([logs[0], np.full(_N, _NEVER)])
    for a in range(_STATES):
        for role in range(_N):
            if a % _N != role:
                logs[1][a, role + _N] = _NEVER
    return RoleModel(*logs)


def best_path(entry: np.ndarray, emission: np.ndarray, step: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Viterbi over lines with the scores of all before in ``entry`` (by first state) and of all after in ``leave`` (by last state)."""
    score, back = entry + emission[0], []
    for e in emission[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    states = [int((score + leave).argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1])


def block_scores(emission: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best score of a block of lines from each first to each last state."""
    n = step.shape[0]
    score = np.where(np.eye(n, dtype=bool), emission[0][:, None], -np.inf)
    for e in emission[1:]:
        score = (score[:, :, None] + step[None]).max(axis=1) + e
    return score


def _runs(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """The conversations of a block in order, and whether each is its first or its last."""
    frame = frame.sort_values("at")
    conv, none = frame["conv"].to_numpy(), frame["none"].to_numpy()
    edges = [0, *(np.flatnonzero((conv[1:] != conv[:-1]) | (none[1:] != none[:-1])) + 1), len(frame)]
    for a, b in zip(edges, edges[1:]):
        yield frame.iloc[a:b], a == 0, b == len(frame)


def _chained(model: RoleModel) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        scores = [np.array(s).reshape(_STATES, _STATES) for s in frame["scores"]]
        entry, leave = [model.start], [np.zeros(_STATES)]
        for s in scores[:-1]:
            entry.append(((entry[-1][:, None] + s).max(axis=0)[:, None] + model.step).max(axis=0))
        for s in scores[:0:-1]:
            leave.append((model.step + (s + leave[-1]).max(axis=1)).max(axis=1))
        return pd.DataFrame({"none": frame["none"].to_numpy(), "conv": frame["conv"].to_numpy(), "block": frame["block"].to_numpy(), "entry": [e.tolist() for e in entry], "leave": [x.tolist() for x in leave[::-1]]})

    return chain


def decode(pieces: DataFrame, model: RoleModel | None = None) -> DataFrame:
    """The lines of transcripts in order: none, conv, turn, line, text (without marker), at, state, turn_at. A written table.

    pieces: conv_id, turn, text; a piece is a line, a turn or a whole transcript. at numbers all lines in order; turn_at is that of the line that
    opens the line's turn. Lines are dealt into blocks of at most 1,024. A block holds many conversations, or a part of one: then each part's best
    scores from state to state are chained in a pass over the parts, and each part is decoded with the scores of all before and after. So a
    conversation of any length is decoded exactly, and no task holds more than a block, but for the chain of one conversation's parts
    (36 numbers for 1,024 lines).
    """
    small_batches(pieces.sparkSession)
    conv, text = F.col("conv_id").cast("long"), F.col("text").cast("string")
    slim = pieces.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(text).alias("tie"), text.alias("text"))
    lines = written(slim.mapInArrow(_lines, _LINES), "lines")
    model = model or learn(lines)
    # rows that are there twice are pieces of their own: their number keeps their lines apart
    key = ["none", "conv", "turn", "tie", "line"]
    order = lines.select(*key, "text", "marker", "shape").repartitionByRange(*key).sortWithinPartitions(*key)
    order = written(order.withColumn("at", F.monotonically_increasing_id()), "order").withColumn("block", F.shiftright("at", _BLOCK_BITS))
    deleted(lines)

    def emission(run: pd.DataFrame) -> np.ndarray:
        return model.emission(run["marker"].to_numpy(), run["shape"].to_numpy())

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(r["none"].iloc[0], r["conv"].iloc[0], r["block"].iloc[0], block_scores(emission(r), model.step).ravel().tolist()) for r, first, last in _runs(frame) if first or last]
        return pd.DataFrame(rows, columns=["none", "conv", "block", "scores"])

    marked = order.select("none", "conv", "at", "block", "marker", "shape")
    parts = written(marked.groupBy("block").applyInPandas(ends, "none boolean, conv long, block long, scores array<double>"), "parts")
    several = written(parts.groupBy("none", "conv").agg(F.count("*").alias("n")).where("n > 1"), "several")
    long = parts.join(several.select("none", "conv"), ["none", "conv"], "left_semi")
    chained = written(long.groupBy("none", "conv").applyInPandas(_chained(model), "none boolean, conv long, block long, entry array<double>, leave array<double>"), "chained")
    given = written(chained.groupBy("block").agg(F.collect_list(F.struct("none", "conv", "entry", "leave")).alias("given")), "given")  # two for a block at most

    def path(frame: pd.DataFrame) -> pd.DataFrame:
        known = {(g["none"], g["conv"]): (np.array(g["entry"]), np.array(g["leave"])) for g in (frame["given"].iloc[0] if frame["given"].iloc[0] is not None else ())}
        out = []
        for run, _, _ in _runs(frame):
            entry, leave = known.get((run["none"].iloc[0], run["conv"].iloc[0]), (model.start, np.zeros(_STATES)))
            out.append(pd.DataFrame({"at": run["at"], "state": best_path(entry, emission(run), model.step, leave)}))
        return pd.concat(out)

    states = written(marked.join(given, "block", "left").groupBy("block").applyInPandas(path, "at long, state int"), "states")
    deleted(parts, several, chained, given)
    both = order.join(states, "at").withColumn("opened", F.when(F.col("state") < _N, F.col("at")))
    # the last opening line of a conversation in the blocks before, where it has several
    own = Window.partitionBy("block", "none", "conv").orderBy("at")
    inside = both.withColumn("here", F.last("opened", True).over(own))
    last = inside.groupBy("none", "conv", "block").agg(F.max("opened").alias("opened"))
    earlier = F.last("opened", True).over(Window.partitionBy("none", "conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.withColumn("earlier", earlier).drop("opened")
    placed = inside.join(carried, ["none", "conv", "block"])
    out = written(placed.select("none", "conv", "turn", "line", "text", "at", "state", F.coalesce("here", "earlier", "at").alias("turn_at")), "decoded")
    deleted(order, states)
    return out


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("\n<|end|>"))


def recover(pieces: DataFrame, model: RoleModel | None = None) -> DataFrame:
    """The turns of transcripts: conv_id, turn and line where each begins, n_lines, role_pred, rendered.

    pieces has conv_id, turn (the order) and text; all else, such as a role, isn't read. A turn's lines are joined without markers and rendered as
    ``<|role|>`` line feed, text, line feed ``<|end|>``.

    Pieces are in the order of conv_id, turn and then text. Null text: an empty line. Null turn: comes first. Null conv_id: all such pieces
    are one conversation. Repeated rows: their lines stand side by side, as nothing tells them apart. Very long texts are many lines, dealt into
    blocks; a recovered turn is one row, however long. Empty table: no rows. Other columns are not read.
    """
    lines = decode(pieces, model)
    first = F.min(F.struct("at", "none", "conv", "turn", "line", "state")).alias("f")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("body")
    turns = lines.groupBy("turn_at").agg(first, F.count("*").alias("n_lines"), body)
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.pmod(F.col("f.state"), F.lit(_N)) + 1)
    conv = F.when(~F.col("f.none"), F.col("f.conv"))
    return turns.select(conv.alias("conv_id"), F.col("f.turn").alias("turn"), F.col("f.line").alias("line"), "n_lines", role.alias("role_pred"), rendered(role, F.col("body")).alias("rendered"))


def transcripts(turns: DataFrame, hidden_of_ten: int = 3) -> DataFrame:
    """conv_id, turn, text and hidden: turns (conv_id, turn, role, text) as they stand in a transcript, with the speaker's name before the text.

    In so many of ten turns, by a hash of conversation and turn, the name is left out. So are names of unknown or null roles.
    """
    hidden = F.pmod(F.xxhash64(F.lit("hidden speaker"), "conv_id", "turn"), F.lit(10)) < hidden_of_ten
    names = F.create_map(*[F.lit(x) for role, n in (("system", "System"), ("user", "Human"), ("assistant", "Assistant")) for x in (role, n)])
    name = F.when(~hidden, names[F.lower(F.trim("role"))])
    return turns.select("conv_id", "turn", F.concat(F.coalesce(F.concat(name, F.lit(": ")), F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), name.isNull().alias("hidden"))
