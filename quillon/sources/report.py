"""Results as files: CSV for each table, JSON and Markdown summaries, a page."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of a report have a row a ticker or a date; a table with more isn't collected.
MOST_ROWS = 100_000


def _rows(frame: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in frame.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("the table is too large for a report")
    return [{k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in r.items()} for r in rows]


def write_csvs(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV for each table, by the cluster."""
    for name, frame in tables.items():
        flat = frame.selectExpr(
            *[
                f"`{c}`" if not t.startswith(("array", "struct", "map")) else f"to_json(`{c}`) AS `{c}`"
                for c, t in frame.dtypes
            ]
        )
        flat.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def write_json(frame: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(_rows(frame), indent=2, sort_keys=True, default=str))


def markdown(frame: DataFrame, title: str) -> str:
    rows, names = _rows(frame), frame.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    return "\n".join(
        [
            *lines,
            *(
                "| " + " | ".join(
                    "" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]) for c in names
                ) + " |"
                for r in rows
            ),
        ]
    ) + "\n"


def newest(frame: DataFrame, at: str, tie: str, most: int = 100) -> DataFrame:
    """The rows that came last, the newest first, at most so many; of equal times the larger tie. Each task keeps its own last ones."""
    return frame.orderBy(F.desc_nulls_last(at), F.desc_nulls_last(tie)).limit(most)


def trend_label(score: float) -> str:
    return "strong up" if score >= 1 else "strong down" if score <= -1 else "mixed"


def page(tables: dict[str, DataFrame], title: str) -> str:
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, frame in tables.items():
        cells = "".join(
            "<tr>" + "".join(
                f"<td>{html.escape('' if r[c] is None else str(r[c]))}</td>" for c in frame.columns
            ) + "</tr>"
            for r in _rows(frame)
        )
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in frame.columns)}</tr>{cells}</table>")
    return "".join([*parts, "</body></html>"])
