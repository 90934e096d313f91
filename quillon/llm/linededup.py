"""Line dedup: a suffix array over line ids by distributed prefix doubling finds repeated runs of lines; later copies go.

Documents are sequences of line ids. At level k, each place that begins a block of 2^k lines which occurs twice or
more has the block's rank in the order of all such blocks; ranks of level k + 1 are the order of pairs of ranks 2^k lines apart.
A block of m lines is known by the two ranks of level floor(log2 m) that cover it. So places with the same ranks are an
interval of the suffix array whose longest common prefix has m lines or more: their runs are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, fresh, give_back, small_batches, written

#: A repeated run is deleted if it has so many words.
LEAST_WORDS = 50
_PLACE = ["doc", "tie"]


def _minimal_blocks(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the least number of lines from it on, and up to it, with so many words; 0 if there are too few."""
    before = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(before, before[:-1] + least)
    ahead = np.where(end <= len(words), end - np.arange(len(words)), 0)
    begin = np.searchsorted(before, before[1:] - least, side="right") - 1
    return ahead, np.where(begin >= 0, np.arange(len(words)) + 1 - begin, 0)


def _lines_of(least: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in range(7)]
                for doc, tie, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    own = [(x, n) for x in text.encode("utf-8", "surrogatepass").split(b"\n") if (n := len(x.split()))]
                    ahead, back = _minimal_blocks(np.array([n for _, n in own], np.int64), least)
                    for place, ((line, _), a, b) in enumerate(zip(own, ahead.tolist(), back.tolist(), strict=True)):
                        h = xxhash.xxh3_128_intdigest(line)
                        for column, value in zip(columns, (doc, tie, place, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), a, b), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 2 + (pa.int32(),) + (pa.int64(),) * 2 + (pa.int32(),) * 2, strict=True)], ["doc", "tie", "place", "h1", "h2", "ahead", "back"])
        give_back()

    return lines


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows (doc, tie, place and keys) whose keys occur twice or more, with the rank of their keys in sorted order.

    The order is made by a range shuffle of the distinct keys: a rank is the partition and the place in it.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = written(repeated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "order")
    out = written(rows.join(order, keys).select(*_PLACE, "place", "rank"), name)
    deleted(order)
    return out


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of lines that have an earlier copy: doc, tie (a hash of the text), place (of lines with words), lines.

    Earlier is by id, then by tie, then by place. For each line the shortest block of ``least`` words that
    begins with it, and that ends with it, is looked up; their union is exactly what runs of ``least`` words with an
    earlier copy cover, however long. As each line has a word, blocks have at most ``least`` lines, so there are at most
    log2(least) levels.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    slim = docs.where(text.isNotNull()).select(_key(id_col).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    every = slim.mapInArrow(_lines_of(least), "doc long, tie long, place int, h1 long, h2 long, ahead int, back int")
    lines = written(every.distinct(), "lines")  # a row that is there twice is one document
    blocks = lines.select(*_PLACE, F.explode(F.array_distinct(F.array(F.struct("place", F.col("ahead").alias("lines")), F.struct((F.col("place") - F.col("back") + 1).alias("place"), F.col("back").alias("lines"))))).alias("b")).select(*_PLACE, "b.*").where("lines > 0").distinct()
    longest = lines.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0

    ranks = _ranked(lines.select(*_PLACE, "place", "h1", "h2"), ["h1", "h2"], "ranks")
    blocks = written(blocks.join(ranks.select(*_PLACE, "place"), [*_PLACE, "place"], "left_semi"), "blocks")
    deleted(lines)
    known: DataFrame | None = None
    for level in range(int(longest).bit_length()):
        width = 1 << level
        if level:
            right = ranks.select(*_PLACE, (F.col("place") - width // 2).alias("place"), F.col("rank").alias("right"))
            pairs = written(ranks.withColumnRenamed("rank", "left").join(right, [*_PLACE, "place"]), "pairs")
            deleted(ranks)
            ranks = _ranked(pairs, ["left", "right"], "ranks")
            deleted(pairs)
        own = blocks.where((F.col("lines") >= width) & (F.col("lines") < 2 * width))
        head = own.join(ranks.withColumnRenamed("rank", "head"), [*_PLACE, "place"]).withColumn("last", F.col("place") + F.col("lines") - width)
        both = head.join(ranks.select(*_PLACE, F.col("place").alias("last"), F.col("rank").alias("tail")), [*_PLACE, "last"])
        found = written(both.select(*_PLACE, "place", "lines", "head", "tail"), f"level-{level}")
        known = found if known is None else known.unionByName(found)
    deleted(ranks)
    if known is None:
        return blocks.select(*_PLACE, "place", "lines")
    interval = ["lines", "head", "tail"]
    first = written(known.groupBy(*interval).agg(F.min(F.struct(*_PLACE, "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "intervals")
    return known.join(first, interval).where(F.struct(*_PLACE, "place") != F.col("first")).select(*_PLACE, "place", "lines")


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all later copies of repeated runs of ``least`` words deleted from the text.

    Adds n_lines (lines with words, before), removed_lines and removed_words; columns of these names are
    replaced. The first copy, by id, stays, as do shorter runs. Blank lines between two deleted lines go with them.
    Null text: stays null, counts 0. Empty texts stay. Rows that share id and text are one document and are edited alike; of rows that share
    an id only, the order is by a hash of the text. Null ids come first. Very long texts are taken whole, a line a row, and so are put together
    again by one task. Empty table: no rows.
    """
    runs = repeated_runs(docs, least, id_col, text_col)
    cuts = written(runs.groupBy(*_PLACE).agg(F.collect_list(F.struct("place", "lines")).alias("cuts")), "cuts")
    rest = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_words")]
    doc, tie, cut = fresh(docs, "doc", "tie", "cuts")
    keyed = docs.select(*rest).withColumns({doc: _key(id_col), tie: F.xxhash64(F.col(text_col).cast("string"))})
    cuts = cuts.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("cuts").alias(cut))
    joined = keyed.join(cuts.hint("merge"), [doc, tie], "left").select(*rest, cut)
    at = rest.index(text_col)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, gone, lost = [], [], [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(rest)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                counts = [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]
                total = sum(n > 0 for n in counts)
                cut = np.zeros(total + 1, np.int64)
                for s in spans or ():
                    cut[s["place"]] += 1
                    cut[s["place"] + s["lines"]] -= 1
                cut = np.cumsum(cut) > 0
                kept, place, removed, dropped = [], 0, 0, False
                for line, n in zip(lines, counts, strict=True):
                    if n:
                        dropped = bool(cut[place])
                        place += 1
                        removed += n * dropped
                    if not (dropped and (n or place == total or cut[place])):
                        kept.append(line)
                texts.append(None if text is None else "\n".join(kept))
                before.append(total), gone.append(int(cut[:total].sum())), lost.append(removed)
            columns = [c if i != at else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns[: len(rest)])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (before, gone, lost))], [*rest, "n_lines", "removed_lines", "removed_words"])
        give_back()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema} | {text_col: "string"}
    return joined.mapInArrow(edit, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_lines long, removed_lines long, removed_words long"]))
