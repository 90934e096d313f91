"""Vector code compression: parts of integer vectors coded by the nearest entry of a codebook, which is fitted by rounds of assignment and averaging.

All numbers are integers, so a result depends on no order of rows, batches or tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, fresh, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def largest_component(length: int) -> int:
    """The most that a component may be, so that the squared distance of two vectors of this length fits 64 bits."""
    return math.isqrt((1 << 63) // max(1, length)) // 2 - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For int64 rows x, the first nearest row of book, and its squared distance: |x|^2 - 2 x.b + |b|^2, in exact integers."""
    gaps = (book * book).sum(axis=1) - 2 * (x @ book.T)
    found = gaps.argmin(axis=1)
    return found, gaps[np.arange(len(x)), found] + (x * x).sum(axis=1)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), length)


def _sums(books: np.ndarray, length: int):
    """For each part, entry and position: the sum of the components that a task's rows bring, and their number. One batch a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), length)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                found, _ = nearest(own, books[p])
                count[p] += np.bincount(found, minlength=entries)
                np.add.at(total[p], found, own)
        part, entry, place = (a.ravel() for a in np.indices(books.shape))
        used = count[part, entry] > 0
        columns = [part, entry, place, total.ravel(), count[part, entry]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[used].astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "count"]
        )

    return run


def _coded(books: np.ndarray, length: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), length)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], gap = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += gap
            text = [row.tobytes().hex() for row in codes]
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "vector"]
            names = [n for n in batch.schema.names if n != "vector"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(text, pa.string()), pa.array(error)], [*names, "code", "error"]
            )

    return run


def fit(vectors: DataFrame, length: int, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds, from these: an array of parts, entries and positions.

    vectors has a column ``vector`` and is a written table. Each round reads it once; a task sends at most a row for each number of the codebooks, these are
    added up by part, entry and position, and the driver divides. An entry that nothing is assigned to stays.
    """
    own = vectors.select("vector")
    for _ in range(rounds):
        made = own.mapInArrow(_sums(books, length), "part long, entry long, place long, total long, count long")
        merged = made.groupBy("part", "entry", "place").agg(
            F.sum("total").alias("total"), F.sum("count").alias("count")
        ).collect()
        books = books.copy()
        for r in merged:
            books[r.part, r.entry, r.place] = r.total // r["count"]
    return books


def digest(books: np.ndarray) -> str:
    """Hash of all components in order of part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """The id, label, code, error and label_error of each vector, and the codebooks.

    Components become floor(scale * x). A vector is cut into equal parts, and a part's code is the index of its codebook's nearest entry, as two
    hexadecimal digits (so at most 256 entries); of entries as near, the first. Entries begin as the parts of the vectors of least id.
    error is the sum of the parts' squared distances, label_error the sum of the errors of a label's rows, nulls being one label.

    Rows whose vector is null or holds a null or non-finite component are dropped. The length is that of the vector of least id. Rows of another
    length, rows with a component that the distances of this length have no room for (beyond some 10^8 for 64 components), and all rows if
    parts don't divide the length, take no part: their code and error are null. Rows that share an id are taken in order of their vectors, and null ids last;
    repeated rows each count. An empty vector is at distance 0 from all. Fewer vectors than entries: so many entries. No vectors: no rows and no
    entries. Other columns are not read.

    The codebooks are all that the driver and the tasks get whole: parts * entries * length / parts numbers, however many vectors there are.
    """
    if not 0 < entries <= 256:
        raise ValueError("from 1 to 256 entries")
    ident, label = "id", "label"
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(
        F.col(id_col).alias(ident), F.col(label_col).alias(label), F.col(vector_col).cast("array<double>").alias("raw")
    ).where(F.col("raw").isNotNull() & finite)
    order = [F.col(ident).asc_nulls_last(), F.col("raw").asc()]
    first = rows.orderBy(*order).limit(entries).select("raw").collect()
    length = len(first[0].raw) if first else 0
    most = largest_component(length)
    small = F.forall(
        "raw", lambda x: F.abs(F.floor(x * scale).cast("double")) <= float(most)
    ) if length else F.lit(True)
    fits = (F.size("raw") == length) & small & F.lit(length % parts == 0)
    whole = F.when(fits, F.transform("raw", lambda x: F.floor(x * scale).cast("long")))
    kept = written(rows.select(ident, label, whole.alias("vector")), "vectors")
    valid = kept.where("vector is not null")
    width = length // parts
    starts = valid.orderBy(
        F.col(ident).asc_nulls_last(), F.col("vector").asc()
    ).limit(entries).select("vector").collect()
    books = np.array([r.vector for r in starts], np.int64).reshape(
        len(starts), parts, width
    ).transpose(1, 0, 2).copy() if starts else np.zeros((parts, 0, width), np.int64)
    kinds = f"{ident} {kept.schema[ident].dataType.simpleString()}, {label} {kept.schema[label].dataType.simpleString()}, code string, error long"
    out = kept.where("vector is null").select(
        ident, label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    if starts:
        books = fit(valid, length, books, rounds)
        out = out.unionByName(valid.mapInArrow(_coded(books, length), kinds))
    coded = written(out, "coded")
    deleted(kept)
    (other,) = fresh(coded, "same")
    by_label = coded.groupBy(F.col(label).alias(other)).agg(F.sum("error").alias("label_error"))
    found = coded.join(by_label, F.col(label).eqNullSafe(F.col(other))).select(
        F.col(ident).alias(id_col), F.col(label).alias(label_col), "code", "error", "label_error"
    )
    return found, books
