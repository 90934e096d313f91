"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, each a sequence of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches
from .tokens import default_tokenizer, encoder


def binary_pieces(n: int, longest: int = 1024) -> list[int]:
    """n as lengths: the longest as often as it fits, then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None) -> DataFrame:
    """Sequences of at most ``longest`` ids (a power of two) without padding or foreign documents.

    A document's ids and then ``end_id`` are cut into pieces of 1, 2, 4 ... ``longest`` ids; pieces of equal
    length make up a bucket, and a training batch takes one bucket's pieces, so each piece is a whole sequence.
    There is no shuffle: a piece depends on its document alone.

    Returns id_col, piece int, start long, length long, bucket int (the length's logarithm), ids binary
    (little-endian unsigned 32-bit), doc_tokens long, sequence_id long, offset long (0).

    Null or empty text: the end id alone. Repeated rows and ids: each row is packed by itself. A null id stays null.
    Very long texts are taken whole, one batch of 256 texts at a time, and give as many pieces as they need. Empty table: no rows. Other columns are not read.

    kept: a task keeps the ids of so many parts of texts at most, and drops them at its end, for plans that go on in the same workers. If not given, a worker
    keeps up to 1,000,000 for its next tasks.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    names = ["key", "piece", "start", "length", "bucket", "ids", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path) if kept is None else encoder(path, kept)
        encode = own.encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in names]
                for key, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    start = 0
                    for k, n in enumerate(binary_pieces(len(ids) // 4, longest)):
                        for column, value in zip(rows, (key, k, start, n, n.bit_length() - 1, ids[4 * start : 4 * (start + n)], len(ids) // 4), strict=True):
                            column.append(value)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names)
        if kept is not None:
            own.forget()
            give_back()

    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    pieces = source.mapInArrow(cut, f"key {kind}, piece int, start long, length long, bucket int, ids binary, doc_tokens long")
    return pieces.withColumnRenamed("key", id_col).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
