"""Token ids in files by a static range asymmetric numeral system.

A file, little-endian: magic; u32 scale bits, lanes, symbols, documents, blocks; u64 ids; the frequency table (u32 symbols,
u32 frequencies), which all blocks share; i64 document ids and u8 flags of null ids; u64 document lengths; for each block u64 first
word, u32 words, u32 ids and u32 CRC-32 of its ids; each block's checkpoint, a u64 state for each lane; u32 CRC-32
of all before; the blocks' u32 words. A block decodes alone from its checkpoint. In it, id i belongs to lane i mod
lanes, and all lanes read one stream of words.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, written
from .tokens import default_tokenizer, encoder

MAGIC = b"QRANS01\n"
SCALE_BITS, LANES, BLOCK_IDS, FILE_IDS = 18, 64, 1 << 15, 1 << 21
_AT_ONCE = 64
LOW, WORD = np.int64(1 << 20), np.int64(32)  # states are in [2^20, 2^52), so that one word at a time is enough


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, frequencies that sum up to 2^bits and are 1 at least, each id's place among the symbols, and bits: fewer for few symbols, as small tables stay in the cache."""
    every = np.bincount(ids) if len(ids) else np.empty(0, np.int64)  # vocabularies are small
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    where = np.zeros(len(every), np.int64)
    where[symbols] = np.arange(len(symbols))
    places = where[ids]
    bits = SCALE_BITS - 2 * (len(symbols) <= 1 << (SCALE_BITS - 4))
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError("more symbols than slots")
    if not len(symbols):
        return symbols, counts.astype(np.int64), places, bits
    share = np.maximum(1, np.floor(counts * ((total - len(symbols)) / counts.sum())).astype(np.int64))
    share[np.argmax(counts)] += total - share.sum()
    return symbols, share, places, bits


def encode_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    symbols, freq, places, bits = frequency_table(ids)
    n, steps = len(ids), BLOCK_IDS // LANES
    blocks = -(-n // BLOCK_IDS)
    padded = np.full(blocks * BLOCK_IDS, np.argmax(freq) if n else 0, np.int64)  # the last block is filled up with the commonest symbol
    padded[:n] = places
    grid = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    cumulative = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.int64)
    frequency, state = freq.astype(np.int64), np.full((blocks, LANES), LOW, np.int64)
    words, given = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    limit, full = frequency << (52 - bits), 1 << bits
    for s in range(steps - 1, -1, -1):
        at = grid[s]
        f = frequency[at]
        spill = state >= limit[at]
        words[s], given[s] = state, spill
        np.right_shift(state, WORD, out=state, where=spill)
        q = (state / f).astype(np.int64)  # exact: states are below 2^53
        q *= full - f  # (q << bits) + (state - q f) + c
        state += q
        state += cumulative[at]
    streams = [words[:, b][given[:, b]] for b in range(blocks)]
    first, index = 0, []
    for b, stream in enumerate(streams):
        part = ids[b * BLOCK_IDS : (b + 1) * BLOCK_IDS]
        index.append(struct.pack("<QIII", first, len(stream), len(part), zlib.crc32(part.astype("<u4"))))
        first += len(stream)
    head = b"".join((MAGIC, struct.pack("<IIIIIQ", bits, LANES, len(symbols), len(lengths), blocks, n), symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(), *index, state.astype("<u8").tobytes()))
    return b"".join((head, struct.pack("<I", zlib.crc32(head)), *[s.astype("<u4").tobytes() for s in streams]))


def read_header(data: bytes) -> dict:
    if data[:8] != MAGIC:
        raise ValueError("not such a file")
    bits, lanes, symbols, docs, blocks, n = struct.unpack_from("<IIIIIQ", data, 8)
    at = 36

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    head = {"bits": bits, "lanes": lanes, "n": n, "symbols": take("<u4", symbols), "freq": take("<u4", symbols), "doc_ids": take("<i8", docs), "null_ids": take("u1", docs), "lengths": take("<u8", docs)}
    head["index"] = take(np.dtype([("first", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("crc", "<u4")]), blocks)
    head["states"] = take("<u8", blocks * lanes).reshape(blocks, lanes)
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the header's checksum is wrong")
    return head | {"payload": at + 4}


def decode_blocks(data: bytes, head: dict, blocks: np.ndarray) -> list[np.ndarray]:
    """The ids of these blocks, each from its own checkpoint, with their checksums verified."""
    index, lanes = head["index"][blocks], head["lanes"]
    if not len(index):
        return []
    words = np.frombuffer(data, "<u4", offset=head["payload"])
    words = np.append(words, np.uint32(0)).astype(np.int64)
    freq = head["freq"].astype(np.int64)
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    slot_pair = (freq[slots] << 32 | np.arange(len(slots)) - start[slots]).astype(np.int64)  # frequency and place within the symbol
    state, at = head["states"][blocks].astype(np.int64), index["first"].astype(np.int64)
    steps = BLOCK_IDS // lanes
    out = np.empty((steps, len(blocks), lanes), np.uint32)
    mask, shift, low32 = (1 << head["bits"]) - 1, head["bits"], (1 << 32) - 1
    for s in range(steps):
        slot = state & mask
        out[s] = slots[slot]
        pair = slot_pair[slot]
        state >>= shift
        state *= pair >> 32
        state += pair & low32
        wants = state < LOW
        ahead = np.cumsum(wants, axis=1)
        picked = (at[:, None] + ahead - 1)[wants]
        state[wants] = (state[wants] << WORD) | words[picked]
        at += ahead[:, -1]
    # a sound stream ends where the encoder began
    if (state != LOW).any() or (at != index["first"].astype(np.int64) + index["words"]).any():
        raise ValueError("a block doesn't end as it should")
    out = out.transpose(1, 0, 2)
    found = []
    for b, n in enumerate(index["ids"].astype(np.int64)):
        ids = head["symbols"][out[b].reshape(-1)[:n]]
        if zlib.crc32(ids) != index["crc"][b]:
            raise ValueError(f"the checksum of block {blocks[b]} is wrong")
        found.append(ids)
    return found


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, each with end_id after it, into files of about FILE_IDS ids in ascending order of id_col.

    One shuffle by range, also over a hash of the text so that one id's many rows can be split. Each task writes whole
    files under a name of its own and renames them; a task that runs again writes the same bytes. Returns the manifest,
    itself a written table: file, part, number, n_docs, n_ids, base (ids of all files before it).

    Null text: empty, so the end id alone. Null ids come first. Repeated ids: by a hash of the text. Very long texts are taken whole: a document isn't
    cut over files, so one of more than FILE_IDS ids makes a file of its own size, which its writer and its reader hold as ids and as bytes. Other columns are
    not read. Empty table: no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def save(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(path).encode
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        keys, lengths, chunks, held, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, lengths, chunks, held, number
            data = encode_file(keys, lengths, np.frombuffer(b"".join(chunks), "<u4"))
            name = f"ids-{part:06d}-{number:05d}.rans"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            done = f"{root}/{name}"
            if store.type_name == "hdfs" and store.get_file_info(done).type.name != "NotFound":
                store.delete_file(done)
            store.move(draft, done)
            row = pd.DataFrame({"file": [f"{folder}/{name}"], "part": [part], "number": [number], "n_docs": [len(keys)], "n_ids": [held]})
            keys, lengths, chunks, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pandas(row, preserve_index=False)

        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                some = frame.slice(at, 256)
                for key, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    keys.append(key)
                    lengths.append(len(ids) // 4)
                    chunks.append(ids)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        yield flush()
        if keys:
            yield flush()

    ranged = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    manifest = written(ranged.mapInArrow(save, "file string, part long, number long, n_docs long, n_ids long"), "manifest")
    of_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return manifest.join(before, "part").withColumn("base", F.col("before") + F.coalesce(F.sum("n_ids").over(of_part), F.lit(0))).drop("before")


def read_files(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest: for each document doc_id, start (ids before it in all files), n_tokens, ids binary.

    A file is decoded _AT_ONCE blocks at a time and given on document by document; every checksum is verified.
    """

    def load(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                store, name = _store(row["file"])
                with store.open_input_stream(name) as source:
                    data = source.read()
                head = read_header(data)
                raw = b"".join(x.tobytes() for at in range(0, len(head["index"]), _AT_ONCE) for x in decode_blocks(data, head, np.arange(at, min(at + _AT_ONCE, len(head["index"])))))
                ends = np.cumsum(head["lengths"].astype(np.int64))
                starts = ends - head["lengths"].astype(np.int64)
                for at in range(0, len(ends), 256):
                    some = slice(at, at + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(head["doc_ids"][some], pa.int64(), mask=head["null_ids"][some].astype(bool)), pa.array(starts[some] + row["base"]), pa.array(ends[some] - starts[some]), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[some], ends[some], strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("file", F.col("base").cast("long"))
    n = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n).mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def encode_corpus(docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes the files and reads them back."""
    return read_files(write_files(docs, folder or scratch_path(docs.sparkSession, "ids"), **how))
