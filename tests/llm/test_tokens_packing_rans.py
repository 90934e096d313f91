import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import packing, rans
from quillon.llm.tokens import IdEncoder, default_tokenizer

from .conftest import ODD


def library_ids(texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4") for e in Tokenizer.from_file(default_tokenizer()).encode_batch(texts, add_special_tokens=False)]


def test_cached_pieces_have_the_ids_of_whole_texts():
    rng = random.Random(5)
    parts = [*" \n\t'.,!aéb1 　x\r-", "  ", " \n", "\n ", " 's", "it's", "<|endoftext|>", "word", "́", "\U0001f600", "\n\n", "word."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encoder = IdEncoder(default_tokenizer(), capacity=50)
    got = [x for a in range(0, len(texts), 100) for x in encoder.encode(texts[a : a + 100])]
    assert got == [i.tobytes() for i in library_ids(texts)]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_binary_pieces(n):
    lengths = packing.binary_pieces(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths)
    assert lengths == sorted(lengths, reverse=True)


def check_pieces(rows, texts, end):
    ids = {k: np.append(i, end).astype("<u4") for k, i in zip(texts, library_ids(list(texts.values())), strict=True)}
    seen = {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, pieces in seen.items():
        assert sum(n for _, n in pieces) == len(ids[k]) and sorted(pieces)[0][0] == 0
    assert set(seen) == set(ids)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}


def test_packing_against_the_library(spark, documents):
    rows = packing.pack(documents).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()
    check_pieces(rows, {r.doc_id: r.text or "" for r in documents.collect()}, 0)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    firsts = [r for r in rows if r.start == 0]
    assert len(firsts) == len(ODD)
    assert [r.doc_tokens for r in firsts if r.doc_id in (1, 2)] == [1, 1]
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, longest=1000)


def test_buckets_hold_one_length(tmp_path, spark, odd):
    packing.write_buckets(packing.pack(odd), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.where("length <> shiftleft(1, bucket)").count() == 0 and back.where("octet_length(ids) <> 4 * length").count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 32768, 70000])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).geometric(0.01, n).astype("<u4")
    data = rans.encode_file([7, None], [n, 0], ids)
    head = rans.read_header(data)
    back = rans.decode_blocks(data, head, np.arange(len(head["index"])))
    assert np.array_equal(np.concatenate([np.empty(0, "<u4"), *back]), ids)
    if n > 40000:  # a block alone, from its checkpoint
        assert np.array_equal(rans.decode_blocks(data, head, np.array([1]))[0], ids[32768:65536])
        assert len(data) < 2 * n


def test_damage_is_found():
    ids = np.arange(5000, dtype="<u4") % 300
    data = bytearray(rans.encode_file([1], [5000], ids))
    data[-9] ^= 4
    with pytest.raises(ValueError):
        rans.decode_blocks(bytes(data), rans.read_header(bytes(data)), np.array([0]))
    data[50] ^= 1
    with pytest.raises(ValueError):
        rans.read_header(bytes(data))


def test_files_against_the_library(spark, documents, tmp_path):
    rows = sorted(rans.encode_corpus(documents, str(tmp_path)).withColumn("crc", F.crc32("ids")).drop("ids").collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in documents.orderBy("doc_id").collect()}
    start = 0
    for r, ids in zip(rows, library_ids(list(texts.values())), strict=True):
        own = np.append(ids, 2).astype("<u4")
        assert (r.start, r.n_tokens, r.crc) == (start, len(own), zlib.crc32(own))
        start += len(own)


def test_files_of_odd_rows(odd, none):
    rows = rans.encode_corpus(odd).collect()
    assert len(rows) == len(ODD) and rans.encode_corpus(none).count() == 0
    rows.sort(key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(i for i, _ in ODD if i is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
