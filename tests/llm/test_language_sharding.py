import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import langid, queries, sharding

from .conftest import ODD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn(docs.where(~langid.held_out()))
    rows = langid.identify(docs, profiles).where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundles_against_plain_loops():
    grams = langid.Trigrams(64)
    texts = ["Ab cd", "", None, "12 !", "éa"]
    got = grams.bundle(texts)

    def plain(text):
        spaced = f" {langid.letters_of((text or '').lower()).strip()} "
        total = np.zeros(64)
        for i in range(len(spaced) - 2):
            a, b, c = map(ord, spaced[i : i + 3])
            total += np.roll(grams.letter(a), 2) * np.roll(grams.letter(b), 1) * grams.letter(c)
        return total / max(np.linalg.norm(total), 1e-12) if spaced.strip() else np.zeros(64)

    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain(text), atol=1e-5)


def test_language_of_odd_rows(odd, none):
    profiles = langid.learn(odd)
    rows = langid.identify(odd, profiles).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert langid.identify(none, profiles).count() == 0
    nothing = langid.learn(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_what_has_no_letter_is_und(spark):
    texts = ["½²", "Ⅳ ①", "12_!", "一", "ⅳ a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taught = spark.createDataFrame([(1, "some words of text", "en"), (2, "一二三", "zh")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(taught)).collect()}
    assert {k for k, v in got.items() if v == "und"} == {0, 1, 2, 5}


def test_predictions_against_plain_loops(spark):
    """Bundles and prototypes by loops over trigrams, in 64-bit arithmetic."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn(docs.where(~langid.held_out()))
    grams = langid.Trigrams()

    def bundle(text):
        spaced = f" {langid.letters_of((text or '').lower()).strip()} "
        total = np.zeros(langid.DIMENSIONS)
        counted = Counter(spaced[i : i + 3] for i in range(len(spaced) - 2))
        for g, n in counted.items():
            total += n * (np.roll(grams.letter(ord(g[0])), 2) * np.roll(grams.letter(ord(g[1])), 1) * grams.letter(ord(g[2]))).astype(float)
        return total / max(np.linalg.norm(total), 1e-12) if spaced.strip() else total

    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    own = {}
    for r in rows:
        if r.doc_id not in held and r.lang and r.text and (v := bundle(r.text)).any():
            own.setdefault(r.lang, []).append(v)
    names = sorted(own)
    means = np.array([np.mean(own[k], axis=0) for k in names])
    centred = means - means.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    for r in rows:
        v = bundle(r.text)
        if v.any():
            x = v - means.mean(axis=0)
            cosine = centred @ x / np.linalg.norm(x)
            assert got[r.doc_id].lang_pred == names[int(cosine.argmax())]
            assert abs(got[r.doc_id].score - max(0, cosine.max())) < 1e-3
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (1, 3, 8, 40, 41):
        rows = sharding.assign(ids, n).collect()
        assert all(r.grown_shard in (r.shard, n) for r in rows)
        assert set(r.shard for r in rows) <= set(range(n))
    counts = Counter(r.shard for r in sharding.assign(ids, 8).collect())
    assert min(counts.values()) > 400


def _waiting(key, level, child, weight):
    """A draw by the library of the hash: 53 bits of xxhash64 with Spark's seed."""
    u = ((xxhash.xxh64_intdigest(f"{key}/{level}/{child}".encode(), seed=42) >> 11) + 1) / 2**53
    return -math.log(u) / weight


def _walk(key, tree, weight):
    """Down the tree by plain loops."""
    racks = [rack for region in tree for rack in region]
    total = lambda shards: sum(weight[s] for s in shards)
    region = min(range(len(tree)), key=lambda i: _waiting(key, "region", i, total([s for r in tree[i] for s in r])))
    rack = min((racks.index(r) for r in tree[region]), key=lambda i: _waiting(key, "rack", i, total(racks[i])))
    return min(racks[rack], key=lambda s: _waiting(key, "shard", s, weight[s]))


def test_descent_against_plain_loops(spark):
    weights = [1.0, 2.0, 0.5, 1.0, 3.0, 1.0, 1.0, 1.0, 4.0, 1.0, 1.0]
    rows = sharding.assign(spark.range(800).withColumnRenamed("id", "doc_id"), 11, weights).collect()
    tree = sharding.layout(11)
    assert all(r.shard == _walk(r.doc_id, tree, weights) for r in rows)
    grown = [*tree, [[11]]]
    top = lambda k: min(range(len(grown)), key=lambda i: _waiting(k, "region", i, sum([*weights, 1.0][s] for rack in grown[i] for s in rack)))
    assert all(r.grown_shard == (11 if top(r.doc_id) == len(tree) else r.shard) for r in rows)


def test_weight_changes_move_rows_only_into_or_out_of_the_subtree(spark):
    """Shard 4 grows: its region and its rack draw rows in, and nothing moves between the others."""
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.assign(ids, 16).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(ids, 16, [1.0] * 4 + [3.0] + [1.0] * 11).collect()}
    moved = [(s, after[k]) for k, s in before.items() if after[k] != s]
    assert moved and all(b // 8 == 0 for _, b in moved)  # into the region
    assert all(b // 4 == 1 for a, b in moved if a // 8 == 0)  # within it, into the rack
    assert all(b == 4 for a, b in moved if a // 4 == 1)  # within that, into the shard
    share = sum(s == 4 for s in after.values()) / len(after)
    assert abs(share - 3 / 18) < 0.02


def test_the_query_against_the_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op10_sharding(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    tree = sharding.layout(40)
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert r.shard == _walk(r.doc_id, tree, [1.0] * 40) and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_of_odd_rows(odd, none):
    out = sharding.numbered(sharding.assign(odd.withColumn("crc", F.crc32(F.col("text").cast("binary"))), 4), ["doc_id", "crc"])
    assert {*odd.columns} <= {*out.columns}
    out = out.collect()
    assert len(out) == len(ODD) and all(r.lane == out[0].lane and r.inside == out[0].inside for r in out)
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.numbered(sharding.assign(none, 4), ["doc_id"]).count() == 0


def test_shares_of_odd_rows(spark, odd, none):
    """Nulls, empty, blank and very long texts, repeated rows, shared and null ids, columns of clashing names, empty tables, no label."""
    profiles = langid.learn_stretches(odd)
    rows = langid.within(odd, profiles, least=0.0).collect()
    assert len(rows) == len(ODD) and {"lang_pred", "share", "taught_as"} - set(rows[0].asDict()) == {"taught_as"}
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].share == 0 and by_id[i].lang_pred == "und" for i in (1, 2, 3))
    assert len({(r.lang_pred, r.share) for r in rows if r.doc_id == 5}) == 1
    assert all(0 <= r.share <= 1 for r in rows)
    assert langid.within(none, profiles).count() == 0
    nothing = langid.learn_stretches(none)
    assert nothing.languages == () and {r.lang_pred for r in langid.within(odd, nothing).collect()} == {"und"}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.within(unlabelled, langid.learn_stretches(unlabelled)).collect()} == {"und"}
