import base64
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import langid

from .conftest import prose
from .test_duplicates import brute_components, brute_lines
from .test_native_and_web import brute_leaks
from .test_tokens_packing_rans import library_ids


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = loops_of_the_language_stage([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = {r.doc_id: r.text for r in docs.collect() if judged[r.doc_id][1] >= langid.LEAST_SHARE}
    lines = brute_lines(list(rows.items()))
    out = {}
    for k, text in rows.items():
        own = [x for x in text.split("\n") if x.split()]
        if len(lines[k]) == len(own):
            out[k] = text
        elif lines[k]:
            out[k] = "\n".join(lines[k])
    component = brute_components([(k, t) for k, t in out.items()])
    out = {k: t for k, t in out.items() if component[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    shared = {g for _, t in items for g in zip(*[t.lower().split()[i:] for i in range(5)])}
    near = [(k, t) for k, t in out.items() if shared & set(zip(*[t.lower().split()[i:] for i in range(5)]))]
    leaking = {k for k, _ in brute_leaks(near, items)}
    out = {k: t for k, t in out.items() if k not in leaking}
    ids = {k: np.append(i, 0).astype("<u4") for k, i in zip(out, library_ids(list(out.values())), strict=True)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(out)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_stages_keep_the_columns_and_take_empty_tables(spark, documents):
    folder, none = "/root/testdata/sf0.001", documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0
        assert name == "pack" or out.columns == documents.columns
    extra = documents.limit(5).withColumns({"key": F.lit(1), "cuts": F.lit("x")})
    assert corpus_pipeline.STAGES[1][1](spark, extra, folder).columns == documents.columns


def test_language_rejects_junk_and_unknown_scripts(spark):
    """Junk goes but for a few in a hundred; of held-out texts, short or whole, nearly all stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    greek, cyrillic = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщыьэюя"
    junk = [t for _ in range(50) for t in (prose(rng, 60), base64.b64encode(rng.randbytes(300)).decode(), prose(rng, 60, greek), prose(rng, 60, cyrillic))]
    clean = [r.text for r in docs.where(langid.held_out()).select("text").collect() if r.text]
    short = [" ".join(t[:n].split()[:-1]) for t in clean for n in (30, 60)]
    rows = [(i, t, None, "planted", len(t)) for i, t in enumerate([*junk, *clean, *short])]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.where(~langid.held_out()).select(*corpus_pipeline.COLUMNS).unionByName(planted)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, "").where("source = 'planted'").collect()}
    share = [len(kept & set(range(a, b))) / (b - a) for a, b in ((0, len(junk)), (len(junk), len(junk) + len(clean)), (len(junk) + len(clean), len(rows)))]
    assert share[0] <= 0.05 and share[1] >= 0.99 and share[2] >= 0.97, share


def test_language_rejects_short_junk(spark):
    """Junk of two to ten words goes as long junk does; the first words of held-out texts stay, however few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(6)
    scripts = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщыьэюя", "的一是不了人我在有他这中大来上国")
    junk = [prose(rng, n, letters) for _ in range(25) for letters in scripts for n in (2, 5, 10)] + [base64.b64encode(rng.randbytes(20)).decode() for _ in range(100)]
    clean = [" ".join(r.text[:n].split()[:-1]) for r in docs.where(langid.held_out()).select("text").collect() if r.text for n in (15, 30, 60)]
    clean = [t for t in clean if langid.letters_of(t, "")]
    rows = [(i, t, None, "planted", len(t)) for i, t in enumerate([*junk, *clean])]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.where(~langid.held_out()).select(*corpus_pipeline.COLUMNS).unionByName(planted)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, "").where("source = 'planted'").collect()}
    stay = len([i for i in kept if i < len(junk)]) / len(junk), len([i for i in kept if i >= len(junk)]) / len(clean)
    assert stay[0] <= 0.05 and stay[1] >= 0.99, stay


def loops_of_the_language_stage(docs):
    """Of each document, by loops: the language and share by prototypes that all other labelled documents teach."""
    grams, known = langid.Trigrams(langid.STRETCH_DIMENSIONS), {}

    def stretches(text):
        codes = grams.codes([text])[0].tolist()
        n = max(len(codes) // langid.STRETCH, 1)
        out = [[] for _ in range(n)]
        for i, c in enumerate(codes):
            out[i * n // len(codes)].append(c)
        return out

    def total(codes):
        codes = np.array(sorted(codes), np.int64)
        return sum((grams.vectors(codes[i : i + 500]).astype(float).sum(axis=0) for i in range(0, len(codes), 500)), np.zeros(langid.STRETCH_DIMENSIONS))

    for k, text, lang in docs:
        cut = stretches(text or "")
        bundle = total({c for s in cut for c in s})
        known[k] = cut, lang, bundle / max(np.linalg.norm(bundle), 1e-12), sum(total(s) for s in cut), sum(len(s) for s in cut)
    langs = sorted({v[1] for v in known.values() if v[1] is not None and v[4]})
    sums = {x: [sum(v[i] for v in known.values() if v[1] == x) for i in (2, 3, 4)] for x in langs}
    out = {}
    for k, (cut, lang, *own) in known.items():
        votes = dict.fromkeys(langs, 0)
        for s in cut:
            best, which = -np.inf, None
            vector = total(s) / max(len(s), 1)
            for x in langs:
                bundle, stretch, n = (a - b if x == lang else a for a, b in zip(sums[x], own, strict=True))
                p = bundle / max(np.linalg.norm(bundle), 1e-12)
                usual = stretch @ p / max(n, 1)
                ratio = vector @ p / usual if usual > 0 else -np.inf
                if ratio > best:
                    best, which = ratio, x
            if best >= langid.NEAR_ENOUGH:
                votes[which] += len(s)
        n = sum(map(len, cut))
        out[k] = max(langs, key=lambda x: (votes[x], -langs.index(x))) if any(votes.values()) else None, sum(votes.values()) / max(n, 1)
    return out


def test_shares_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if len(r.text or "") < 3000][:60]
    rows += [(9001, "zq xj " * 100 + (rows[0][1] or "") * 2, None), (9002, None, "en"), (9003, "1 2 3", "en"), (9004, "", None), (9005, "der die das und ist", "xx"), (9006, "ωψ" * 400, "yy")]
    want = loops_of_the_language_stage(rows)
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.within(given, langid.learn_stretches(given), least=0.0).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, share = want[r.doc_id]
        assert abs(r.share - share) < 1e-9 and r.lang_pred == (lang or "und"), r
    # what a document alone has taught doesn't speak for it
    assert want[9005][0] != "xx" and want[9006][0] != "yy"


def test_language_stage_takes_labelled_junk_like_other_junk(spark):
    """Short junk under a label of a language teaches nothing about itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    junk = [(100_000 + i, prose(rng, rng.randint(2, 5)), "en" if i % 2 else None, "planted", 9) for i in range(400)]
    both = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [r.doc_id for r in corpus_pipeline.language(spark, both, "").where("source = 'planted'").collect()]
    labelled, plain = len([i for i in kept if i % 2]) / 200, len([i for i in kept if i % 2 == 0]) / 200
    assert labelled <= 0.05 and plain <= 0.05, (labelled, plain)


def test_language_stage_decides_by_the_share_of_a_text(spark):
    """Texts that are mostly junk go and texts with some junk stay; each has the language found, and only wanted languages count."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rng = random.Random(9)
    clean = [(r.text.split(), r.lang) for r in docs.where(langid.held_out()).where("length(text) > 600").limit(120).collect()]
    rows = []
    for i, (words, lang) in enumerate(clean):
        half = words[:60]
        rows.append((200_000 + i, " ".join(half[:20]) + " " + prose(rng, 180), None, "mostly junk", 1))
        rows.append((300_000 + i, " ".join(half) + " " + prose(rng, 12), lang, "some junk", 1))
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.where(~langid.held_out()).unionByName(planted.withColumn("lang", F.lit(None).cast("string")))
    got = corpus_pipeline.language(spark, both, "").where("doc_id >= 200000").collect()
    assert len([r for r in got if r.source == "mostly junk"]) <= 0.03 * len(clean)
    some = {r.doc_id: r.lang for r in got if r.source == "some junk"}
    assert len(some) >= 0.98 * len(clean)
    assert sum(some.get(300_000 + i) == lang for i, (_, lang) in enumerate(clean)) >= 0.97 * len(clean)
    french = langid.within(docs, langid.learn_stretches(docs), ("fr",)).where("lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert {r.lang_pred for r in french} == {"fr"} and sum(r.lang == "fr" for r in french) >= 0.95 * len(french)


def test_stretches_are_even():
    codes, of = np.arange(700), np.repeat([0, 2, 3], [10, 520, 170])
    stretch, text = langid.stretched(codes, of, 5)
    assert np.bincount(stretch, minlength=len(text)).tolist() == [10, 0, 174, 173, 173, 170, 0] and text.tolist() == [0, 1, 2, 2, 2, 3, 4]


def test_packing_stage_leaves_nothing_in_workers(spark, documents):
    """Workers serve later stages, so a task of the packing stage drops the parts of texts that it has kept; the rows are those of the operator."""
    from quillon.llm import packing, tokens

    path = tokens.default_tokenizer()
    got = corpus_pipeline.pack(spark, documents, "").drop("sequence_id").collect()

    def held(parts):
        own = tokens.encoder(path, corpus_pipeline.KEPT_PARTS)
        for _ in parts:
            yield sum(map(len, (own.parts, own.old_parts, own.pieces, own.old_pieces)))

    assert max(spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect()) == 0
    whole = packing.pack(documents).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "offset").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, whole), key=repr)
