import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import chat, decontam, imatch, queries, urlfilter
from quillon.llm.oracle import ORACLE_SQL

from .conftest import ODD, prose


def test_fingerprints(spark, documents):
    rows = {r.doc_id: r for r in imatch.fingerprints(documents).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    order = sorted(texts)
    for i, k in enumerate(order):
        text, after = texts[k], texts[order[(i + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert rows[k].n_chars == len(text) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    for a in order[:60]:
        for b in order[:60]:
            assert (texts[a].lower().split() == texts[b].lower().split()) <= (rows[a].fingerprint == rows[b].fingerprint)
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 8)}) == 1
    assert imatch.fingerprints(none).count() == 0
    alone = imatch.fingerprints(spark.createDataFrame([(1, "abcd ef")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()


def test_fingerprints_against_plain_loops(spark, monkeypatch):
    """Lexicon, sorted terms, subsets and likeness by loops, with the hash of another library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts)

    def signed(x):
        return x - (1 << 64 if x >> 63 else 0)

    def hashed(*longs):
        seed = 42
        for x in longs:  # a hash of several values goes on with the hash of those before
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)
        return signed(seed)

    def chained(terms):
        out = hashed(terms[0])
        for t in terms[1:]:
            out = hashed(out, t)
        return out

    def terms(text):
        return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w}

    seen = Counter(t for x in texts.values() for t in terms(x))
    low, high = math.ceil(len(texts) / 500), len(texts) // 10
    lexicon = {t for t, n in seen.items() if low <= n <= high}

    def subset_of(term, g):
        n, share = imatch.GROUPS[g]
        seed = xxhash.xxh64_intdigest(struct.pack("<q", term), seed=42)
        place = (signed(xxhash.xxh64_intdigest(b"subset", seed=seed)) >> 16 * g) % share
        return place if place < n else None

    def hashes(text):
        own = sorted(terms(text) & lexicon)
        whole = hashed(*own) if own else signed(xxhash.xxh64_intdigest(text.encode(), seed=42))
        kept = [[t for t in own if subset_of(t, g) == j] for g, (n, _) in enumerate(imatch.GROUPS) for j in range(n)]
        return [whole, *(chained(k) if k else None for k in kept)]

    def shown(values):
        digits = ["-" if v is None else f"{v % (1 << 64):016x}" for v in values]
        return ".".join([digits[0], *(d[-8:] for d in digits[1:])])

    def near(x, y):
        if x[0] == y[0]:
            return 1.0
        pairs = [a == b for a, b in zip(x[1:], y[1:], strict=True) if a is not None or b is not None]
        return sum(pairs) / len(pairs) if pairs else 0.0

    got = imatch.fingerprints(docs).collect()
    own = {k: hashes(texts[k]) for k in order}
    rows = {r.doc_id: r for r in got}
    for i, k in enumerate(order):
        text, after = texts[k], order[(i + 1) % len(order)]
        edited = hashes(text[: len(text) - len(text) // 2] + texts[after][: len(text) // 2])
        r = rows[k]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own[k]), shown(edited))
        assert r.near_edited == pytest.approx(near(own[k], edited)) and r.near_next == pytest.approx(near(own[k], own[after]))
    # a lexicon that is too large for a constant is joined, with the same result
    for broadcast in (10**6, 0):
        monkeypatch.setattr(imatch, "CONSTANT_TERMS", 0)
        monkeypatch.setattr(imatch, "BROADCAST_TERMS", broadcast)
        assert sorted(imatch.fingerprints(docs).collect()) == sorted(got)


def test_texts_under_one_id_fill_several_buckets(spark):
    """Texts without an id, and many under one: every row is followed by the next of all, and no bucket has more than its share."""
    rng = random.Random(3)
    rows = [(None, prose(rng, 5)) for _ in range(150)] + [(7, prose(rng, 5)) for _ in range(200)] + [(i, prose(rng, 5)) for i in range(20, 60)] + [(7, "a copy")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = imatch._in_order(docs).collect()
    sizes = Counter(r.bucket for r in dealt if r.halo == 0)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 60
    every = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.text) for r in dealt if r.halo == 0)
    follows = {}
    for bucket in sizes:
        own = sorted((r.halo, r.doc_id is not None, r.doc_id or 0, r.tie, r.text) for r in dealt if r.bucket == bucket)
        for a, b in zip(own, own[1:]):
            if a[0] == 0:
                follows.setdefault(a[1:], set()).add(b[1:])
    for a, b in zip(every, [*every[1:], every[0]], strict=True):
        assert b in follows[a]
    assert imatch.fingerprints(docs).count() == len(rows)


def test_half_an_edit_is_nearer_than_the_next_document(spark):
    rows = imatch.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) >= 0.95


def _grams(words):
    out = {}
    for i in range(max(len(words) - 4, 1)):
        g = tuple(words[i : i + 5])
        out[g] = out.get(g, 0) + 1
    return out


def brute_leaks(docs, items):
    """The best of all windows of each document and item: similarity, -start, -size."""
    owned = [(k, _grams(t.lower().split())) for k, t in items if t and t.split()]
    want = {}
    for k, text in docs:
        words = (text or "").lower().split()
        spots = {}
        for size in {5, *(len(g) for _, own in owned for g in own)}:
            for i in range(max(len(words) - size + 1, 0)):
                spots.setdefault(tuple(words[i : i + size]), []).append(i)
        for item, own in owned:
            m = sum(own.values())
            places = sorted(p for g in own for p in spots.get(g, ()))
            if 4 * len(places) < 3 * m:
                continue
            for a in places:
                for n in range(1, min(len(words) - a, 4 * m // 3 + 4) + 1):
                    c = _grams(words[a : a + n])
                    shared = sum(min(v, own.get(g, 0)) for g, v in c.items())
                    every = sum(c.values()) + m - shared
                    if 100 * shared >= 75 * every:
                        want[k, item] = max(want.get((k, item), (0,)), (round(shared / every, 9), -a, -n))
    return want


def found_leaks(spark, docs, items):
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), -r.start_word, -r.n_words) for r in got}


def test_leaks_of_cut_and_lengthened_items(spark):
    """Copies cut at either end, with foreign words in the middle, and with words changed."""
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([15, 30, 45, 59, 100, 6, 3])] + [(7, "a b " * 12)]
    docs = []
    for _, text in items:
        own = text.split()
        for k in (1, 2, 3, 5, 7, 8, 11, 14, 20):
            half = len(own) // 2
            for changed in (own[:-k], own[k:], own[:half] + prose(rng, k).split() + own[half:], own[:half] + ["new"] + own[half + 1 :]):
                docs.append((len(docs), " ".join([*prose(rng, 30).split(), *changed, *prose(rng, 30).split()])))
    want = brute_leaks(docs, items)
    assert len(want) > 60 and found_leaks(spark, docs, items) == want


def test_recall_on_long_documents(spark):
    """1,000 copies cut to the threshold within long documents: what the fingerprints' radius loses, of all that the exact rule finds."""
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(200)]
    docs = []
    for i in range(1000):
        own = items[i % 200][1].split()
        keep = -(-3 * (len(own) - 4) // 4) + 4
        at = rng.randrange(len(own) - keep + 1)
        docs.append((i, " ".join([prose(rng, rng.randint(0, 300)), *own[at : at + keep], prose(rng, rng.randint(0, 300))])))
    got = found_leaks(spark, docs, items)
    assert sum((i, i % 200) in got for i in range(1000)) >= 998


def test_leaks_of_odd_rows(spark, odd, none, benchmark):
    assert decontam.leaks(odd, benchmark).count() == 0
    assert decontam.leaks(none, benchmark).count() == 0
    own = spark.createDataFrame([(1, "one two"), (2, None), (3, " "), (1, "one two"), (None, "an id")], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id or -1) for r in decontam.leaks(odd, own).collect()) == [(-1, -1), (5, 1), (8, 1)]
    assert decontam.leaks(odd, own.where("false")).count() == 0


def test_clean_goes_by_rows(spark, odd, none):
    item = "the item that must not be in the corpus at all"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item), (None, "clean"), (4, item), (4, "clean too"), (4, item), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(docs, items).collect()) == [(0, "clean"), (4, "clean too"), (5, "")]
    assert decontam.clean(odd, items).columns == odd.columns and decontam.clean(odd, items).count() == len(ODD)
    assert decontam.clean(none, items).count() == 0 and decontam.clean(odd, items.where("false")).count() == len(ODD)


def test_simhash_of_a_very_long_item(spark):
    """More words than sixteen bits count."""
    rng = random.Random(4)
    words = [rng.getrandbits(63) for _ in range(300)] * 300
    df = spark.createDataFrame([(words,)], "words array<long>")
    got = decontam.with_simhash(df, "words", "print").select(F.col("print")).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words[:300]) > 300)
    assert got % (1 << 64) == want


def test_very_long_and_repetitive_items(spark):
    text = " ".join(["tick tock"] * 400)
    items = [(1, text), (2, prose(random.Random(3), 600))]
    docs = [(1, f"before {text} after"), (2, items[1][1]), (3, "tick tock " * 350)]
    got = found_leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 1)} and got[2, 2][0] == 1.0


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontam.RADIUS)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64 if x >> 63 else 0) for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(~F.arrays_overlap(decontam.blocks(F.col("a")), decontam.blocks(F.col("b")))).count() == 0


PAGES = [(1, "http://Good.example.net/en/1", '<a href="http://friend.example.com/x">'), (2, "http://bad.net/", None), (3, "https://links.example.com/a", '<a href="http://bad.net/q"> <a HREF=\'//bad.net/r\'>'), (4, "http://friend.example.com?x#y", ""), (5, None, None), (6, "no scheme", ""), (7, "http://a.example.com/de/x?q", ""), (8, "http://x.org/fr/", ""), (9, "http://b.example.net", ""), (9, "http://b.example.net", "")]


def test_urls(spark):
    rows = urlfilter.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), queries.RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == ("good.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("bad.net", "/", "net/", "block")
    assert got[3][2:] == (None, "block")  # it links to what is blocked
    assert got[4] == ("friend.example.com", "", None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == ("org/fr/", "allow")
    assert got[9][2] is None  # an empty path begins with no rule's path


def _ranked(links, seeds):
    """Scores and the most that they could be, by loops until they stand still."""
    hosts = set(seeds) | {h for link in links for h in link}
    out = Counter(a for a, _ in links)
    score, most = ({h: 0.15 * s(h) for h in hosts} for s in (lambda h: seeds.get(h, 0), lambda h: 1))
    for _ in range(300):
        new, top = ({h: 0.15 * s(h) for h in hosts} for s in (lambda h: seeds.get(h, 0), lambda h: 1))
        for a, b in links:
            new[b] += 0.85 * score[a] / out[a]
            top[b] += 0.85 * most[a] / out[a]
        score, most = new, top
    return score, most


def test_rank_against_brute_force(spark):
    rng = random.Random(3)
    links = {(str(a), str(b)) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a != b}
    seeds = {str(h): s for h, s in zip(range(12), [1.0, 0.0, 0.0, 0.5] + [0.0] * 8)}
    score, most = _ranked(links, seeds)
    got = urlfilter.personalised_rank(spark.createDataFrame(sorted(links), "src string, dst string"), spark.createDataFrame(sorted(seeds.items()), "host string, seed double"))
    rows = {r.host: r for r in got.collect()}
    assert {h: r.score for h, r in rows.items()} == pytest.approx(score, abs=2e-5)
    assert {h: r.most for h, r in rows.items()} == pytest.approx(most, abs=2e-5)


def _graph(rng):
    """Hosts that rules allow, block or say nothing of, farms around the blocked ones and links at random."""
    blocked, allowed, plain = [f"b{i}.net" for i in range(8)], [f"a{i}.example.net" for i in range(6)], [f"p{i}.com" for i in range(30)]
    farm = [f"f{i}.com" for i in range(10)]
    links = [(f, b) for f in farm for b in blocked[:7]] + [(a, p) for a in allowed for p in plain[:10]]
    links += [(rng.choice(plain), rng.choice([*plain, *allowed, *blocked])) for _ in range(60)]
    links += [("portal.com", h) for h in [*plain, blocked[7]]]
    paths = {**{b: "/" for b in blocked}, **{a: "/en/x" for a in allowed}}
    rows = []
    for host in [*blocked, *allowed, *plain, *farm, "portal.com"]:
        html = " ".join(f'<a href="https://{b}/q">' for a, b in links if a == host)
        rows.append((len(rows), f"http://{host}{paths.get(host, '/')}", html))
    return rows, {(a, b) for a, b in links if a != b}, set(farm)


def test_a_link_graph_against_loops_and_sql(spark):
    import duckdb

    rows, links, farm = _graph(random.Random(12))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in urlfilter.judge(df, queries.RULES).collect()}
    blocked, allowed = {h: float(r.rule == "net/") for h, r in got.items()}, {h: float(r.rule == "example.net/en/") for h, r in got.items()}
    shares = []
    for edges, seeds in ((links, allowed), ({(b, a) for a, b in links}, blocked)):
        score, most = _ranked(edges, seeds)
        shares.append({h: max(seeds[h], (score[h] - 0.15 * seeds[h]) / (most[h] - 0.15) if most[h] - 0.15 > 1e-6 else 0) for h in got})
    trust, distrust = shares
    for h, r in got.items():
        assert r.trust == pytest.approx(trust[h], abs=1e-4) and r.distrust == pytest.approx(distrust[h], abs=1e-4)
        if r.rule is None:
            assert r.verdict == ("block" if distrust[h] - trust[h] > 0.5 else "allow")
    # ten hosts that link to the same blocked ones only are blocked, a portal with one such link isn't
    assert all(got[f].verdict == "block" for f in farm) and got["portal.com"].verdict == "allow"
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert dict(con.sql(f"SELECT host, verdict FROM ({ORACLE_SQL['op9_urls']})").fetchall()) == {h: r.verdict for h, r in got.items()}


def test_urls_of_odd_rows(spark):
    long = "http://" + "x" * 50_000 + ".org/fr/" + "y" * 50_000
    rows = [(1, long, "<a href=http://bad.net/>" * 3000, 7, "k"), (1, long, None, 7, "k"), (None, "://", "", 7, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, rule string")
    got = urlfilter.judge(pages, queries.RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "allow"), (1, "allow")]
    assert {r.rule for r in got if r.page_id} == {"org/fr/"}


def test_urls_of_an_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string, host string, rule string"), queries.RULES).count() == 0


def _enumerated(lines, model):
    """The best path over all paths, for a few lines."""
    emission = model.emission(np.array([x[2] for x in lines]), np.array([x[3] for x in lines]))

    def score(path):
        return model.start[path[0]] + sum(emission[t, s] for t, s in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))

    paths = [p for p in itertools.product(range(6), repeat=len(lines)) if p[0] < 3 and all(b < 3 or a % 3 == b % 3 for a, b in zip(p, p[1:]))]
    return max(paths, key=score)


def test_best_path_against_all_paths():
    rng = np.random.default_rng(1)
    step, start = np.log(rng.random((3, 3))), np.log(rng.random(3))
    emission = np.log(rng.random((5, 3)))

    def score(path):
        return start[path[0]] + sum(emission[t, s] for t, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(3), repeat=5), key=score)
    assert tuple(chat.best_path(start, emission, step, np.zeros(3))) == best
    block = chat.block_scores(emission, step)
    assert np.isclose((start[:, None] + block).max(), score(best))


def test_lines_and_markers():
    assert chat.marker_of("Human: hello") == (1, "hello") and chat.marker_of("### Assistant:  hi") == (2, "hi")
    assert chat.marker_of("<|user|>") == (1, "") and chat.marker_of("[system]") == (0, "")
    assert chat.marker_of("Note: this") == (3, "Note: this") and chat.marker_of("user of it") == (3, "user of it")
    assert [(line[1], line[2], line[4]) for line in chat.parsed("one\nUser: two\r\nthree")] == [("one", 3, None), ("two", 1, 1), ("three", 3, 4)]
    assert [line[1] for line in chat.parsed(None)] == [""]


def test_the_transcript_in_one_text(spark):
    text = "System: be brief\nHuman: what is it?\nit is this\nAssistant: a thing\nof two lines\nHuman: thanks"
    rows = chat.recover(spark.createDataFrame([(c, 0, text) for c in range(4)], "conv_id long, turn long, text string")).collect()
    got = sorted((r.conv_id, r.line, r.role_pred, r.n_lines, r.rendered) for r in rows)
    want = [(0, "system", 1, "be brief"), (1, "user", 2, "what is it?\nit is this"), (3, "assistant", 2, "a thing\nof two lines"), (5, "user", 1, "thanks")]
    assert got == [(c, line, role, n, f"<|{role}|>\n{body}\n<|end|>") for c in range(4) for line, role, n, body in want]


def test_decoding_against_all_paths(spark):
    """Each conversation of six lines by trying every path of states."""
    rng = random.Random(4)
    pieces, names = [], ["Human: ", "Assistant: ", "", ""]
    for c in range(12):
        pieces += [(c, t, "\n".join(rng.choice(names if i == 0 else [""]) + prose(rng, rng.choice([1, 20])) for i in range(2))) for t in range(3)]
    df = spark.createDataFrame(pieces, "conv_id long, turn long, text string")
    model = chat.learn(df.selectExpr("false AS none", "conv_id AS conv", "turn", "0L AS tie", "text").mapInArrow(chat._lines, chat._LINES))
    got = {(r.conv, r.turn, r.line): r.state for r in chat.decode(df, model).collect()}
    for c in range(12):
        lines = [line for k, _, text in pieces if k == c for line in chat.parsed(text)]
        assert tuple(got[c, t, i] for t in range(3) for i in range(2)) == _enumerated(lines, model)


def test_roles_of_hidden_speakers(spark):
    """No role is read: with the column nulled or wrong, the recovered roles are the same."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = queries.op7_chat(spark, "/root/testdata/sf0.01").collect()
    table = [r for r in rows if r.role is not None]
    hidden = [r for r in table if r.hidden]
    assert len(table) > 0.97 * turns.count() and len(hidden) > 100
    assert np.mean([r.role == r.role_pred for r in hidden]) > 0.95 and np.mean([r.role == r.role_pred for r in table]) > 0.98
    pieces = chat.transcripts(turns).select("conv_id", "turn", "text")
    wrong = pieces.withColumns({"role": F.lit("system"), "state": F.lit(1), "at": F.lit("x")})
    assert {(r.conv_id, r.turn, r.line, r.role_pred) for r in chat.recover(wrong).collect()} == {(r.conv_id, r.turn, r.line, r.role_pred) for r in rows}


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    turns = [(1, t, rng.choice(["Human: ", "AI: ", ""]) + rng.choice(["short?", "many words " * 20, "two\nlines"])) for t in range(300)] + [(2, 0, "Human: x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    whole = sorted(map(tuple, chat.recover(df).collect()))
    monkeypatch.setattr(chat, "_BLOCK_BITS", 4)
    assert sorted(map(tuple, chat.recover(df).collect())) == whole
    assert chat.recover(df.where("false")).count() == 0


def test_chat_of_odd_rows(spark):
    big = (1 << 53) + 1
    rows = [(None, None, None), (None, 1, "User: x"), (big, 0, "User: y"), (big + 1, 0, "AI: z"), (3, 0, ""), (3, 0, ""), (4, 0, "word " * 50_000), (5, 0, "User: long\n" + "\n".join(["line"] * 5000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({"none": F.lit(1), "conv": F.lit(2), "at": F.lit(3), "line": F.lit(4), "role": F.lit("user")})
    got = {(r.conv_id, r.turn, r.line): r for r in chat.recover(df).collect()}
    assert got[big, 0, 0].role_pred == "user" and got[big + 1, 0, 0].role_pred == "assistant"
    assert got[None, None, 0].n_lines >= 1 and (4, 0, 0) in got
    assert got[5, 0, 0].n_lines == 5001
    assert sum(r.n_lines for r in got.values()) == 1 + 1 + 1 + 1 + 2 + 1 + 5001
