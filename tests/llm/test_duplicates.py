import random
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import linededup, minhash
from quillon.llm.components import components

from .conftest import ODD, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets, parent = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def crowd(seed):
    """Copies, and two crowds of near copies: of one text, and chains in which each is a copy of the one before."""
    rng, rows = random.Random(seed), []
    base = prose(rng, 120).split()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((1000 - i, " ".join(words)))
    chain = prose(rng, 90).split()
    for i in range(20):
        chain = [*chain[2:], *prose(rng, 2).split()]
        rows.append((300 + rng.randrange(10**6), " ".join(chain)))
    rows += [(i, prose(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = crowd(seed)
    want = brute_components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[8].component_id == 5 and not by_id[8].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert by_id[None].component_id is None and by_id[None].kept
    assert sorted((r.component_id, r.kept, r.n_shingles) for r in rows if r.doc_id == 6) == [(6, True, 2), (6, True, 2)]
    assert minhash.near_duplicates(none).count() == 0


ONE, TWO = "a text of more than five words in all", "quite another text that has nothing in common with it"


def test_texts_under_one_id_are_told_apart(spark):
    rows = spark.createDataFrame([(3, ONE), (5, ONE), (5, TWO), (9, TWO), (None, TWO), (9, TWO)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(-1, 5, False), (3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False)]
    assert sorted(map(tuple, minhash.keep_one(rows).collect())) == [(3, ONE), (5, TWO)]
    same = spark.createDataFrame([(None, ONE), (None, ONE), (7, ""), (7, "")], "doc_id long, text string")
    assert sorted(r.text for r in minhash.keep_one(same).collect()) == ["", "", ONE]


def test_keep_one_of_odd_rows(odd, none):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and minhash.keep_one(none).count() == 0
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 9]


def test_texts_of_one_id_that_differ_in_the_middle(spark):
    """Confirmation takes whole texts: what a text begins and ends with doesn't stand for it."""
    rng = random.Random(5)
    head, tail = prose(rng, 30), prose(rng, 30)
    middles = [prose(rng, 40) for _ in range(4)]
    rows = [(1, f"{head} {m} {tail}") for m in middles] + [(i + 2, f"{head} {m} {tail} end") for i, m in enumerate(middles)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
    assert len(minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 4


def test_a_crowd_from_one_template_does_not_meet(spark):
    """Members share 75 of 100 shingles, similarity 0.6: no pair is made of them, so their number doesn't matter."""
    rng = random.Random(6)
    shared = prose(rng, 79)
    rows = [(i, f"{shared} {prose(rng, 25)}") for i in range(60)]
    texts = spark.createDataFrame(rows, "row long, text string")
    contested = spark.createDataFrame([(i, i, True) for i, _ in rows], "rep long, comp long, outside boolean")
    assert minhash._contested_pairs(contested, texts).count() == 0
    close = [(i, " ".join([*shared.split(), *prose(rng, 9).split()])) for i in range(12)]
    pairs = minhash._contested_pairs(spark.createDataFrame([(i, i, True) for i, _ in close], "rep long, comp long, outside boolean"), spark.createDataFrame(close, "row long, text string"))
    assert pairs.distinct().count() == 66


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = set(range(n))
        y = {v if rng.random() > 0.15 else v + 1000 for v in x}
        both = len(x & y)
        if 100 * both >= 75 * (len(x) + len(y) - both):
            p, q = (set(sorted(s, reverse=True)[: minhash._prefix_length(len(s))]) for s in (x, y))
            assert p & q


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(100, 160)] + [(5, x) for x in range(500, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = defaultdict(lambda: None)

    def find(x):
        parent[x] = parent[x] if parent[x] is not None else x
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in list(parent) if find(x) != x}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def brute_lines(rows, least=50):
    """For each document in order, which lines a run with an earlier copy covers."""
    out, places, texts = {}, defaultdict(list), []
    for k, text in sorted(rows):
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        counts = [len(x.encode().split()) for x in lines]
        texts.append(lines)
        cut = [False] * len(lines)
        for i, line in enumerate(lines):
            best = 0
            for s, j in places[line]:
                n = 0
                while i + n < len(lines) and j + n < len(texts[s]) and lines[i + n] == texts[s][j + n]:
                    n += 1
                best = max(best, n)
            places[line].append((len(texts) - 1, i))
            if sum(counts[i : i + best]) >= least:
                cut[i : i + best] = [True] * best
        out[k] = [x for x, c in zip(lines, cut, strict=True) if not c]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([1, 3, 8, 20, 60])) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {j}"]) for j in range(rng.randint(0, 25)))) for i in range(40)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    assert {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in got} == want
    assert sum(r.removed_lines for r in got) > 0


def test_lines_of_odd_rows(spark, odd, none):
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.text for r in rows}[1] is None
    assert linededup.dedup_lines(none).count() == 0
    copies = spark.createDataFrame([(1, "w " * 60), (1, "w " * 60), (2, "w " * 60)], "doc_id long, text string")
    assert sorted((r.doc_id, r.removed_lines) for r in linededup.dedup_lines(copies).collect()) == [(1, 0), (1, 0), (2, 1)]
