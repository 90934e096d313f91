import random

import numpy as np
import pytest

from quillon.llm import jaccardjoin
from quillon.llm.minhash import shingle_set

from .conftest import ODD, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 85 * (len(a) + len(b) - both)


def brute(rows):
    sets, parent = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}, sets


def crowd(seed):
    """Near copies of one text, a chain in which each is a copy of the one before, members of one template that don't link, short texts, copies."""
    rng, rows = random.Random(seed), []
    base = prose(rng, 120).split()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((1000 - i, " ".join(words)))
    chain = prose(rng, 90).split()
    for _ in range(20):
        chain = [*chain[2:], *prose(rng, 2).split()]
        rows.append((3000 + rng.randrange(10**6), " ".join(chain)))
    shared = prose(rng, 80)
    rows += [(400 + i, f"{shared} {prose(rng, 14)}") for i in range(30)]
    rows += [(i, prose(rng, rng.randint(1, 60), "abc")) for i in range(40)]
    rows += [(500 + i, "one two three".upper() if i % 2 else "one two three") for i in range(4)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    rows = crowd(seed)
    want, sets = brute(rows)
    got = jaccardjoin.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_all_links_against_brute_force(spark):
    rows = crowd(4)
    pairs, members = jaccardjoin.links(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {}
    for r in members.collect():
        of.setdefault(r.rep, set()).add(r.doc_id)
    got = {frozenset((x, y)) for r in pairs.collect() for x in of[r.a] for y in of[r.b]}
    sets = {k: shingles(t) for k, t in rows}
    want = {frozenset((x, y)) for x in sets for y in sets if x < y and sets[x] != sets[y] and linked(sets[x], sets[y])}
    assert got == want


def test_prefixes_share_as_many_as_their_level():
    """Of similar sets, prefixes of any level share so many: the smaller level of two is asked for, and never too much."""
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(600):
        n = int(rng.integers(1, 60))
        x = set(range(n))
        y = {v if rng.random() > 0.06 else v + 1000 for v in x} | ({2000} if rng.random() < 0.3 else set())
        if not linked(x, y):
            continue
        order = {v: rng.random() for v in x | y}
        for level in range(1, jaccardjoin.MOST_LEVEL + 1):
            fits = [-(-85 * len(s) // 100) >= level for s in (x, y)]
            if all(fits):
                p, q = (set(sorted(s, key=order.get)[: jaccardjoin.base_length(len(s)) + level]) for s in (x, y))
                assert len(p & q) >= level
                seen += 1
    assert seen > 500


def test_levels_follow_the_lists(spark):
    """A document whose prefix meets long lists asks for more shared shingles than one that meets nobody often."""
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for i in range(80):
        words = list(base)
        words[rng.randrange(200)] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(rng, 200)) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = jaccardjoin._rows(frame, "doc_id", "text")
    place = {r.row: r.doc_id for r in table.collect()}
    join = jaccardjoin._Join(table, 4, 85)
    levels = {place[r.rep]: r.level for r in join.prefixes.collect()}
    assert max(levels[i] for i in range(80)) > 1
    assert {levels[100 + i] for i in range(5)} == {1}


def test_a_crowd_that_shares_a_passage_does_not_meet(spark):
    """Members share 77 of 90 shingles, similarity 0.75: sizes and places tell, so their number doesn't matter."""
    rng = random.Random(6)
    shared = prose(rng, 80)
    rows = jaccardjoin._rows(
        spark.createDataFrame([(i, f"{shared} {prose(rng, 13)}") for i in range(50)], "doc_id long, text string"),
        "doc_id",
        "text",
    )
    join = jaccardjoin._Join(rows, 4, 85)
    every = join.classes.selectExpr("rep", "rep AS comp", "true AS outside")
    assert join.index.count() > 0 and join.pairs(every).count() == 0


def test_odd_rows(spark, odd, none):
    rows = jaccardjoin.groups(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[8].component_id == 5 and all(
        by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (1, 2, 3)
    )
    assert by_id[None].component_id is None
    assert sorted((r.component_id, r.n_shingles) for r in rows if r.doc_id == 6) == [(6, 3), (6, 3)]
    assert jaccardjoin.groups(none).count() == 0
    assert jaccardjoin.links(none)[0].count() == 0


def test_the_sketch_counts_each_row_once(spark):
    rows = [(1, 1, "a b c d e a b c d"), (2, 2, "a b c d"), (3, 3, None), (4, 4, "")]
    given = spark.createDataFrame(rows, "row long, doc_id long, text string").repartition(3)
    counters = jaccardjoin.frequencies(given.mapInArrow(jaccardjoin._features(4), jaccardjoin._FEATURES))
    (one,) = shingle_set("a b c d", 4)
    assert counters[int(one >> np.uint64(64 - jaccardjoin.COUNTER_BITS))] == 2 and counters.sum() == 5 + 1
