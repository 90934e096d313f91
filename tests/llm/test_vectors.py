import hashlib
import math

import numpy as np
import pytest

from quillon.llm import vectorcodes

from .conftest import CLASHES

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and final codebooks by loops over Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]]))
    if not kept:
        return {}, []
    width = len(kept[0][1]) // parts
    cut = [
        [[math.floor(4096 * float(np.float32(x))) for x in v[p * width : (p + 1) * width]] for p in range(parts)]
        for _, v, _ in kept
    ]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
        books = [list(b) for b in books]
    out = []
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{f:02x}" for f, _ in found), sum(g for _, g in found)))
    by_label = {}
    for _, lab, _, e in out:
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(((i, code, e, by_label[lab]) for i, lab, code, e in out), key=str), books


def vectors(seed, n=90, dim=16):
    rng = np.random.default_rng(seed)
    rows = [
        (
            int(i),
            [float(np.float32(x)) for x in rng.normal(size=dim)],
            int(rng.integers(0, 3)) if rng.random() < 0.8 else None,
        )
        for i in rng.permutation(1000)[:n]
    ]
    return rows + [(2000 + i, rows[0][1], 1) for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_loops(spark, seed):
    rows = vectors(seed)
    odd = [
        (5000, None, 1),
        (5001, [None] + [0.0] * 15, 1),
        (5002, [float("nan")] + [0.0] * 15, 1),
        (5003, [float("inf")] + [0.0] * 15, None),
    ]
    got, books = vectorcodes.compress(spark.createDataFrame(rows + odd, DDL).repartition(7))
    want, wanted = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want
    assert books.tolist() == wanted
    assert vectorcodes.digest(books) == hashlib.sha256(
        ",".join(str(x) for b in wanted for e in b for x in e).encode()
    ).hexdigest()


def test_ties_go_to_the_first_entry_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(6)]
    got, books = vectorcodes.compress(spark.createDataFrame(rows, DDL), entries=4)
    assert {r.code for r in got.collect()} == {"00" * 8, "01" * 8}
    assert books[0].tolist() == [[0], [4096], [0], [4096]]


def test_floors_go_down(spark):
    rows = [(0, [-0.00001] * 8, 0), (1, [0.0] * 8, 0), (2, [-0.5] * 8, 0)]
    got, books = vectorcodes.compress(spark.createDataFrame(rows, DDL), entries=1)
    assert books[0].tolist() == [[(-1 + 0 - 2048) // 3]]


def test_odd_vectors(spark):
    assert vectorcodes.compress(spark.createDataFrame([], DDL))[0].count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 2)], DDL))[0].count() == 0
    rows = [
        (None, [1.0] * 8, None),
        (1, [0.5] * 8, None),
        (1, [0.5] * 8, None),
        (2, [1.0] * 9, 3),
        (3, [1e30] * 8, 3),
        (4, [], 3),
    ]
    got, books = vectorcodes.compress(spark.createDataFrame(rows, DDL))
    by_id = {r.vec_id: r for r in got.collect()}
    assert got.count() == 6 and len(books[0]) == 3
    assert all(by_id[i].code is None and by_id[i].error is None for i in (2, 3, 4))
    assert by_id[1].code == "00" * 8 and by_id[None].code == "02" * 8 and by_id[None].label_error == 0
    empty, _ = vectorcodes.compress(spark.createDataFrame([(1, [], 0), (2, [], 0)], DDL))
    assert sorted((r.vec_id, r.code, r.error) for r in empty.collect()) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    seven, _ = vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 7, 0)], DDL))
    assert [(r.code, r.label_error) for r in seven.collect()] == [(None, None)]


def test_other_columns_may_have_any_name(spark):
    rows = [(i, [float(i)] * 8, i % 2, *range(len(CLASHES) + 3)) for i in range(5)]
    names = DDL + ", " + ", ".join(f"`{c}` int" for c in [*CLASHES, "code", "error", "id"])
    assert vectorcodes.compress(spark.createDataFrame(rows, names))[0].count() == 5


def test_the_largest_components_are_exact():
    most = vectorcodes.largest_component(8)
    x, book = np.full((1, 8), most, np.int64), np.array([[-most] * 8, [most] * 8], np.int64)
    at, gap = vectorcodes.nearest(x, book)
    assert at.tolist() == [1] and gap.tolist() == [0]
    assert vectorcodes.nearest(x, book[:1])[1].tolist() == [8 * (2 * most) ** 2]
