import random

import pytest


def prose(rng: random.Random, n: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))


#: Documents with everything that may go wrong: nulls, empty and blank texts, a very long one, repeats, shared and null ids.
LONG = prose(random.Random(1), 30_000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two"), (5, "one two"), (6, "Ünï cödé \U0001f600 text\nwith lines"), (6, "another text of the same id"), (None, "a text without an id"), (7, "x" * 5000), (8, "one two"), (9, "12 34 !!")]
#: Columns that operators use themselves.
CLASHES = ["doc", "cuts", "__cuts", "__doc", "__tie", "inside", "before", "found", "held_id", "held_body", "none", "conv", "n", "sum0", "body", "matches", "key", "words", "start", "length", "ids", "bucket", "halo", "score", "lang_pred", "shard", "grown_shard", "slot", "lane", "rep", "comp", "component_id", "digest", "bands", "place", "line", "tie", "rank", "n_lines", "removed_lines", "block", "window", "term", "mask", "row", "next", "rule", "verdict", "host", "path", "marker", "shape", "at"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", *range(len(CLASHES))) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHES))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
