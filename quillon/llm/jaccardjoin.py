"""N-gram Jaccard join by adaptive multi-match prefixes.

Shingles have one order for all documents, rarest first. Of two sets with a similarity of at least the threshold, the first n - ceil(t n) + l
shingles of each share l, for any l up to the shared number. A longer prefix costs more list entries but leaves fewer pairs to verify, so each
document takes the l at which the estimate of both is least, and a pair must share the smaller l of its two before it is verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, parts, small_batches, written
from .components import components
from .minhash import shingle_set, similar_sets

WORDS, PERCENT = 4, 85
#: The longest prefixes ask for so many shared shingles.
MOST_LEVEL = 6
#: What verifying a pair costs, in list entries.
VERIFY_COST = 30
#: Counters of the sketch that orders shingles: of a fixed number, a task sends them in blocks. A shingle counts as much as all that share its counter.
COUNTER_BITS, BLOCK_BITS = 20, 12
#: Sizes of sets are told apart by bands, each 5 % wider than the one before.
SIZE_BAND = 1.05


def base_length(n: int, percent: int = PERCENT) -> int:
    """Of sets with a similarity of percent or more, the first so many and l more of each, in one order for all, share l."""
    return n - -(-percent * n // 100)


_FEATURES = "row long, doc_id long, n_shingles long, digest binary, block long, counters binary"


def _features(words: int):
    """Each row's set size and digest; then, in rows of their own, the blocks of the task's counters of shingles."""
    kinds = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("digest", pa.binary()),
            ("block", pa.int64()),
            ("counters", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            n, sizes, digests = batch.num_rows, [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                np.add.at(counters, (shingles >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=kinds,
            )
        blocks = counters.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        none = [pa.nulls(len(used), f.type) for f in list(kinds)[:4]]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(used, pa.int64()), pa.array([blocks[i].tobytes() for i in used], pa.binary())],
            schema=kinds,
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's blocks of counters. A sum stops at the largest number."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counters.as_py(), np.uint32)
            total[block] = np.minimum(total.get(block, 0) + own.astype(np.uint64), np.iinfo(np.uint32).max)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.int64()),
            pa.array([c.astype(np.uint32).tobytes() for c in total.values()], pa.binary()),
        ],
        ["block", "counters"],
    )


def frequencies(found: DataFrame) -> np.ndarray:
    """Of the blocks that ``_features`` sent, the sums: 2^COUNTER_BITS counters, by a shingle's first bits, of the number of rows that shingles are in."""
    made = found.where("block is not null").select("block", "counters")
    rows = made.repartition(parts(found.sparkSession), "block").mapInArrow(
        _added, "block long, counters binary"
    ).collect()
    out = np.zeros((1 << COUNTER_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counters, np.uint32)
    return out.ravel()


def _prefixes(counters: np.ndarray, words: int, percent: int):
    """Each text's set size, and its longest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                n = len(shingles)
                often = counters[(shingles >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                sizes.append(n)
                found.append(
                    shingles[np.lexsort((shingles, often))][
                        : min(n, base_length(n, percent) + MOST_LEVEL)
                    ].view(np.int64)
                )
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), lists], ["rep", "size", "prefix"]
            )

    return run


def _confirmed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # b names one text, and its pairs follow one another
        for batch in batches:
            ok = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[b] = shingle_set(y.as_py(), words)
                ok.append(similar_sets(shingle_set(x.as_py(), words), kept[b], percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, prefixes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), each once, those that share enough of their prefixes and whose full sets are similar. A written table.

    The sides are joined one after the other and written between, so what is joined by a hub is split by Spark.
    """
    own = prefixes.select("rep", "level", F.slice("prefix", F.lit(1), F.col("base") + F.col("level")).alias("prefix"))
    first = written(pairs.join(own.withColumnsRenamed({"rep": "a", "level": "p", "prefix": "x"}), "a"), "first")
    both = first.join(own.withColumnsRenamed({"rep": "b", "level": "q", "prefix": "y"}), "b")
    shared = written(both.where(F.size(F.array_intersect("x", "y")) >= F.least("p", "q")).select("a", "b"), "shared")
    deleted(first)
    half = written(shared.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a"), "half")
    whole = half.join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    out = written(whole.mapInArrow(_confirmed(words, percent), "a long, b long"), "links")
    deleted(shared, half)
    return out


def _size_band(size: Column) -> Column:
    return F.floor(F.ln(size) / F.lit(math.log(SIZE_BAND))).cast("int")


class _Join:
    """Written tables of a corpus. Sets that are equal are one class, named by its least row (rep).

    features: row, doc_id, n_shingles, digest. classes: digest, rep, least_id. texts: row and text of the reps. prefixes: rep, size,
    base, level, prefix. index: token, rep, size, place, base, level of the tokens that several prefixes hold. rows, a written table, goes when
    it has been read.
    """

    def __init__(self, rows: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        found = written(rows.mapInArrow(_features(words), _FEATURES), "features")
        self.features = found.where("block is null").drop("block", "counters")
        by_set = self.features.where("digest is not null").groupBy("digest")
        self.classes = written(by_set.agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id")), "classes")
        counters = frequencies(found)
        self.texts = written(
            rows.join(
                self.classes.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi"
            ).select("row", "text"),
            "texts",
        )
        deleted(rows)
        made = self.texts.mapInArrow(_prefixes(counters, words, percent), "rep long, size int, prefix array<long>")
        longest = written(
            made.withColumn("base", F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int")), "longest"
        )
        every = longest.select("rep", "size", "base", F.posexplode("prefix").alias("place", "token"))
        often = written(every.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "often")
        entries = written(every.join(often, "token"), "entries")
        levels = written(entries.groupBy("rep").agg(self._level().alias("level")), "levels")
        self.prefixes = written(longest.join(levels, "rep", "left").na.fill(1, ["level"]), "prefixes")
        self.index = written(
            entries.join(levels, "rep").where("place < base + level").select(
                "token", "rep", "size", "place", "base", "level"
            ),
            "index",
        )
        deleted(longest, often, entries, levels)

    def _level(self) -> Column:
        """The number of shared shingles that a document asks for: that of least cost by the lists of its prefix.

        With so many entries in the lists up to a level, at most a level's part of them are documents that share so much.
        """
        costs = []
        for level in range(1, MOST_LEVEL + 1):
            seen = F.sum(F.when(F.col("place") < F.col("base") + level, F.col("n") - 1).otherwise(0))
            fits = F.max(F.col("size") - F.col("base")) >= level
            costs.append(
                F.when(fits, F.struct((seen * (1 + VERIFY_COST / level)).alias("cost"), F.lit(level).alias("level")))
            )
        return F.array_min(F.filter(F.array(*costs), lambda c: c.isNotNull()))["level"]

    def verified(self, pairs: DataFrame) -> DataFrame:
        return _verified(pairs, self.prefixes, self.texts, self.words, self.percent)

    def star(self) -> DataFrame:
        """Links of each list's most central class with the list's others, where the two meet so often as their levels ask: linear in the lists."""
        central = written(self.index.groupBy("rep").agg(F.count("*").alias("weight")), "central")
        pivots = written(
            self.index.join(central, "rep").groupBy("token").agg(
                F.max_by(F.struct("rep", "size", "level"), F.struct("weight", -F.col("rep"))).alias("pivot")
            ),
            "pivots",
        )
        pairs = self.index.join(pivots, "token").where("rep <> pivot.rep").groupBy(
            F.col("rep").alias("a"), F.col("pivot.rep").alias("b")
        )
        met = pairs.agg(
            F.count("*").alias("n"),
            F.any_value(F.least("level", "pivot.level")).alias("least"),
            F.any_value(F.least("size", "pivot.size")).alias("less"),
            F.any_value(F.greatest("size", "pivot.size")).alias("more"),
        )
        out = self.verified(
            written(
                met.where(
                    (F.col("n") >= F.col("least")) & (F.col("less") * 100 >= F.col("more") * self.percent)
                ).select("a", "b"),
                "star-pairs",
            )
        )
        deleted(central, pivots)
        return out

    def pairs(self, parted: DataFrame) -> DataFrame:
        """All pairs (a, b), a > b, that may be similar, of classes (rep, comp, outside) with different comp, one of them outside. Each once; a written table.

        A similar pair has a first shared shingle, within both prefixes of level one. There, at most what comes after it in either is shared: a
        set of size m with i shingles from there on is similar to none of more than (1 + t) i / t - m. So each set asks for the bands
        of sizes that it can be similar to, and of a crowd that shares a passage those that can't be similar never meet.
        """
        percent, both = self.percent, 100 + self.percent
        rest = F.col("size") - F.col("place")
        first = self.index.where("place <= base").withColumn("rest", rest)
        first = first.withColumns(
            {
                "least": F.ceil(F.col("size") * percent / 100),
                "most": F.least(
                    F.floor(F.col("size") * 100 / percent), F.floor(F.col("rest") * both / percent) - F.col("size")
                ),
            }
        )
        first = written(first.where("least <= most").join(parted, "rep"), "first-places")
        asked = F.explode(F.sequence(_size_band(F.col("least")), _size_band(F.col("most"))))
        left = first.where("outside").select(
            "token",
            asked.alias("band"),
            F.col("rep").alias("x"),
            F.col("comp").alias("p"),
            F.col("size").alias("m"),
            F.col("rest").alias("i"),
        )
        right = first.select(
            "token",
            _size_band(F.col("size")).alias("band"),
            F.col("rep").alias("y"),
            F.col("comp").alias("q"),
            F.col("size").alias("n"),
            F.col("rest").alias("j"),
        )
        enough = F.least("i", "j") * both >= percent * (F.col("m") + F.col("n"))
        met = left.join(right, ["token", "band"]).where((F.col("p") != F.col("q")) & enough)
        out = written(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs")
        deleted(first)
        return out

    def parted(self, found: DataFrame) -> DataFrame:
        """Classes of lists that hold several components (node, component): rep, comp, and whether it is outside its list's largest one."""
        labelled = written(
            self.index.select("token", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
                "token", "rep", F.coalesce("component", "rep").alias("comp")
            ),
            "labelled",
        )
        crowd = written(labelled.groupBy("token", "comp").agg(F.count("*").alias("n")), "crowd")
        main = F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main")
        largest = written(
            crowd.groupBy("token").agg(main, F.count("*").alias("comps")).where("comps > 1").drop("comps"), "largest"
        )
        out = written(
            labelled.join(largest, "token").groupBy("rep").agg(
                F.any_value("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("outside")
            ),
            "parted",
        )
        deleted(labelled, crowd, largest)
        return out

    def deleted(self) -> None:
        deleted(self.texts, self.prefixes, self.index)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")


def links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b), a > b, of classes of equal sets, and the classes' members (rep, row, doc_id, n_shingles).

    As many rows as there are links between different sets, which in a crowd of near copies are quadratic; ``groups`` needs fewer. Odd rows are taken
    as there; those without words are in no class.
    """
    rows = _rows(docs, id_col, text_col)
    join = _Join(rows, words, percent)
    every = join.classes.select("rep", F.col("rep").alias("comp"), F.lit(True).alias("outside"))
    found = join.verified(join.pairs(every))
    join.deleted()
    return found, join.features.join(join.classes, "digest").select("rep", "row", "doc_id", "n_shingles")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id for each row: the least id that it reaches by links of at least the similarity.

    Equal sets are one class. Each list's most central class is compared with the others, which settles crowds of near copies; then all
    pairs of different components that may be similar, of lists that still hold several. Pairs within a component are not compared, so n_links, the confirmed links
    of the row's class with other classes, is a lower bound. No pair of different components is left out.

    Each row is a document of its own. Null or empty text, or blanks only: n_shingles 0, linked with nothing, component_id its own id. Null ids are
    linked like others; component_id is null if no row reached has an id. Repeated rows are linked. Very long texts are taken whole, one at a time. Empty table: no rows.
    Other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    join = _Join(rows, words, percent)
    near = join.star()
    found = components(near)
    parted = join.parted(found)
    more = join.verified(join.pairs(parted))
    every = near.unionByName(more)
    found = components(every)
    degree = every.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = join.classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = written(
        named.select(
            "digest",
            "least_id",
            F.coalesce("component", "rep").alias("comp"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ),
        "named",
    )
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = written(named.join(least, "comp").select("digest", "component_id", "n_links"), "of-class")
    join.deleted()
    deleted(parted, found, near, more, named, join.classes)
    out = join.features.join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
    )
