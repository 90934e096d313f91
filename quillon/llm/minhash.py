"""Near-duplicates by MinHash: many universal hash minima, banding, signature verification, exact confirmation, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILAR_PERCENT, deleted, fresh, give_back, small_batches, written
from .components import components

#: A pair at similarity s meets in no band with probability (1 - s^4)^32: 5e-6 at 0.75.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Of 128 minima, pairs at 0.75 agree in 96 with a deviation of 4.9; fewer than this is over six deviations off.
LEAST_AGREE = 66
#: Sizes of sets are told apart by bands, each 5 % wider than the one before.
SIZE_BAND = 1.05


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of x -> a x + b modulo 2^64."""
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct k-word shingles, of its whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, these know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, size = max(1, len(h) - k + 1), min(k, len(h))
    rolled = np.full(n, np.uint64(size))
    for i in range(size):
        rolled = _mixed(rolled + h[i : i + n])
    return np.unique(rolled)


def signature(shingles: np.ndarray) -> np.ndarray:
    a, b = _family()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        for j in range(0, HASHES, 16):
            out[j : j + 16] = np.minimum(out[j : j + 16], (a[j : j + 16, None] * part + b[j : j + 16, None]).min(axis=1))
    return out


_FEATURES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("minima", pa.binary())])


def _feature(text: str | None) -> tuple[int, bytes | None, np.ndarray | None, bytes | None]:
    shingles = shingle_set(text)
    if not len(shingles):
        return 0, None, None, None
    minima = signature(shingles)
    bands = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        bands = _mixed(bands + minima[r::ROWS])
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return len(shingles), digest, bands.view(np.int64), minima.astype(np.uint16).tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = zip(*map(_feature, part.column(2).to_pylist()), strict=True)
            made = [pa.array(list(values), f.type) for values, f in zip(found, list(_FEATURES)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], schema=_FEATURES)
    give_back()


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature verification of pairs (a, b, minima of both)."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREE))


def _prefix_length(n: int) -> int:
    """Of sets with similarity SIMILAR_PERCENT or more, so many of the first elements of either, in one order for all, hold a common one."""
    return n - -(-SIMILAR_PERCENT * n // 100) + 1


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shingles = shingle_set(text).view(np.int64)
            n = len(shingles)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rep)), pa.array(np.full(n, n, np.int32)), pa.array(np.full(n, _prefix_length(n), np.int32)), pa.array(shingles)], ["rep", "size", "prefix", "shingle"])
    give_back()


def similar_sets(x: np.ndarray, y: np.ndarray, percent: int = SIMILAR_PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}  # b names one text

    def of(b: int, text: str) -> np.ndarray:
        if b not in kept:
            if len(kept) > 64:
                kept.clear()
            kept[b] = shingle_set(text)
        return kept[b]

    for batch in batches:
        b, x, y = (batch.column(i).to_pylist() for i in (1, 2, 3))
        ok = [similar_sets(shingle_set(p), of(j, q)) for j, p, q in zip(b, x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    kept.clear()
    give_back()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar. texts: row (each once), text. b may be a hub: that join is skew-split."""
    pairs = written(pairs.distinct(), "pairs")
    first = written(pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a"), "first")
    joined = first.join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    out = written(joined.mapInArrow(_confirmed, "a long, b long"), "links")
    deleted(first, pairs)
    return out


def _size_band(size: Column) -> Column:
    return F.floor(F.ln(size) / F.lit(math.log(SIZE_BAND))).cast("int")


def _contested_pairs(contested: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of contested classes (rep, comp, outside) of different components that may be similar.

    They share a shingle of both prefixes, and their sizes fit: at a pair's first common shingle both have at most what comes after it in
    common, so a set of size m with i shingles from there on is similar to none of more than 175 i / 75 - m. The
    join's key has a band of sizes as well, and a set asks only for the bands that it can be similar to, so of a crowd made from
    one template those that can't be similar never meet.
    """
    percent, both = SIMILAR_PERCENT, 100 + SIMILAR_PERCENT
    own = texts.join(contested.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "text")
    occurring = written(own.mapInArrow(_occurrences, "rep long, size int, prefix int, shingle long"), "occurring")
    often = written(occurring.groupBy("shingle").agg(F.count("*").alias("n")), "often")
    ordered = occurring.join(often, "shingle").groupBy("rep", "size", "prefix").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    prefix = F.slice("all", F.lit(1), F.col("prefix"))
    first = ordered.select("rep", "size", F.posexplode(prefix).alias("place", "e")).where("e.n > 1").select("rep", "size", "place", F.col("e.shingle").alias("shingle"))
    rest = F.col("size") - F.col("place")
    first = first.withColumns({"rest": rest, "least": F.ceil(F.col("size") * percent / 100), "most": F.least(F.floor(F.col("size") * 100 / percent), F.floor(rest * both / percent) - F.col("size"))})
    first = written(first.where("least <= most").join(contested, "rep"), "prefixes")
    deleted(occurring, often)
    asked = F.explode(F.sequence(_size_band(F.col("least")), _size_band(F.col("most"))))
    left = first.where("outside").select("shingle", asked.alias("band"), F.col("rep").alias("x"), F.col("comp").alias("p"), F.col("size").alias("m"), F.col("rest").alias("i"))
    right = first.select("shingle", _size_band(F.col("size")).alias("band"), F.col("rep").alias("y"), F.col("comp").alias("q"), F.col("size").alias("n"), F.col("rest").alias("j"))
    enough = F.least("i", "j") * both >= percent * (F.col("m") + F.col("n"))
    pairs = left.join(right, ["shingle", "band"]).where((F.col("p") != F.col("q")) & enough)
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, doc_id, text), a written table whose ``row`` is unique: features of each row, and of each digest: comp, component_id, n_links.

    Equal shingle sets are first made one class, named by its least row, so copies cost one row. Classes that share a band go
    into a bucket. First, each bucket's most central class (the one with the largest buckets in all) is compared with the
    others, which links a crowd of copies to what they were copied from. Some buckets then still hold several components. Their
    classes are contested: those outside their bucket's largest component are compared with all other contested classes of
    other components that share one of their rarest shingles. That is exact: of similar sets, the rarest n - ceil(0.75 n) + 1
    shingles of each hold a common one. So what differs in over a quarter from all others is settled without a
    comparison. Links count only once confirmed on full sets; there is no cap, and pairs of one component are not compared.
    """
    kinds = "row long, doc_id long, n_shingles long, digest binary, bands array<long>, minima binary"
    features = written(rows.select("row", "doc_id", "text").mapInArrow(_features, kinds), "features")
    by_set = features.where("digest is not null").groupBy("digest")
    classes = written(by_set.agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"), F.any_value("minima").alias("minima")), "classes")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    sizes = written(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = written(banded.join(sizes, "key"), "members")
    central = written(members.groupBy("rep").agg(F.sum("size").alias("weight")), "central")
    pivots = written(members.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("b")), "pivots")
    star = written(members.join(pivots, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "star-pairs")

    minima = classes.select("rep", "minima")
    half = written(star.join(minima.withColumnsRenamed({"rep": "a", "minima": "x"}), "a"), "half")
    whole = half.join(minima.withColumnsRenamed({"rep": "b", "minima": "y"}), "b").select("a", "b", "x", "y")
    texts = written(rows.join(central.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi").select("row", "text"), "texts")
    links = confirm(whole.mapInArrow(_agreeing, "a long, b long"), texts)
    deleted(star, half, pivots, central, sizes)

    found = components(links)
    own = members.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = written(own.select("key", "rep", F.coalesce("component", "rep").alias("comp")), "labelled")
    deleted(members, found)
    crowd = written(labelled.groupBy("key", "comp").agg(F.count("*").alias("n")), "crowd")
    main = F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main")
    largest = written(crowd.groupBy("key").agg(main, F.count("*").alias("comps")).where("comps > 1").drop("comps"), "largest")
    outside = F.max(F.col("comp") != F.col("main")).alias("outside")
    contested = written(labelled.join(largest, "key").groupBy("rep").agg(F.any_value("comp").alias("comp"), outside), "contested")
    more = confirm(_contested_pairs(contested, texts), texts)
    deleted(labelled, crowd, largest, contested, texts)

    every = links.unionByName(more)
    found = components(every)
    degree = every.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "rep", "least_id").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = written(named.select("digest", "least_id", F.coalesce("component", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = written(named.join(least, "comp").select("digest", "comp", "component_id", "n_links"), "of-class")
    deleted(named, found, links, more, classes)
    return features, of_class


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, component_id and kept for each row.

    Each row is a document of its own, told apart by where it stands, so rows that share an id but not a text are linked by what
    they hold alone. component_id is the least id that a row reaches, its own included; kept: that is its own.
    n_links is the number of confirmed links of the row's class to other classes; a lower bound of all that
    there are, as known components need no more.

    Null or empty text, or blanks only: n_shingles 0, linked with nothing. Null ids are linked like others; component_id is null if no
    row reached has an id. Repeated rows are linked, and kept alike; ``keep_one`` keeps one of them. Very long texts are taken whole, one at a
    time. Empty table: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(slim.withColumn("row", F.monotonically_increasing_id()), "rows")
    features, of_class = _groups(rows)
    deleted(rows)
    out = features.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return out.select("doc_id", "n_shingles", links, component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of least id, and all rows without words; docs' columns.

    Of rows that share the least id, the first by place. Rows are dropped, not ids: another text under the id of a dropped one stays. Null ids
    come after all others. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    (place,) = fresh(docs, "row")
    rows = written(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    features, of_class = _groups(rows.select(F.col(place).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    grouped = written(features.where("digest is not null").select("row", "doc_id", "digest").join(of_class, "digest").select("row", "doc_id", "comp"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keepers = grouped.groupBy("comp").agg(first).select(F.col("first.row").alias("row"))
    gone = written(grouped.select("row").join(keepers, "row", "left_anti"), "gone")
    deleted(features, of_class, grouped)
    return rows.join(gone.withColumnRenamed("row", place).hint("merge"), place, "left_anti").select(*docs.columns)
