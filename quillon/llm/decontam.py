"""Benchmark decontamination by SimHash of item-sized windows and exact weighted shingles, in DataFrame operations only.

1. What a document and an item can share: the document's shingles that the item has, with their places. A pair with fewer of
   them than the threshold asks for can't be similar, wherever the window is, and ends here.
2. Each run of shared shingles gives one window of the item's length, begun where the item would begin. Windows and items have 64-bit
   SimHash fingerprints of their words. A fingerprint is cut into RADIUS + 1 blocks; fingerprints within RADIUS agree in one
   block at least, so the index by item and block finds all of them. An item's blocks meet windows of pairs of step 1 only, however many
   items there are.
3. Of each pair found, the best window of any length is decided by the exact similarity of weighted shingles (shared weight by all weight;
   a shingle weighs as often as it occurs). The best window begins and ends with a shingle that counts as shared, as leaving out one
   that doesn't raises the similarity; so the spans between shared shingles are all that need be tried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILAR_PERCENT, deleted, fresh, parts, words_of, written

#: A window of the item's length around a similar span has three quarters of the item's words or nearly so (a copy cut by a quarter; two
#: thirds if foreign words stand in its middle): the fingerprints differ in 14.7 bits on average with a deviation of 3.4.
RADIUS = 28
#: Tables of up to so many rows (some 50 bytes each) are broadcast after counting them; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
_LANES = 0x0000000100000001
_PAIR = ["doc_id", "body", "item_id", "item_body", "n"]


def _hashed(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def _shingles(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """The hashes of an array's k-word shingles, of the whole if it is shorter; none if it is empty."""
    count = F.least(F.size(words), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    # places after the last word are null, and a hash passes over nulls
    rolled = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(rolled, F.lit(1), count)


def with_simhash(df: DataFrame, words: str, to: str) -> DataFrame:
    """df with the 64-bit SimHash of an array of word hashes: each bit by majority. Two counters of 32 bits share a sum."""

    def counted_from(k: int) -> Column:
        return F.aggregate(words, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))

    names = fresh(df, *[f"sum{k}" for k in range(32)])
    counted = df.withColumns({name: counted_from(k) for k, name in enumerate(names)})

    def bit(k: int, lane: int) -> Column:
        value = 1 << (32 * lane + k)
        most = F.shiftrightunsigned(names[k], 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.size(words)
        return F.when(most, F.lit(value - (1 << 64 if value >> 63 else 0))).otherwise(F.lit(0).cast("long"))

    bits = [bit(k, lane) for k in range(32) for lane in range(2)]
    return counted.withColumn(to, reduce(lambda a, b: a.bitwiseOR(b), bits)).drop(*names)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The fingerprint's radius + 1 blocks, each with its number: of two within the radius, one block at least is equal."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * 64 + i for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _best_span(matches: Column, m: Column, percent: int) -> Column:
    """Of matches (place, before), by place: similarity, -start, -size and shared weight of the best span, against m shingles.

    before: the place up to which a span must begin after for the match to count, as an item's shingle counts as often as it occurs there.
    """
    most, need = F.floor(100 * m / percent).cast("int"), F.ceil(m * percent / 100).cast("int")

    def from_start(x: Column, i: Column) -> Column:
        def longer(acc: Column, y: Column) -> Column:
            size, shared = y["place"] - x["place"] + 1, acc["shared"] + (y["before"] < x["place"]).cast("int")
            similarity = shared / (size + m - shared)
            best = F.struct(similarity.alias("similarity"), (-x["place"]).alias("start"), (-size).alias("size"), shared.alias("shared"))
            return F.struct(shared.alias("shared"), F.when((size <= most) & (similarity > acc["best"]["similarity"]), best).otherwise(acc["best"]).alias("best"))

        nothing = F.struct(F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("shared"))
        scanned = F.aggregate(F.slice(matches, i + 1, most), F.struct(F.lit(0).alias("shared"), nothing.alias("best")), longer, lambda acc: acc["best"])
        # without enough matches within reach, no span from here is similar enough
        return F.when(F.get(matches, i + need - 1)["place"] - x["place"] < most, scanned)

    return F.array_max(F.transform(matches, from_start))


def _held(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item_body, n, item_print), and a row for each and each of its shingles: weight, first (its first place), prior (the shingle
    before that place, where it stands there first as well)."""
    words = benchmark.select("item_id", _hashed(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    # an item without an id is told apart by its words, as are items that share an id
    named = words.select("item_id", F.xxhash64("words").alias("item_body"), F.size("words").alias("n"), "words")
    items = written(with_simhash(named.withColumn("shingles", _shingles(F.col("words"))), "words", "item_print"), "items")
    placed = items.select(*_PAIR[2:], F.posexplode("shingles").alias("at", "shingle"))
    owned = placed.groupBy(*_PAIR[2:], "shingle").agg(F.count("*").cast("int").alias("weight"), F.min("at").alias("first"))
    before = owned.select("item_id", "item_body", F.col("first").alias("ended"), F.col("shingle").alias("prior"))
    same = F.col("o.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("o.item_body") == F.col("b.item_body")) & (F.col("o.first") == F.col("b.ended") + 1)
    own = owned.alias("o").join(before.alias("b"), same, "left").select(*[f"o.{c}" for c in _PAIR[2:]], "shingle", "weight", "first", "prior")
    return items, written(own, "own-shingles")


def _matches(docs: DataFrame, own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body (a hash of the text), item, shingle, weight, place of all that documents share with items; and where a run of them begins, the place at which the
    item would have begun. A shingle's row has its place and no text, so bytes grow with the text, whatever the number of items."""
    # items of fewer words than a shingle are found by shingles of as many words: at most four more lengths
    short = [r.n for r in own.select("n").where(F.col("n") < SHINGLE_WORDS).distinct().collect()]
    text = F.col(text_col).cast("string")
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("body"), _hashed(text).alias("words"))

    # as columns of their own, so that a lambda looks into an array that is there
    lengths = (SHINGLE_WORDS, *short)
    made = words.withColumns({f"shingles{k}": _shingles(F.col("words"), k) for k in lengths})

    def placed(name: str) -> Column:
        return F.transform(name, lambda s, i: F.struct(i.alias("place"), s.alias("shingle"), F.get(name, i - 1).alias("last")))

    arrays = made.select("doc_id", "body", F.concat(*[placed(f"shingles{k}") for k in lengths]).alias("every"))
    # outer, as else a filter on the array's size is put below the projections that make it and makes it again for each element
    found = arrays.select("doc_id", "body", F.explode_outer("every").alias("s")).select("doc_id", "body", "s.*").join(_held(own), "shingle")
    begin = F.when(~F.col("last").eqNullSafe(F.col("prior")) | F.col("prior").isNull(), F.col("place") - F.col("first"))
    return written(found.select(*_PAIR, "shingle", "weight", "place", begin.alias("begin")), "matches")


def _windows(docs: DataFrame, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pair, item_id, item_body and window (the hashes of its words) of heads (pair, doc_id, body, item_id, item_body, n, begin): the texts are read again, of these documents alone."""
    of_text = heads.groupBy("doc_id", "body").agg(F.collect_list(F.struct("pair", "item_id", "item_body", "n", "begin")).alias("heads"))
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_body"), text.alias("text"))
    met = own.join(of_text, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_body") == F.col("body")))
    # repeated rows of a document have the same windows, which changes nothing
    words = met.withColumn("words", _hashed(F.col("text")))

    def window(h: Column) -> Column:
        return F.slice("words", F.greatest(h["begin"], F.lit(0)) + 1, F.greatest(h["n"] + F.least(h["begin"], F.lit(0)), F.lit(1)))

    made = words.select(F.explode(F.transform("heads", lambda h: F.struct(h["pair"].alias("pair"), h["item_id"].alias("item_id"), h["item_body"].alias("item_body"), window(h).alias("window")))).alias("w"))
    return made.select("w.*").where(F.size("window") > 0)


def _similar(docs: DataFrame, benchmark: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body, item_id, start_word, n_words, similarity, distance of the best window of each text and item; a written table."""
    items, own = _items(benchmark)
    matches = _matches(docs, own, id_col, text_col)
    # repeated rows of a document give the same places
    at = matches.groupBy(*_PAIR, "shingle", "weight").agg(F.array_sort(F.collect_set("place")).alias("at"))
    marked = F.transform("at", lambda p, t: F.struct(p.alias("place"), F.coalesce(F.get("at", t - F.col("weight")), F.lit(-1)).alias("before")))
    grouped = at.groupBy(*_PAIR).agg(F.array_sort(F.flatten(F.collect_list(marked))).alias("matches"))
    m = F.greatest(F.col("n") - SHINGLE_WORDS + 1, F.lit(1))
    pairs = written(grouped.where(100 * F.size("matches") >= percent * m).withColumn("pair", F.monotonically_increasing_id()), "pairs")

    # the windows of these pairs, and their fingerprints; no table of pairs is broadcast, whatever its size is thought to be
    heads = matches.where("begin is not null").select(*_PAIR, "begin").distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}")) for c in _PAIR])
    begun = written(heads.alias("h").join(pairs.select("pair", *_PAIR).alias("p").hint("merge"), same).select("p.pair", *[f"h.{c}" for c in _PAIR], "h.begin"), "heads")
    printed = written(with_simhash(_windows(docs, begun, id_col, text_col), "window", "print").drop("window"), "windows")
    index = items.select(F.col("item_id").alias("id"), F.col("item_body").alias("of_body"), "item_print", F.explode(blocks(F.col("item_print"))).alias("of_block"))
    asked = printed.withColumn("block", F.explode(blocks(F.col("print"))))
    met = asked.join(_held(index), F.col("item_id").eqNullSafe(F.col("id")) & (F.col("item_body") == F.col("of_body")) & (F.col("block") == F.col("of_block")))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).cast("long")
    near = met.select("pair", distance.alias("distance")).where(F.col("distance") <= RADIUS).groupBy("pair").agg(F.min("distance").alias("distance"))

    # pairs are small and the work on them isn't, so they are dealt out by number; written, so that spans are tried once
    spread = pairs.join(near.hint("merge"), "pair").repartition(parts(docs.sparkSession))
    tried = written(spread.select(*_PAIR, "distance", _best_span(F.col("matches"), m, percent).alias("b")), "spans")
    sure = tried.where(100 * F.col("b.shared") >= percent * (m - F.col("b.size") - F.col("b.shared")))
    start, size = (-F.col("b.start")).cast("long"), (-F.col("b.size") - 1 + F.least("n", F.lit(SHINGLE_WORDS))).cast("long")
    out = written(sure.select("doc_id", "body", "item_id", start.alias("start_word"), size.alias("n_words"), "distance", "b.similarity"), "similar")
    deleted(items, own, matches, pairs, begun, printed, tried)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = SIMILAR_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document and item that it holds: doc_id, item_id, start_word, n_words, distance, similarity of the best window.

    distance: the least between the item's fingerprint and a window's of its length. Words are lower-cased. Items of fewer than five
    words are one shingle and so are found as they are; items without words or text are found nowhere. Null, empty or blank texts hold
    nothing. Ties: the first, then the shortest window. Repeated rows of a document or of an item give one row, as do several texts under one
    id (the best). Null ids are kept as null, and are one document. Very long texts are taken whole; the trial of spans grows with the
    square of the item's length, not of the text's. Empty tables: no rows. Other columns are not read.
    """
    found = _similar(docs, benchmark, percent, id_col, text_col)
    rank = F.struct("similarity", -F.col("start_word"), -F.col("n_words"))
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "distance", "similarity"), rank).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = SIMILAR_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; docs' columns.

    A row goes by its id and text: other texts under its id stay, repeated rows go together, and rows without an id go like others. Null, empty
    and blank texts stay. Empty tables: docs as they are.
    """
    found = _similar(docs, benchmark, percent, id_col, text_col)
    held = written(found.select(F.col("doc_id").alias("held_id"), F.col("body").alias("held_body")).distinct(), "leaking")
    deleted(found)
    few = held.count() <= BROADCAST_ROWS
    taken, own = fresh(docs, "held_id", "held_body")
    held = held.withColumnsRenamed({"held_id": taken, "held_body": own})
    key = F.col(id_col).eqNullSafe(F.col(taken)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(own))
    return docs.join(F.broadcast(held) if few else held.hint("merge"), key, "left_anti")
