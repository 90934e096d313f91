"""I-Match fingerprints in DataFrame operations only.

A term is a lower-cased word. The lexicon has the terms whose inverse document frequency lies in a band. A text's distinct lexicon terms
are sorted (by their hashes), and its fingerprint has a hash of them all and one of those in each of several randomised subsets of the
lexicon.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, words_of, written

#: The band of inverse document frequencies: terms in at least one of 500 and at most one of 10 documents.
LEAST_IDF, MOST_IDF = math.log(10), math.log(500)
#: Groups of disjoint random subsets of the lexicon: so many subsets, each with one in so many terms. An edit leaves a subset's hash as it was if it
#: touches none of its terms, so texts of few terms need large subsets and texts of many small ones: half of a text of 20 to 500 lexicon
#: terms goes without touching some.
GROUPS = ((16, 32), (22, 128), (22, 512))
SUBSETS = sum(n for n, _ in GROUPS)
#: A lexicon has at most 500 times as many terms as a document has on average. One of up to so many is a constant of the expression, which comes from
#: the driver (about 20 bytes a term); a larger one is joined, with a broadcast up to the second number.
CONSTANT_TERMS, BROADCAST_TERMS = 100_000, 1_000_000


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (its hash) for all terms within the band, from all documents. Distinct terms of each are counted before the shuffle. A written table."""
    n = docs.count()
    seen = docs.select(F.explode(_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # a billionth is for terms at the band's very edge
    kept = seen.where(F.ln(F.lit(float(n)) / F.col("n")).between(LEAST_IDF - 1e-9, MOST_IDF + 1e-9))
    return written(kept.select("term"), "lexicon")


def _members(bodies: DataFrame, keys: list[str], body_cols: list[str], lex: DataFrame) -> DataFrame:
    """keys, and as ``members`` an array with the lexicon terms of each body."""
    count = lex.count()
    if count <= CONSTANT_TERMS:
        boxes = 1 << max(0, (count // 8).bit_length())
        held: list[list[int]] = [[] for _ in range(boxes)]
        for r in lex.collect():
            held[r.term % boxes].append(r.term)
        # folded into a constant array once; a term looks into its own box of some eight
        known = F.from_json(F.lit(json.dumps(held)), "array<array<bigint>>")
        own = F.transform(F.array(*body_cols), lambda b: F.filter(_terms(b), lambda t: F.array_contains(F.get(known, F.pmod(t, F.lit(boxes)).cast("int")), t)))
        return bodies.select(*keys, own.alias("members"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("body")) for i, c in enumerate(body_cols)]))
    terms = bodies.select(*keys, each.alias("b")).select(*keys, "b.i", F.explode_outer(_terms(F.col("b.body"))).alias("term"))
    marked = lex.withColumn("known", F.lit(True))
    joined = terms.join(F.broadcast(marked) if count <= BROADCAST_TERMS else marked, "term", "left")
    gathered = joined.groupBy(*keys).agg(F.collect_list(F.when(F.col("known"), F.struct("i", "term"))).alias("terms"))

    def mine(i: int) -> Column:
        return F.transform(F.filter("terms", lambda t: t["i"] == i), lambda t: t["term"])

    return gathered.select(*keys, F.array(*[mine(i) for i in range(len(body_cols))]).alias("members"))


def _subsets(term: Column) -> Column:
    """(subset, term) for the subsets that a term is in: one of a group at most."""
    mark, found, first = F.xxhash64(term, F.lit("subset")), [], 0
    for g, (n, share) in enumerate(GROUPS):
        place = F.pmod(F.shiftright(mark, 16 * g), F.lit(share)).cast("int")
        found.append(F.struct(F.when(place < n, place + first).alias("subset"), term.alias("term")))
        first += n
    return F.filter(F.array(*found), lambda x: x["subset"].isNotNull())


def _hash_sorted(terms: Column) -> Column:
    """The hash of an array of terms in sorted order, null if it is empty, then those of its terms in each subset."""
    whole = F.when(F.size(terms) > 0, F.xxhash64(F.sort_array(terms)))
    marked = F.sort_array(F.flatten(F.transform(terms, _subsets)))
    nothing = F.struct(F.lit(-1).alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<struct<subset:int,hash:bigint>>").alias("done"))

    def ended(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["subset"].alias("subset"), acc["hash"].alias("hash"))))

    def further(acc: Column, x: Column) -> Column:
        same = acc["subset"] == x["subset"]
        chained = F.when(same, F.xxhash64(acc["hash"], x["term"])).otherwise(F.xxhash64(x["term"]))
        return F.struct(x["subset"].alias("subset"), chained.alias("hash"), F.when(same, acc["done"]).otherwise(ended(acc)).alias("done"))

    by_subset = F.array(F.map_from_entries(F.aggregate(marked, nothing, further, ended)))
    dense = F.transform(by_subset, lambda m: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.try_element_at(m, j)))[0]
    return F.concat(F.array(whole), dense)


def set_hashes(bodies: DataFrame, keys: list[str], body_cols: list[str], lex: DataFrame) -> DataFrame:
    """For rows that keys tell apart, keys and for each body an array of hashes: of all its sorted lexicon terms, then of the subsets.

    A text without lexicon terms has the hash of the whole text; a subset that it has nothing of is null. A very long text is a long array of
    its distinct terms.
    """
    wholes = [f"whole_{c}" for c in body_cols]
    named = bodies.withColumns({w: F.xxhash64(c) for w, c in zip(wholes, body_cols, strict=True)})
    found = _members(named, [*keys, *wholes], body_cols, lex)
    hashed = found.select(*keys, *wholes, F.transform("members", _hash_sorted).alias("hashes"))

    def of(i: int, whole: str) -> Column:
        return F.transform(F.col("hashes")[i], lambda h, j: F.when(j == 0, F.coalesce(h, F.col(whole))).otherwise(h))

    return hashed.select(*keys, *[of(i, w).alias(f"hashes_{c}") for i, (c, w) in enumerate(zip(body_cols, wholes, strict=True))])


def fingerprint(hashes: Column) -> Column:
    """As text: sixteen digits for all terms, eight for each subset, and - for a subset that the text has nothing of."""
    digits = F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-")))
    return F.concat_ws(".", F.transform(digits, lambda d, i: F.when(i == 0, d).otherwise(F.right(d, F.lit(8)))))


def likeness(x: Column, y: Column) -> Column:
    """1 for equal hashes of all terms; else the share of equal subsets among those that either text has something of."""
    pairs = F.zip_with(F.slice(x, 2, SUBSETS), F.slice(y, 2, SUBSETS), lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a == b, F.lit(False))))
    both = F.filter(pairs, lambda p: p.isNotNull())
    share = F.when(F.size(both) > 0, F.size(F.filter(both, lambda p: p)) / F.size(both)).otherwise(F.lit(0.0))
    return F.when(x[0] == y[0], F.lit(1.0)).otherwise(share)


def _edges(ids: list[int], nulls: int) -> list[tuple[int | None, int]]:
    """Where buckets begin, as (id, hash of the text): at quantiles of the ids. An id that is several of them, as null ids are, begins so many, cut by the hash."""

    def cut(key: int | None, n: int) -> list[tuple[int | None, int]]:
        return [(key, (k << 64) // n - (1 << 63)) for k in range(n)]

    return [*cut(None, max(nulls, 1))[1:], *(e for key in sorted(set(ids)) for e in cut(key, ids.count(key)))]


def _in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text) with bucket and halo, so that in each bucket, by halo, doc_id, tie (a hash of the text) and text, every row is followed by the next of the whole table.

    Buckets are ranges of doc_id and tie from the ids' quantiles, so many texts under one id, or none, fill several. The rows that a bucket begins
    with also stand, as halo, at the end of the bucket before; the first of all at the end of the last. So one shuffle by bucket is
    enough. Only copies of one text under one id can't be parted.
    """
    wanted = 4 * parts(docs.sparkSession)
    tied = docs.withColumn("tie", F.xxhash64("text"))
    seen = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 10 * wanted).alias("ids"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    given = seen.n - seen.nulls
    ids = [k for i, k in enumerate(seen.ids or []) if i % max(1, round(seen.n / given)) == 0] if given else []
    edges = _edges(ids, -(-seen.nulls * wanted // max(seen.n, 1)))
    key, tie = F.col("doc_id"), F.col("tie")
    known = F.arrays_zip(F.lit([k for k, _ in edges]).cast("array<bigint>").alias("id"), F.lit([t for _, t in edges]).cast("array<bigint>").alias("tie"))

    def begun(e: Column) -> Column:
        return F.when(e["id"].isNull(), key.isNotNull() | (e["tie"] <= tie)).otherwise(F.coalesce((e["id"] < key) | ((e["id"] == key) & (e["tie"] <= tie)), F.lit(False)))

    dealt = tied.withColumn("bucket", (F.size(F.filter(known, begun)) if edges else F.lit(0)).cast("int"))
    rows = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("low")).orderBy("bucket").collect()
    low_id: list[int | None] = [None] * (len(edges) + 1)
    low_tie: list[int | None] = [None] * (len(edges) + 1)
    before = [0] * (len(edges) + 1)
    for i, r in enumerate(rows):
        low_id[r.bucket], low_tie[r.bucket], before[r.bucket] = r.low.doc_id, r.low.tie, rows[i - 1].bucket
    own = F.col("bucket")
    first_id, first_tie, to = (F.lit(v).cast(f"array<{t}>") for v, t in ((low_id, "bigint"), (low_tie, "bigint"), (before, "int")))
    here, there = F.struct(own.alias("bucket"), F.lit(0).alias("halo")), F.struct(to[own].alias("bucket"), F.lit(1).alias("halo"))
    at = F.when(first_id[own].eqNullSafe(key) & (first_tie[own] == tie), F.array(here, there)).otherwise(F.array(here))
    return dealt.select("doc_id", "tie", "text", F.explode(at).alias("at")).select("doc_id", "tie", "text", "at.bucket", "at.halo")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has, for the last half of the text's code points, the first as many of the next text in ascending order of id, of the
    first after the last; near_next is the likeness to that text. One shuffle moves texts; all that follows is done within its buckets.

    Null text: empty. Empty texts are alike. Very long texts are taken whole. Null ids come first. Rows that share an id are in order of a hash of their text, and so repeated rows
    follow one another. A table of one row: it is its own next. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lex = lexicon(rows)
    order = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").asc_nulls_first(), "tie", "text")
    follows = _in_order(rows).withColumns({"row": F.row_number().over(order), "next": F.lead("text").over(order), "n_chars": F.char_length("text").cast("long")})
    half = "cast(n_chars div 2 as int)"
    edited = F.when(F.col("halo") == 0, F.concat(F.expr(f"substring(text, 1, cast(n_chars as int) - {half})"), F.expr(f"substring(coalesce(next, ''), 1, {half})")))
    edits = follows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    hashes = set_hashes(edits, ["bucket", "halo", "row", "doc_id", "n_chars", "edited_sha256"], ["text", "edited"], lex)
    after = F.lead("hashes_text").over(Window.partitionBy("bucket").orderBy("halo", "row"))
    known = hashes.withColumn("after", after).where("halo = 0")
    return known.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("hashes_text")).alias("fingerprint"), fingerprint(F.col("hashes_edited")).alias("edited_fingerprint"), likeness(F.col("hashes_text"), F.col("hashes_edited")).alias("near_edited"), likeness(F.col("hashes_text"), F.col("after")).alias("near_next"))
