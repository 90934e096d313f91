"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ±1. A trigram binds three of them (multiplied after rotating the first by two
places and the second by one), a text bundles its trigrams (adds them up), a language bundles its texts, and a text has
the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, small_batches

DIMENSIONS = 512
#: The sample to learn from: about so many texts of each language, chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: For the share of a text in a language, texts are cut into stretches of about so many trigrams, and vectors are longer, as stretches are short.
STRETCH, STRETCH_DIMENSIONS = 150, 2048
#: A stretch is in a language whose prototype its trigrams are at least so near, on average, as a part of what the language's own trigrams are. Of whole
#: held-out texts of sf0.01 none is lost, of their first 15, 30 and 60 characters 1 in 1,000; of junk of two words 8 in 1,000 are near enough, of five none.
NEAR_ENOUGH = 0.45
#: A text is in its languages by this share of its trigrams at least.
LEAST_SHARE = 0.5
_BATCH, _COLUMNS, _CACHE = 64, 4096, 1 << 15


_NO_WORD = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _numbers() -> dict[str, str]:
    """Number letters, fractions and the like, which re counts among word characters, each with a space. As a class of re they would be tried one by one."""
    every = map(chr, range(sys.maxunicode + 1))
    return {c: " " for c in every if c.isnumeric() and not c.isalpha() and not c.isdecimal()}


def letters_of(text: str, between: str = " ") -> str:
    """The text's runs of letters, with ``between`` for all that is none."""
    if not text.isascii() and not _numbers().keys().isdisjoint(text):
        text = text.translate(str.maketrans(_numbers()))
    return _NO_WORD.sub(between, text)


class Trigrams:
    """Trigram vectors, made on demand from a seed; about ``cache`` are kept."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7, cache: int = _CACHE):
        self.dimensions, self.seed, self.cache, self.letters, self.kept = dimensions, seed, cache, {}, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > self.cache:
                self.letters.clear()
            self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[code]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(self.kept) > self.cache:
            self.kept.clear()
        out = np.empty((len(codes), self.dimensions), np.int8)
        for i, code in enumerate(codes.tolist()):
            v = self.kept.get(code)
            if v is None:
                a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
                v = self.kept[code] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            out[i] = v
        return out

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of all whole texts, and the place of the text that each is in."""
        spaced = [letters_of((t or "").lower()).strip() for t in texts]
        joined = "  ".join(["", *spaced, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(texts) + 1), [2, *(len(s) + 2 for s in spaced)])
        # a text stands between two spaces of its own: one before, one after
        a, b, c = code[:-2], code[1:-1], code[2:]
        own = (b != 32) | ((a != 32) & (c != 32))
        gram = (a << 42 | b << 21 | c)[own]
        # the place after the last letter belongs to the same text
        return gram, np.clip(doc[2:][own] - 1, 0, len(texts) - 1)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A unit vector for each whole text; zeros without letters."""
        gram, of = self.codes(texts)
        keys, back = np.unique(gram, return_inverse=True)
        sums = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(keys), _COLUMNS):
            here = (back >= at) & (back < at + _COLUMNS)
            width = min(_COLUMNS, len(keys) - at)
            counts = np.bincount(of[here] * width + back[here] - at, minlength=len(texts) * width).reshape(len(texts), width)
            sums += counts.astype(np.float32) @ self.vectors(keys[at : at + width]).astype(np.float32)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)


@dataclass(frozen=True)
class LanguageProfiles:
    """What is learned: the languages, a prototype for each, less what all have in common, as a unit vector, and what they have in common."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    common: np.ndarray

    def score(self, bundles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest prototype's place and its cosine, 0 at least."""
        centred = bundles - self.common
        norm = np.linalg.norm(centred, axis=1, keepdims=True)
        cosine = np.divide(centred, norm, out=np.zeros_like(centred), where=norm > 0) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            yield batch.slice(at, _BATCH)


def _sample(labelled: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, dict[str, float]]:
    """lang and text of a bounded sample, in 32 partitions: about ``per_language`` texts of each language, by a hash of the id. And each language's rate."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rates = {r[0]: min(1.0, per_language / r[1]) for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    taught = known.where(_taught(rates, id_col, text_col, lang_col)) if rates else known.limit(0)
    return taught.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).repartition(32), rates


def _taught(rates: dict[str, float], id_col: str, text_col: str, lang_col: str) -> Column:
    """Whether a row is in the sample."""
    rate = F.create_map(*[F.lit(x) for k, r in rates.items() for x in (k, r)])[F.col(lang_col).cast("string")] if rates else F.lit(0.0)
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")), F.lit(1 << 20)) < rate * (1 << 20)
    return F.coalesce(drawn & F.col(text_col).isNotNull(), F.lit(False))


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageProfiles:
    """Prototypes from a bounded sample: about ``per_language`` texts of each language, or all where there are fewer.

    The sample is by a hash of the id, at a rate from the exact count of each language. Tasks send one sum for each
    language to the driver; the sample has 32 of them. Null languages, null texts and texts without letters teach nothing;
    without any label there are no languages. Very long texts are taken in whole. Repeated rows each teach. Other columns are not read.
    """
    small_batches(labelled.sparkSession)
    sample, rates = _sample(labelled, per_language, id_col, text_col, lang_col)
    if not rates:
        return LanguageProfiles((), np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Trigrams(), {}
        for part in _tables(batches):
            for lang, v in zip(part.column(0).to_pylist(), grams.bundle(part.column(1).to_pylist()), strict=True):
                n, old = total.get(lang, (0, np.zeros(DIMENSIONS)))
                total[lang] = (n + 1, old + v)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([n for n, _ in total.values()]), pa.array([v.tolist() for _, v in total.values()], pa.list_(pa.float64()))], ["lang", "n", "v"])

    found: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for r in sample.mapInArrow(sums, "lang string, n long, v array<double>").collect():
        found[r.lang] = found.get(r.lang, 0) + np.array(r.v)
        seen[r.lang] = seen.get(r.lang, 0) + r.n
    names = tuple(sorted(k for k, v in found.items() if np.any(v)))
    means = np.array([found[k] / seen[k] for k in names]).reshape(-1, DIMENSIONS)
    common = means.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    own = means - common
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    return LanguageProfiles(names, own.astype(np.float32), common.astype(np.float32))


def identify(docs: DataFrame, profiles: LanguageProfiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from whole texts, in one pass without a shuffle: the language whose prototype is nearest by cosine.

    ``und`` with score 0: null text, no letters, or no language learned.
    Repeated rows each get the same answer; of equal scores, the first language by name; columns lang_pred and score of docs
    are replaced. Very long texts are taken in whole, one batch of texts at a time. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = rest.index(text_col)
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams()
        for part in _tables(batches):
            texts = [None if t is None else str(t) for t in part.column(place).to_pylist()]
            bundles = grams.bundle(texts)
            if profiles.languages:
                best, score = profiles.score(bundles)
                known = bundles.any(axis=1)
            else:
                best, score, known = np.zeros(len(bundles), int), np.zeros(len(bundles)), np.zeros(len(bundles), bool)
            lang = [profiles.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])
    return docs.mapInArrow(predict, schema)


@dataclass(frozen=True)
class StretchProfiles:
    """What is learned of stretches: for each language the sum of its texts' unit bundles, the sum of all their trigrams, and the number of these. rates: of the sample."""

    languages: tuple[str, ...]
    bundles: np.ndarray
    stretches: np.ndarray
    counts: np.ndarray
    rates: dict[str, float]

    def prototypes(self) -> np.ndarray:
        return self.bundles / np.maximum(np.linalg.norm(self.bundles, axis=1, keepdims=True), 1e-12)

    def usual(self) -> np.ndarray:
        """How near a language's own trigrams are to its prototype, on average."""
        return (self.stretches * self.prototypes()).sum(axis=1) / np.maximum(self.counts, 1)

    def without(self, language: str, bundle: np.ndarray, stretches: np.ndarray, count: int) -> StretchProfiles:
        """The profiles as they were without one text of a language."""
        own = np.array([k == language for k in self.languages])
        return StretchProfiles(self.languages, self.bundles - own[:, None] * bundle, self.stretches - own[:, None] * stretches, self.counts - own * count, self.rates)


def stretched(codes: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For the trigrams of so many texts, in order: the number of each one's stretch, and the text of each stretch. A text has one for each STRETCH trigrams, of equal lengths, and one at least."""
    n = np.bincount(of, minlength=texts)
    own = np.maximum(n // STRETCH, 1)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(own) - own)[of] + place * own[of] // np.maximum(n, 1)[of], np.repeat(np.arange(texts), own)


def _taught_by(grams: Trigrams, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a text: the unit bundle of its distinct trigrams, the sum of all its trigrams, and their number."""
    codes, _ = grams.codes([text])
    keys, times = np.unique(codes, return_counts=True)
    bundle, total = np.zeros(grams.dimensions), np.zeros(grams.dimensions)
    for at in range(0, len(keys), 1024):
        v = grams.vectors(keys[at : at + 1024]).astype(np.float32)
        bundle += v.sum(axis=0)
        total += times[at : at + 1024].astype(np.float32) @ v
    norm = np.linalg.norm(bundle)
    return bundle / norm if norm > 0 else bundle, total, len(codes)


def learn_stretches(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> StretchProfiles:
    """Prototypes for the share of a text in a language, from the sample that ``learn`` takes, and as there for odd rows.

    Here a text bundles its distinct trigrams. In the prototype a text weighs as much as another, however long, so a label on junk teaches next to
    nothing; in what is usual each trigram counts.
    """
    small_batches(labelled.sparkSession)
    sample, rates = _sample(labelled, per_language, id_col, text_col, lang_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Trigrams(STRETCH_DIMENSIONS, cache=4096), {}
        for part in _tables(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = _taught_by(grams, text)
                total[lang] = tuple(a + b for a, b in zip(total[lang], own, strict=True)) if lang in total else own
        if total:
            made = [pa.array([t[i].tolist() for t in total.values()], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(total), *made, pa.array([t[2] for t in total.values()], pa.int64())], ["lang", "bundles", "stretches", "n"])
        del grams
        give_back()

    found: dict[str, list] = {}
    rows = sample.mapInArrow(sums, "lang string, bundles array<double>, stretches array<double>, n long").collect() if rates else []
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        old = found.get(r.lang, [0.0, 0.0, 0])
        found[r.lang] = [old[0] + np.array(r.bundles), old[1] + np.array(r.stretches), old[2] + r.n]
    names = tuple(sorted(k for k, v in found.items() if v[2]))
    empty = np.zeros((0, STRETCH_DIMENSIONS))
    return StretchProfiles(names, np.array([found[k][0] for k in names]) if names else empty, np.array([found[k][1] for k in names]) if names else empty, np.array([found[k][2] for k in names], np.int64), rates)


class _Projections:
    """How near trigrams are to the prototypes; each is worked out once.

    Trigrams of the first 63 letters that come, and the space, have a place in a table; others are looked up in order, and about ``most`` of these are kept.
    """

    def __init__(self, grams: Trigrams, prototypes: np.ndarray, most: int = 1 << 16):
        self.grams, self.prototypes, self.most = grams, prototypes.astype(np.float32), most
        self.codes, self.values = np.empty(0, np.int64), np.empty((0, len(prototypes)), np.float32)
        self.number, self.letters = np.full(sys.maxunicode + 1, -1, np.int8), [32]
        self.number[32] = 0
        self.table, self.known = np.empty((1 << 18, len(prototypes)), np.float32), np.zeros(1 << 18, bool)

    def _made(self, keys: np.ndarray) -> np.ndarray:
        parts = [self.grams.vectors(keys[at : at + 1024]).astype(np.float32) @ self.prototypes.T for at in range(0, len(keys), 1024)]
        return np.concatenate(parts) if parts else self.values[:0]

    def _sorted(self, keys: np.ndarray) -> np.ndarray:
        """For sorted distinct trigrams."""
        new = keys[~np.isin(keys, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) > self.most:
                self.codes, self.values, new = np.empty(0, np.int64), self.values[:0], keys
            codes, values = np.concatenate([self.codes, new]), np.concatenate([self.values, self._made(new)])
            order = np.argsort(codes)
            self.codes, self.values = codes[order], values[order]
        return self.values[np.searchsorted(self.codes, keys)]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """For trigrams in any order: a row for each."""
        letters = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        if len(self.letters) < 64:
            for letter in np.unique(letters[1][self.number[letters[1]] < 0])[: 64 - len(self.letters)].tolist():
                self.number[letter] = len(self.letters)
                self.letters.append(letter)
        a, b, c = (self.number[x].astype(np.int32) for x in letters)
        place, common = a << 12 | b << 6 | c, np.minimum(np.minimum(a, b), c) >= 0
        out = np.empty((len(codes), len(self.prototypes)), np.float32)
        own = place[common]
        if len(missing := np.unique(own[~self.known[own]])):
            held = np.array(self.letters, np.int64)
            self.table[missing] = self._made(held[missing >> 12] << 42 | held[missing >> 6 & 63] << 21 | held[missing & 63])
            self.known[missing] = True
        out[common] = self.table[own]
        if len(own) < len(codes):
            keys, back = np.unique(codes[~common], return_inverse=True)
            out[~common] = self._sorted(keys)[back]
        return out


def _portions(texts: list[str | None], most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Texts in portions of so many characters or of one text, so that memory grows with the longest text alone."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        if i > low and size + len(text or "") > most:
            yield low, i
            low, size = i, 0
        size += len(text or "")
    if texts:
        yield low, len(texts)


def _shares(texts: list[str | None], grams: Trigrams, near: _Projections, usual: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language (its place, -1 for none), which most of the trigrams in wanted languages are in, and their share."""
    codes, of = grams.codes(texts)
    stretch, text = stretched(codes, of, len(texts))
    values, size = near.of(codes), np.bincount(stretch, minlength=len(text))
    nearness = np.column_stack([np.bincount(stretch, values[:, j], len(text)) / np.maximum(size, 1) for j in range(len(usual))])
    ratio = np.where(usual > 0, nearness / np.where(usual > 0, usual, 1.0), -np.inf)
    best = ratio.argmax(axis=1)
    inside = (ratio[np.arange(len(text)), best] >= NEAR_ENOUGH) & wanted[best]
    votes = np.zeros((len(texts), len(usual)))
    np.add.at(votes, (text[inside], best[inside]), size[inside])
    total = np.bincount(of, minlength=len(texts))
    return np.where(votes.any(axis=1), votes.argmax(axis=1), -1), votes.sum(axis=1) / np.maximum(total, 1)


def within(docs: DataFrame, profiles: StretchProfiles, wanted: tuple[str, ...] | None = None, least: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred and share: the share of a text's trigrams that stand in stretches of the wanted languages (all that are learned, if not given).

    A stretch is in the language that it is nearest to, as a part of what that language's own stretches are, if that part is NEAR_ENOUGH at least. One rule for
    all lengths: a text of fewer trigrams than a stretch is one. lang_pred is the language that most of these trigrams are in, and ``und`` if
    the share is below ``least``, for null texts, texts without letters, and if no language was learned. A text of the sample
    is judged by what the others have taught: labels and copies of its own row apart, one's own label never speaks for a text.

    docs must have id and language, by which the sample was drawn. Repeated rows get the same answer. Very long texts are taken in whole. Columns lang_pred
    and share of docs are replaced. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "share")]
    place = rest.index(text_col)
    (flag,) = fresh(docs, "taught_as")
    label = F.when(_taught(profiles.rates, id_col, text_col, lang_col), F.col(lang_col).cast("string"))
    given = docs.select(*[F.col(f"`{c}`") for c in rest], label.alias(flag))
    names = profiles.languages
    asked = np.array([wanted is None or k in wanted for k in names], bool)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams(STRETCH_DIMENSIONS, cache=4096)
        near, usual = _Projections(grams, profiles.prototypes()), profiles.usual()
        for part in _tables(batches):
            texts = [None if t is None else str(t) for t in part.column(place).to_pylist()]
            taught = part.column(part.num_columns - 1).to_pylist()
            found, share = np.full(len(texts), -1), np.zeros(len(texts))
            if names:
                for low, high in _portions(texts):
                    found[low:high], share[low:high] = _shares(texts[low:high], grams, near, usual, asked)
                for i in [i for i, k in enumerate(taught) if k in names]:
                    others = profiles.without(taught[i], *_taught_by(grams, texts[i]))
                    one, own = _shares([texts[i]], grams, _Projections(grams, others.prototypes()), others.usual(), asked)
                    found[i], share[i] = one[0], own[0]
            lang = [names[b] if b >= 0 and s >= least else "und" for b, s in zip(found, share, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(share)], [*part.schema.names[:-1], "lang_pred", "share"])
        del grams, near
        give_back()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1]), "lang_pred string", "share double"])
    return given.mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of all documents from which nothing is learned."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1
