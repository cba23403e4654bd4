"""Toxicity by two class-conditional Kneser-Ney models over words and pairs of neighbouring words.

A class's model of a word is its discounted count plus the mass that discounting freed, dealt by a continuation
distribution that both classes share; its joint model of a pair is the pair's discounted count plus the freed mass,
dealt by the models of the two words. Both sum to 1, and so does the share of a word after the word before it. The
discount of an expression in a class is what the shared counts lead one to expect there (the expression's count
in both classes, by the class's share of all counts) with Z standard errors and DISCOUNT on top. An expression
that neither class has beyond that backs off to the same shared counts in both. (A constant discount as in plain
Kneser-Ney leaves the noise of every language and topic in the ratio; see the README for what it reaches.)

A document's statistic is its log-likelihood under the toxic model less that under the ordinary one, divided by its
words. The models are fitted on three folds of labelled rows, and the cut is the value with the fewest errors on
a fourth; the score is a logistic curve through it.

Counts are of documents that hold an expression, or of the distinct contexts (the word before it) in which
the class shows it where those are fewer, so that neither one document's repetitions nor its copies are many
occasions. Words are hashed to BINS bins. Every labelled row teaches, every pair with a discounted count is in the
models, and every document is scored on its whole text, however long. The PAIRS pairs of the largest discounted
counts are broadcast; the terms of the others, if there are more, are joined to the texts that hold them. Terms are
multiples of FINE, so that their sums are the same in any order and by either way.

Null and empty texts have statistic 0. An empty table gives an empty one. Repeated rows are scored each; a doc_id
with several labels counts as toxic if any is; null labels and a null doc_id teach nothing. Without labelled rows
of both classes every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.threshold import cut
from orrery.plans import materialize
from orrery.plans.workers import released

BINS = 1 << 20
#: Bits of a word in a pair's key; one value more than the bins stands for the start of a text.
WORD_BITS = 21
#: Tells a word's key from a pair's.
SINGLE = 1 << 62
#: Pairs that come to the driver and are broadcast.
PAIRS = 1 << 20
#: What a term is a multiple of.
FINE = 2.0**-32
#: Places of the set by which texts tell which of their pairs may be among those that are not broadcast.
PLACES = 27
DISCOUNT = 3.0
Z = 4.0
#: Discount of the shared continuation counts; what it frees goes to all bins alike.
SHARED_DISCOUNT = 0.5
#: Labelled ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
FOLDS = 5
#: Bits of a set of contexts from which on it is taken as full.
FULL = 56
#: Occurrences that a task holds before it adds them up.
HELD = 1 << 21
COUNTED = ["key", "toxic", "n", "contexts"]
REACH = 0.5
#: A-Z to a-z; letters, digits and all bytes above 127 stay; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def bins_of(text: str | None) -> np.ndarray:
    """The bin of each word of the text."""
    words = text.encode().translate(_FOLD).split() if text else []
    return np.array([zlib.crc32(w) for w in words], dtype=np.int64) & (BINS - 1)


def before(words: np.ndarray) -> np.ndarray:
    """The word before each, BINS before the first."""
    return np.concatenate([[BINS], words[:-1]]) if len(words) else words


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


# --- counts ---------------------------------------------------------------------------------------


def expressions(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, context bit) of a document's words and pairs, as keys and one-bit sets; a key can come repeatedly."""
    u = before(words)
    key = np.concatenate([words | SINGLE, u << WORD_BITS | words])
    bit = np.concatenate([u, before(u)]) & 63
    order = np.lexsort((bit, key))
    key, bit = key[order], bit[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (bit[1:] != bit[:-1])]) if len(key) else np.zeros(0, bool)
    return key[first], bit[first]


def _added(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Counts of (class, keys, bits) of documents: rows of COUNTED."""
    of = np.concatenate([np.full(len(k), c, dtype=np.int8) for c, k, _ in parts])
    doc = np.concatenate([np.full(len(k), i, dtype=np.int32) for i, (_, k, _) in enumerate(parts)])
    key, bit = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    order = np.lexsort((doc, key, of))
    of, doc, key, bit = of[order], doc[order], key[order], bit[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
    start = np.flatnonzero(new)
    held = np.concatenate([[True], (doc[1:] != doc[:-1])]) | new
    n = np.add.reduceat(held.astype(np.int64), start)
    contexts = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), start).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(of[start].astype(np.int64)), pa.array(n), pa.array(contexts)], COUNTED)


def counts(rows: DataFrame) -> DataFrame:
    """By expression and class: documents, and a set of contexts (64 bits), in parts that add up; rows has text and toxic (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, bit = expressions(bins_of(text))
                if len(key):
                    parts.append((toxic, key, bit))
                    size += len(key)
                if size >= HELD:
                    whole, parts, size = _added(parts), [], 0
                    yield from (whole.slice(at, 100_000) for at in range(0, whole.num_rows, 100_000))
        if parts:
            whole = _added(parts)
            yield from (whole.slice(at, 100_000) for at in range(0, whole.num_rows, 100_000))

    return rows.select("text", "toxic").mapInArrow(released(run), ", ".join(f"{c} long" for c in COUNTED))


def occasions(table: DataFrame) -> DataFrame:
    """key, ordinary, toxic: each class's occasions of every expression."""
    out = table.groupBy("key")
    sums = [F.sum(F.when(F.col("toxic") == c, F.col("n"))).alias(f"n{c}") for c in (0, 1)]
    out = out.agg(*sums, *[F.bit_or(F.when(F.col("toxic") == c, F.col("contexts"))).alias(f"s{c}") for c in (0, 1)])

    def fewer(c: int) -> Column:
        n, seen = F.coalesce(f"n{c}", F.lit(0)).cast("double"), F.coalesce(F.bit_count(f"s{c}"), F.lit(0))
        return F.when(seen >= FULL, n).otherwise(F.least(n, -64 * F.log1p(-F.least(seen, F.lit(FULL)) / 64)))

    return out.select("key", fewer(0).alias("ordinary"), fewer(1).alias("toxic"))


# --- models ---------------------------------------------------------------------------------------


@dataclass
class Models:
    """Both classes' models, the ordinary one first: of words, of the word before a word, and of pairs."""

    word: np.ndarray  # 2 x BINS: share of a word
    first: np.ndarray  # 2 x (BINS + 1): share of a word, or of the start, as the first of a pair
    pairs: np.ndarray  # sorted keys of the pairs with the largest discounted counts
    kept: np.ndarray  # 2 x pairs: their discounted shares
    after: np.ndarray  # 2 x (BINS + 1): the sum of those of one first word, over all pairs
    freed: np.ndarray  # 2: the mass that all pairs' discounts freed
    rest: DataFrame | None = None  # key, k0, k1: the pairs beyond PAIRS

    def share(self, c: int, u: int) -> np.ndarray:
        """The share of every word after u, where all pairs are in `pairs`."""
        out = self.freed[c] * self.first[c, u] * self.word[c]
        mine = self.pairs >> WORD_BITS == u
        out[self.pairs[mine] & ((1 << WORD_BITS) - 1)] += self.kept[c, mine]
        return out / (self.after[c, u] + self.freed[c] * self.first[c, u])

    def prepared(self) -> tuple:
        """What a document's statistic is added up from: terms of words, of words before, and of pairs."""
        backed = self.freed[:, None] * self.first
        part = np.log(backed / (self.after + backed))
        of_pair = pair_terms(self.pairs, self.kept, backed, self.word)
        return fine(np.log(self.word[1] / self.word[0])), fine(part[1] - part[0]), self.pairs, of_pair


def fine(term: np.ndarray) -> np.ndarray:
    return np.round(term / FINE) * FINE


def pair_terms(pairs: np.ndarray, kept: np.ndarray, backed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What each pair adds to a statistic beyond the terms of its words."""
    u, w = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
    more = np.log1p(kept / (backed[:, u] * word[:, w]))
    return fine(more[1] - more[0])


def total_of(words: np.ndarray, prepared: tuple) -> float:
    """The log-likelihood ratio of a text's words, but for pairs that are not broadcast."""
    of_word, of_first, pairs, of_pair = prepared
    if not len(words):
        return 0.0
    u = before(words)
    total = of_word[words].sum() + of_first[u].sum()
    if len(pairs):
        key = u << WORD_BITS | words
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        total += of_pair[at[pairs[at] == key]].sum()
    return float(total)


def statistic_of(words: np.ndarray, prepared: tuple) -> float:
    """The log-likelihood ratio of a text's words, divided by their number."""
    return total_of(words, prepared) / max(len(words), 1)


def discounted(n: Column, both: Column, share: float) -> Column:
    """What a class has of an expression beyond what the shared counts explain."""
    m = both * F.lit(share)
    return F.greatest(n - m - F.lit(Z) * F.sqrt(m) - F.lit(DISCOUNT), F.lit(0.0))


def models(table: DataFrame) -> Models | None:
    """The models of counted expressions; BINS words, as many first words and PAIRS pairs at most come to the driver."""
    found = materialize(occasions(table))
    single = F.col("key").bitwiseAND(F.lit(SINGLE)) != 0
    totals = {r["single"]: (r["a"], r["b"]) for r in found.groupBy(single.alias("single")).agg(F.sum("ordinary").alias("a"), F.sum("toxic").alias("b")).collect()}
    if not totals or min(totals[True]) <= 0 or min(totals[False]) <= 0:
        return None

    def kept(rows: DataFrame, total: tuple[float, float]) -> DataFrame:
        both = F.col("ordinary") + F.col("toxic")
        return rows.select("key", *[discounted(F.col(c), both, t / sum(total)).alias(f"k{i}") for i, (c, t) in enumerate(zip(("ordinary", "toxic"), total, strict=True))], both.alias("n"))

    words = kept(found.where(single), totals[True]).toArrow()
    at = words.column("key").to_numpy() & (BINS - 1)
    shared, share = np.zeros(BINS), np.zeros((2, BINS))
    shared[at] = words.column("n").to_numpy()
    shared = (np.maximum(shared - SHARED_DISCOUNT, 0) + np.minimum(shared, SHARED_DISCOUNT).sum() / BINS) / shared.sum()
    for c in (0, 1):
        share[c, at] = words.column(f"k{c}").to_numpy() / totals[True][c]
        share[c] += (1 - share[c].sum()) * shared
    some = kept(found.where(~single), totals[False]).where("k0 + k1 > 0")
    some = materialize(some.select("key", (F.col("k0") + F.col("k1")).alias("most"), *[(F.col(f"k{c}") / F.lit(totals[False][c])).alias(f"k{c}") for c in (0, 1)]))
    top = some.orderBy(F.desc("most"), "key").limit(PAIRS).toArrow()
    rest = None
    if some.count() > PAIRS:
        most, last = top.column("most")[-1].as_py(), top.column("key")[-1].as_py()
        rest = some.where((F.col("most") < F.lit(most)) | ((F.col("most") == F.lit(most)) & (F.col("key") > F.lit(last)))).select("key", "k0", "k1")
    key = top.column("key").to_numpy()
    order = np.argsort(key)
    pairs = key[order].astype(np.int64)
    held = np.array([top.column(f"k{c}").to_numpy()[order] for c in (0, 1)]).reshape(2, -1)
    by_first = some.groupBy(F.shiftright("key", WORD_BITS).alias("u")).agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).toArrow()
    after = np.zeros((2, BINS + 1))
    for c in (0, 1):
        after[c, by_first.column("u").to_numpy()] = by_first.column(f"k{c}").to_numpy()
    # a text starts as often as both classes' counts of pairs from the start say
    begun = sum(found.where(~single & (F.shiftright("key", WORD_BITS) == BINS)).agg(F.sum("ordinary"), F.sum("toxic")).first())
    start = begun / sum(totals[False])
    first = np.concatenate([share * (1 - start), np.full((2, 1), start)], axis=1)
    return Models(share, first, pairs, held, after, 1 - after.sum(axis=1), rest)


def place(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)


def rest_terms(fitted: Models) -> tuple[DataFrame, np.ndarray]:
    """(key, term) of the pairs that are not broadcast, and the set of their places in words of 64 bits."""
    shipped = fitted.rest.sparkSession.sparkContext.broadcast((fitted.freed[:, None] * fitted.first, fitted.word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            term = pair_terms(key, np.array([b.column(c).to_numpy() for c in (1, 2)]), *shipped.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(term), pa.array(place(key))], ["key", "term", "place"])

    rest = materialize(fitted.rest.mapInArrow(released(run), "key long, term double, place long"))
    bit = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")
    found = rest.groupBy(F.shiftright("place", 6).alias("at")).agg(bit).toArrow()
    places = np.zeros(1 << (PLACES - 6), dtype=np.uint64)
    places[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return rest.select("key", "term"), places


def statistic(docs: DataFrame, fitted: Models) -> DataFrame:
    """docs with _tox_x, the length-normalised log-likelihood ratio of its text."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted.prepared())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = shipped.value
        for b in batches:
            x = [statistic_of(bins_of(t), prepared) for t in b.column("text").cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.float64())], [*b.schema.names, "_tox_x"])

    if fitted.rest is None:
        return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("_tox_x", T.DoubleType())]))
    rest, places = rest_terms(fitted)
    shipped_places = docs.sparkSession.sparkContext.broadcast(places)

    def digest(text: str | None) -> bytes:
        return xxhash.xxh3_128_digest((text or "").encode())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = shipped.value
        for b in batches:
            texts = b.column("text").cast(pa.string()).to_pylist()
            words = [bins_of(t) for t in texts]
            more = [pa.array([digest(t) for t in texts], pa.binary()), pa.array([total_of(w, prepared) for w in words], pa.float64()), pa.array([max(len(w), 1) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_tox_h", "_tox_total", "_tox_n"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, has = shipped.value[2], shipped_places.value
        for b in batches:
            for text in b.column(0).to_pylist():
                words = bins_of(text)
                key, times = np.unique(before(words) << WORD_BITS | words, return_counts=True)
                at = place(key)
                some = (has[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
                some &= held[np.minimum(np.searchsorted(held, key), len(held) - 1)] != key
                if some.any():
                    h = pa.array([digest(text)] * int(some.sum()), pa.binary())
                    yield pa.RecordBatch.from_arrays([h, pa.array(key[some]), pa.array(times[some])], ["_tox_h", "key", "times"])

    # equal texts ask once; a text's terms come back under its digest
    ask = docs.select(F.col("text").cast("string")).mapInArrow(released(asked), "_tox_h binary, key long, times long").distinct()
    more = ask.join(rest, "key").groupBy("_tox_h").agg(F.sum(F.col("times") * F.col("term")).alias("_tox_more"))
    fields = [T.StructField("_tox_h", T.BinaryType()), T.StructField("_tox_total", T.DoubleType()), T.StructField("_tox_n", T.LongType())]
    rows = docs.mapInArrow(released(whole), T.StructType([*docs.schema.fields, *fields])).join(more, "_tox_h", "left")
    return rows.select(*docs.columns, ((F.col("_tox_total") + F.coalesce("_tox_more", F.lit(0.0))) / F.col("_tox_n")).alias("_tox_x"))


# --- use ------------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Models, float, float] | None:
    """The models, the cut and the scale of the curve; None without labelled rows of both classes."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known.where(fold(F.col("doc_id")) != 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = texts.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "doc_id")
    teach, tune = train.where(fold(F.col("doc_id")) > 1), train.where(fold(F.col("doc_id")) == 1)
    both = models(counts(teach))
    if both is None:  # too few rows to hold a fold back
        both, tune = models(counts(train)), train
    if both is None:
        return None
    at = cut(statistic(tune.select("text", "toxic"), both).select(F.col("_tox_x").alias("x"), F.col("toxic").alias("y")), REACH)
    return both, at, max(abs(at), REACH / 2048) / 2


def scored(docs: DataFrame, fitted: tuple[Models, float, float] | None) -> DataFrame:
    """docs with _tox_score."""
    if fitted is None:
        return docs.withColumn("_tox_score", F.lit(0.0))
    both, at, scale = fitted
    score = 1 / (1 + F.exp(-(F.col("_tox_x") - F.lit(at)) / F.lit(scale)))
    return statistic(docs, both).withColumn("_tox_score", score).drop("_tox_x")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5, with their columns; names that begin with `_tox_` are reserved."""
    return scored(docs, fit(docs, labels)).where("_tox_score < 0.5").drop("_tox_score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    score = F.col("_tox_score")
    return scored(rows, fit(rows, labels)).select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
