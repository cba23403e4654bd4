"""Quality rules, and a hashed n-gram likelihood ratio of trusted text to all text, in DataFrame operations only.

Rules count white-space-separated words, signs, repeated lines and words in repeated windows. The ratio is that of
two multinomials over BUCKETS hashed unigrams and bigrams of lower-cased letter runs and sign runs: one of trusted rows
(label quality = 1, however many), one of all rows; the mean log-ratio of a document's n-grams has no part in
its length. Every document is compared with the same cut: the value with the fewest errors on a fold of labelled
rows that pass the rules, none of them among the trusted rows. Rows whose crc32(doc_id as text) modulo FOLDS is 0
teach neither the ratio's trusted side nor the cut, so that verdicts can be measured on them. Nothing is drawn at random.

Null and empty texts have no words and fail the rules. Very long texts are read whole; an empty table gives an empty
one. A doc_id with several labels is trusted if any is 1; null labels and a null doc_id teach nothing. Without trusted rows
the ratio and the cut are 0 and the rules alone decide. Repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.threshold import cut
from orrery.plans import materialize

BUCKETS = 1 << 14
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SIGNS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"
REACH = 4.0
FOLDS = 5
#: Ids of trusted rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
GRAM = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def covered(starts: Column, width: int) -> Column:
    """Places in the union of [s, s + width) over ascending starts."""
    follow = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(follow, F.lit(0), lambda n, x: n + x)


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that the text holds twice or more."""

    def again(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(
            ordered,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return let(F.array_sort(marked), lambda x: covered(x, width))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), again(h)).otherwise(0))
    return F.when(F.size(w) > width, some).otherwise(0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(GRAM), F.lit(0))


def bucket(*words: Column) -> Column:
    """The bucket of an n-gram, 1 to BUCKETS."""
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int") + 1


def grams(text: Column) -> Column:
    """Buckets of the text's unigrams and bigrams."""

    def both(t: Column) -> Column:
        one = F.transform(t, lambda x: bucket(x))
        two = F.transform(t, lambda x, i: bucket(x, F.get(t, i + 1)))
        return F.concat(one, F.slice(two, 1, F.greatest(F.size(t) - 1, F.lit(0))))

    return let(tokens(text), both)


def mean_ratio(text: Column, held: Column) -> Column:
    """The mean of `held` at the buckets of the text's unigrams and bigrams, in one pass over its words."""

    def one(t: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            follow = F.get(t, i + 1)
            return F.element_at(held, bucket(x)) + F.when(follow.isNotNull(), F.element_at(held, bucket(x, follow))).otherwise(0.0)

        return F.when(F.size(t) > 0, F.aggregate(F.transform(t, at), F.lit(0.0), lambda s, r: s + r) / (2 * F.size(t) - 1)).otherwise(0.0)

    return let(tokens(text), one)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / share in all rows) for each bucket in order, smoothed by one count."""
    trusted = materialize(trusted.withColumn("good", F.lit(1)))
    mark = docs.join(F.broadcast(trusted) if trusted.count() <= BROADCAST_ROWS else trusted, "doc_id", "left")
    per = mark.select(F.explode(grams(F.col("text"))).alias("bucket"), "good").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("t"))
    per = materialize(per)
    n, t = per.agg(F.sum("n"), F.sum("t")).first()
    share = F.log((F.coalesce("t", F.lit(0)) + 1) / F.lit((t or 0) + BUCKETS)) - F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit((n or 0) + BUCKETS))
    value = share if t else F.lit(0.0)
    got = {r["bucket"]: r["r"] for r in per.select("bucket", value.alias("r")).collect()}  # BUCKETS rows at most
    none = math.log(1 / ((t or 0) + BUCKETS)) - math.log(1 / ((n or 0) + BUCKETS)) if t else 0.0
    return [got.get(b, none) for b in range(1, BUCKETS + 1)]


def features(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed and x, the mean log-ratio of the document's n-grams."""
    text = F.col("text")
    held = F.split(F.lit(",".join(f"{r:.6f}" for r in ratio)), ",").cast("array<double>")  # folded into one literal

    def lines(x: Column) -> Column:
        return F.filter(F.split(x, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)

    dup = let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    n = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = docs.select(
        "doc_id",
        n.alias("n"),
        F.length(without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SIGNS))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        mean_ratio(text, held).alias("x"),
    )
    return out.select(
        "doc_id", F.col("n.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("n.n_repeat_words").cast("long").alias("n_repeat_words"), "x",
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and ratio."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    of = fold(F.col("doc_id"))
    found = materialize(features(rows, log_ratios(rows, known.where((of > 1) & (F.col("y") == 1)).select("doc_id"))))
    tuned = found.where(~F.col("base_failed")).join(known.where(of == 1), "doc_id").select("x", "y")
    least = cut(tuned, REACH)
    kept = ~F.col("base_failed") & (F.col("x") >= F.lit(least))
    return found.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("x").alias("ratio"))
