"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A record is a window of an item: WIDTH consecutive words, or the whole item if it is shorter. All of its
words must occur, so under one order of words, from the rarest in the corpus on, its prefix is its
rarest word alone: a document that holds the window holds that word. The documents' words are joined
with those prefix words; a hit at place p puts the window's start at p less the word's place in it, and
that start must lie in the document and leave room for the window. What passes is cut from the document
as a window of the same size and compared whole.

Null and empty texts have no words. Items without words are ignored; items that share a window are all
reported. Repeated documents get a row each; a null item_id counts as one item and is named ''. Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans import materialize

WIDTH = 8
#: A side of at most so many rows (of a word, or of WIDTH words) is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 100_000
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; null as the empty string."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), PARTS), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, win (array of words): the windows of every item."""
    w = words(F.col("text"))
    cut = let(w, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (width - 1), F.lit(1))), lambda i: F.slice(x, i, width)))
    return items.select("item_id", F.explode(cut).alias("win")).where(F.size("win") > 0).distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that with doc_id tells rows of different texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """word, at, win: every window with its rarest word and that word's place; windows has win."""
    parts = windows.select("win", F.posexplode("win").alias("at", "word"))
    vocabulary = materialize(parts.select("word").distinct())
    n = vocabulary.count()
    said = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if n <= BROADCAST_ROWS:
        rarity = said.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    else:
        rarity = said.groupBy("word").count().join(vocabulary, "word")
    # a word that no document holds rules its windows out
    rare = parts.join(small(materialize(rarity), n), "word", "left")
    first = rare.groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("first"))
    return first.where("first.n > 0").select(F.col("first.word").alias("word"), F.col("first.at").alias("at"), "win")


def found_in_place(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """found_windows with the prefix words sent to the texts: each hit is compared where it is found, and no text moves."""
    place = docs.select("doc_id", "h", words(F.col("text")).alias("w")).select("*", F.posexplode("w").alias("pos", "word"))
    hit = place.join(F.broadcast(prefix), "word").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0")
    whole = F.when(F.col("start") + F.size("win") <= F.size("w"), F.slice(F.col("w"), F.col("start") + 1, F.size("win")) == F.col("win"))
    return hit.where(whole).select("doc_id", "h", "start", F.size("win").alias("len"), "win")


def found_by_shuffle(docs: DataFrame, windows: DataFrame, prefix: DataFrame) -> DataFrame:
    """found_windows for windows that are too many to send around: texts meet their starts, cut windows meet the items'."""
    own = prefix.select("word", "at", F.size("win").alias("len")).distinct()
    place = docs.select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    hit = place.join(own, "word").select("doc_id", "h", (F.col("pos") - F.col("at")).alias("start"), "len").where("start >= 0")
    # a document has no more starts than words for each place and length
    starts = materialize(hit.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "len")).alias("starts")))
    d, s = docs.select("doc_id", "h", "text"), starts.withColumnsRenamed({"doc_id": "s_id", "h": "s_h"})
    both = d.join(s, d.doc_id.eqNullSafe(s.s_id) & (d.h == s.s_h)).select("doc_id", "h", words(F.col("text")).alias("w"), "starts")
    fits = F.filter("starts", lambda c: c["start"] + c["len"] <= F.size("w"))
    cut = F.transform(fits, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.slice(F.col("w"), c["start"] + 1, c["len"]).alias("win")))
    seen = both.select("doc_id", "h", F.explode(cut).alias("c")).select("doc_id", "h", "c.start", "c.len", "c.win")
    return seen.join(windows.select("win").distinct(), "win")


def found_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, h, start, len, win of every place where a window occurs; docs is keyed, windows has win, each once."""
    prefix = materialize(prefixes(docs, windows))
    in_place = prefix.count() <= BROADCAST_ROWS  # rows of one word and of WIDTH words at most
    return (found_in_place(docs, prefix) if in_place else found_by_shuffle(docs, windows, prefix)).distinct()


def matches(rows: DataFrame, of_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_hit) and (doc_id, h, n_items, names) of the documents that hold windows; rows is keyed."""
    windows = materialize(of_items.select("win").distinct())
    found = materialize(found_windows(rows, windows))
    cover = found.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    named = of_items.select("win", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"))
    which = found.select("doc_id", "h", "win").distinct().join(small(named, of_items.count()), "win").select("doc_id", "h", "name").distinct()
    names = F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")
    return cover.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_hit")), which.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_items"), names)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (`least` items or more) of every document."""
    rows = keyed(docs)
    hits, lists = matches(rows, materialize(item_windows(items, width)))
    a, b = hits.withColumnsRenamed({"doc_id": "a_id", "h": "a_h"}), lists.withColumnsRenamed({"doc_id": "b_id", "h": "b_h"})
    marks = materialize(a.join(b, F.col("a_id").eqNullSafe(F.col("b_id")) & (F.col("a_h") == F.col("b_h"))).drop("b_id", "b_h"))
    n = F.regexp_count(lowered(F.col("text")), F.lit(WORD)).cast("long")
    out = rows.select("doc_id", "h", n.alias("n_words")).join(marks, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")), "left")
    n_items = F.coalesce("n_items", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_items >= least).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = 1) -> DataFrame:
    """The documents that hold windows of fewer than `least` items, with their columns; `_bench_` is reserved."""
    rows = docs.withColumn("_bench_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    _, which = matches(keyed(docs), materialize(item_windows(items, width)))
    bad = which.where(F.col("n_items") >= least).select(F.col("doc_id").alias("_bench_id"), F.col("h").alias("_bench_bad"))
    bad = materialize(bad)
    on = F.col("doc_id").eqNullSafe(F.col("_bench_id")) & (F.col("_bench_h") == F.col("_bench_bad"))
    return rows.join(small(bad, bad.count()), on, "left_anti").drop("_bench_h")
