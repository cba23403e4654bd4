"""Language by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent 1- to 3-grams over all learning documents. A
document's own most frequent n-grams are ranked too, and its distance to a language is the sum over them of
how far out of place each is there, PROFILE for one that the profile lacks. The nearest language wins, ties
by name. The score is 1 less the nearest distance's share of the two nearest, doubled and cut at 1: 0 for a
tie, near 1 if the nearest is much nearer.

Texts are lower-cased; runs of other characters than letters count as one space. Learning uses rows with a
text, a lang and a doc_id whose crc32 modulo 5 is not 0. A text without a letter, and every text if there is
nothing to learn from, is `und` with score 0. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans import materialize

PROFILE = 400
FOLDS = 5
#: Bits of a character in an n-gram's code: code points fit.
WIDTH = 21


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0; built once for a worker."""
    if not _TABLE:
        _TABLE.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.int64))
    return _TABLE[0]


_TABLE: list[np.ndarray] = []


def codes(text: str | None) -> np.ndarray:
    """Letters' code points, with a 0 before, after and between runs of letters; empty without a letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    at = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    x = _letters()[at]
    x = np.concatenate([[0], x, [0]])
    keep = np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])
    x = x[keep]
    return x if len(x) > 2 or x.any() else np.zeros(0, dtype=np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the text, as codes, and how often each occurs."""
    x = codes(text)
    if not len(x):
        return x, x
    one = x[x != 0]
    two = (x[:-1] << WIDTH) | x[1:] | (1 << 62)
    three = (x[:-2] << 2 * WIDTH - 1 | x[1:-1] << WIDTH - 1 | x[2:]) ^ np.int64(-1) if len(x) > 2 else x[:0]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(found: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first the commonest; ties by code."""
    return found[np.lexsort((found, -n))[:most]]


def profiles(rows: DataFrame) -> DataFrame:
    """lang, gram, place (from 0): PROFILE rows a language at most; rows has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list) -> None:
            found, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[lang] = found, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            own: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(lang, []).append(grams(text))
            for lang, parts in own.items():
                add(lang, parts + ([total[lang]] if lang in total else []))
        for lang, (found, n) in total.items():
            for at in range(0, len(found), 50_000):
                f = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(f), pa.array(n[at : at + 50_000])], ["lang", "gram", "n"])

    n = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # tasks keep PROFILE rows a language each before any language's rows meet
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return n.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", (F.col("rank") - 1).alias("place"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    ranked = materialize(profiles(rows.where(~out & F.col("lang").isNotNull() & F.col("text").isNotNull())))
    names = [r["lang"] for r in ranked.select("lang").distinct().orderBy("lang").collect()]
    known = np.unique(ranked.select("gram").distinct().toArrow().column("gram").to_numpy())
    place = np.full((len(names), len(known) + 1), PROFILE, dtype=np.int64)  # a row for each language, at most PROFILE columns for each
    for r in ranked.toArrow().to_pylist():
        place[names.index(r["lang"]), np.searchsorted(known, r["gram"])] = r["place"]
    shipped = docs.sparkSession.sparkContext.broadcast((names, known, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, place = shipped.value
        for b in batches:
            lang, score = [], []
            for text in b.column(2).to_pylist():
                found, n = grams(text)
                if not len(found) or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                mine = top(found, n)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                at = np.where(known[at] == mine, at, len(known))
                theirs = place[:, at]
                far = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
                best = int(far.argmin())
                second = np.delete(far, best).min(initial=PROFILE * len(mine)) if len(names) > 1 else PROFILE * len(mine)
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, 2 * (1 - far[best] / (far[best] + second)) - 1))) if far[best] + second else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(out, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
