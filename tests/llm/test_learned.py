"""Toxicity, language and quality: held-out accuracy, brute force for the counts, odd rows."""

import math
import random
import re
import zlib
from collections import defaultdict

import pytest
import regex as unicode
import xxhash

from orrery.llm import langid, quality, toxicity

WORDS = {"en": "the and of with thing over under water", "de": "der und mit wasser unter schön über groß", "fr": "le et avec eau sous été très grand"}


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(900):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang].split()) + rng.choice(["", "en", "a"]) for _ in range(rng.randint(25, 90))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile", "scum", "filth"])
        if junk:
            words = [w + rng.choice(["***", "%%%"]) for w in words]
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").cache()
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache(), labels


def test_toxicity_held_out(corpus):
    docs, labels, truth = corpus
    want = {i: t for i, _, t in truth}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 900
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) / len(held) > 0.97
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_odd_rows(spark, docs, corpus):
    _, labels, _ = corpus
    none = spark.createDataFrame([(None, None, None), (1, None, None), (1, 1, 1)], labels.schema)
    for given in (labels, none, labels.limit(0)):
        assert toxicity.toxicity(docs(), given).count() == docs().count()
    assert toxicity.drop_toxic(docs(), none).columns == docs().columns
    assert toxicity.toxicity(docs([]), labels).collect() == []


def test_language_held_out(corpus):
    docs, _, _ = corpus
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.languages(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(docs):
    got = langid.languages(docs()).collect()
    assert len(got) == docs().count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und"
    assert langid.languages(docs([])).collect() == []
    assert {r["lang_pred"] for r in langid.languages(docs().selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


def test_profile_distance_against_plain_python(corpus):
    docs, _, _ = corpus
    rows = docs.collect()

    def ranked(texts):
        n = defaultdict(int)
        for t in texts:
            found, count = langid.grams(t)
            for g, k in zip(found.tolist(), count.tolist(), strict=True):
                n[g] += k
        return {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[: langid.PROFILE])}

    profile = {lang: ranked([r["text"] for r in rows if r["lang"] == lang and fold(r["doc_id"])]) for lang in WORDS}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs).collect()}
    for r in rows[:60]:
        mine = ranked([r["text"]])
        far = {lang: sum(abs(k - p[g]) if g in p else langid.PROFILE for g, k in mine.items()) for lang, p in profile.items()}
        assert got[r["doc_id"]] == min(sorted(far), key=far.get)


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def test_quality_counts(spark, docs, corpus):
    _, labels, _ = corpus
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 8, 9, 17, 30, 200)]
    texts += ["x y\nx y\n\n\nz", "1 2 3 4 5 6 7 8 9 " * 5, "#a * <b>\n|", "a\x0bb\x0cc\rd\te f"]
    more = [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for rows in (docs(), docs(more)):
        got = quality.quality(rows, labels).collect()
        columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(counts(r["text"]) for r in rows.collect())
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality(docs([]), labels.limit(0)).collect() == []


def test_quality_verdicts(corpus):
    docs, labels, truth = corpus
    good = {i: q for i, q, _ in truth}
    got = [r for r in quality.quality(docs, labels).collect() if not r["base_failed"]]
    assert sum(r["kept"] == bool(good[r["doc_id"]]) for r in got) / len(got) > 0.98
    held = [r for r in got if fold(r["doc_id"]) == 0]
    assert sum(r["kept"] == bool(good[r["doc_id"]]) for r in held) / len(held) > 0.98


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_quality_ratio_against_plain_python(corpus):
    docs, labels, truth = corpus
    rows, y = {r["doc_id"]: r["text"] for r in docs.collect()}, {i: q for i, q, _ in truth}

    def buckets(text):
        w = [x.encode() for x in unicode.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", text.lower())]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:], strict=False)]
        return [signed(h) % quality.BUCKETS for h in one + two]

    every, trusted = defaultdict(int), defaultdict(int)
    for i, text in rows.items():
        for b in buckets(text):
            every[b] += 1
            trusted[b] += fold(i) > 1 and y[i] == 1
    n, t = sum(every.values()), sum(trusted.values())
    ratio = lambda b: math.log((trusted[b] + 1) / (t + quality.BUCKETS)) - math.log((every[b] + 1) / (n + quality.BUCKETS))
    got = quality.quality(docs, labels).collect()
    for r in got:
        own = buckets(rows[r["doc_id"]])
        assert r["ratio"] == pytest.approx(sum(map(ratio, own)) / len(own), abs=1e-5)
    tune = [(r["ratio"], y[r["doc_id"]], r["kept"]) for r in got if fold(r["doc_id"]) == 1 and not r["base_failed"]]
    least = min(sum((x >= c) != bool(q) for x, q, _ in tune) for c in [x for x, _, _ in tune])
    assert sum(k != bool(q) for _, q, k in tune) <= least + 1  # the cut is one of 4096 values


def test_toxicity_models_against_plain_python(spark, monkeypatch):
    """Counts, discounts and shares by hand; each class's shares of the words after any word sum to 1."""
    monkeypatch.setattr(toxicity, "DISCOUNT", 0.5)
    monkeypatch.setattr(toxicity, "Z", 0.5)
    rng = random.Random(9)
    plain = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(60)]
    rude = [" ".join([*(rng.choice("abcdefgh") for _ in range(6)), *rng.choice([["x", "y"], ["y"], ["a", "b", "a"]]), *(rng.choice("abcdefgh") for _ in range(3))]) for _ in range(20)]
    texts = [(t, 0) for t in plain] + [(t, 1) for t in rude] + [("", 0), (None, 1)]
    found = toxicity.models(toxicity.counts(spark.createDataFrame(texts, "text string, toxic int")))
    n, seen = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for d, (text, c) in enumerate(texts):
        w = toxicity.bins_of(text).tolist()
        u = [toxicity.BINS, *w]
        for i, x in enumerate(w):
            n[c][x].add(d)
            seen[c][x].add(u[i] & 63)
            n[c][u[i], x].add(d)
            seen[c][u[i], x].add((u[i - 1] if i else toxicity.BINS) & 63)
    count = [{k: min(len(v), -64 * math.log1p(-min(len(seen[c][k]), 56) / 64)) for k, v in n[c].items()} for c in (0, 1)]
    total = {two: [sum(v for k, v in count[c].items() if isinstance(k, tuple) == two) for c in (0, 1)] for two in (False, True)}

    def kept(c, k):
        share = total[isinstance(k, tuple)]
        m = sum(count[i].get(k, 0) for i in (0, 1)) * share[c] / sum(share)
        return max(count[c].get(k, 0) - m - 0.5 * math.sqrt(m) - 0.5, 0) / share[c]

    words = {k for c in (0, 1) for k in n[c] if not isinstance(k, tuple)}
    both = {k: sum(count[c].get(k, 0) for c in (0, 1)) for k in words}
    spare = sum(min(v, 0.5) for v in both.values()) / toxicity.BINS
    shared = {k: (max(v - 0.5, 0) + spare) / sum(both.values()) for k, v in both.items()}
    for c in (0, 1):
        free = 1 - sum(kept(c, k) for k in words)
        for k in words:
            assert found.word[c, k] == pytest.approx(kept(c, k) + free * shared[k])
        assert found.word[c].sum() == pytest.approx(1) and found.first[c].sum() == pytest.approx(1)
        pairs = {k: kept(c, k) for k in {*n[0], *n[1]} if isinstance(k, tuple) and kept(c, k) > 0}
        assert found.freed[c] == pytest.approx(1 - sum(pairs.values()))
        assert {(int(k) >> 21, int(k) & 0xFFFFF) for k, x in zip(found.pairs, found.kept[c], strict=True) if x} == set(pairs)
        for u in [toxicity.BINS, *words, 12345]:
            assert found.share(c, u).sum() == pytest.approx(1)
    assert len(found.pairs) > 3
    prepared = found.prepared()
    for text, _ in texts[:80:7] + [("x y a b", 1), ("unseen words x y", 0)]:
        w = toxicity.bins_of(text)
        want = [sum(math.log(found.share(c, u)[x]) for u, x in zip(toxicity.before(w), w, strict=True)) / len(w) for c in (0, 1)]
        assert toxicity.statistic_of(w, prepared) == pytest.approx(want[1] - want[0])


def test_toxicity_pairs_beyond_the_broadcast_ones_count(spark, docs, corpus, monkeypatch):
    """However few pairs are broadcast, and however the labels are joined, all pairs and labels have their part in every score."""
    monkeypatch.setattr(toxicity, "DISCOUNT", 0.5)
    monkeypatch.setattr(toxicity, "Z", 0.5)
    rows, labels, _ = corpus
    rows = docs().select(*rows.columns).union(rows).union(rows.limit(50))
    want = sorted(map(str, toxicity.toxicity(rows, labels).collect()))
    kept = sorted(map(str, toxicity.drop_toxic(rows, labels).collect()))
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 100)
    for pairs in (300, 3):
        monkeypatch.setattr(toxicity, "PAIRS", pairs)
        both, _, _ = toxicity.fit(rows, labels)
        assert len(both.pairs) == pairs and both.rest.count() > 300
        assert sorted(map(str, toxicity.toxicity(rows, labels).collect())) == want
    assert sorted(map(str, toxicity.drop_toxic(rows, labels).collect())) == kept


def test_quality_learns_from_every_trusted_row(corpus, monkeypatch):
    """However many trusted rows there are, and however they are joined, all have their part in the ratio."""
    docs, labels, _ = corpus
    want = sorted(map(str, quality.quality(docs, labels).collect()))
    for name in ("TRUSTED_ROWS", "BROADCAST_ROWS"):
        monkeypatch.setattr(quality, name, 50, raising=False)
    assert sorted(map(str, quality.quality(docs, labels).collect())) == want
