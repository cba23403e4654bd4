import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing


def targets(sizes):
    """By hand: shares by weight, capped at three times the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


def make(spark, seed=3, n=3000):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 400]), rng.choice(["a", "b", "b", "b", "c", None, "é", "tiny" if i < 9 else "a"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("leaf", [10**9, 40])
def test_targets_and_takes(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)
    rows, docs = make(spark)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = targets(sizes)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] % max(r["size"], 1) == 0
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 400, s


def test_reruns_agree_over_other_partitions(spark):
    _, docs = make(spark)
    a = mixing.mix_report(docs).collect()
    b = mixing.mix_report(docs.repartition(7, F.rand(1))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize(
    "size, p",
    [([5, 5], [0.5, 0.3]), ([1, 1, 1], [0.3, 0.3, 0.3]), ([900, 100, 80, 50, 10, 3], [0.2, 0.5, 0.7, 0.35, 0.9, 0.1]), ([7, 0, 2, 0], [0.6, 0.25, 0.4, 0.5])],
)
def test_expectations_are_kept(size, p):
    """After the last draw too, every document is taken with its fraction's probability."""
    total, runs = [0] * len(p), 40_000
    for seed in range(runs):
        got = list(p)
        assert mixing.rounded(size, got, str(seed), True) is None
        for i, x in enumerate(got):
            assert x in (0.0, 1.0)
            total[i] += int(x)
    assert [n / runs for n in total] == pytest.approx(p, abs=0.01)


def test_words_are_kept_but_for_the_last_document():
    rng = random.Random(1)
    for _ in range(300):
        size = sorted((rng.randint(1, 500) for _ in range(rng.randint(1, 40))), reverse=True)
        p = [rng.random() for _ in size]
        want, left = sum(s * x for s, x in zip(size, p, strict=True)), mixing.pivot(size, p, rng.random)
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        assert sum(s * x for s, x in zip(size, p, strict=True)) == pytest.approx(want)


def test_repeated_rows_share_their_copies(spark, monkeypatch):
    """Equal rows, with and without an id, are rounded together, in a mix that no order of rows changes."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    rows = [(None, "w " * 4, "a")] * 500 + [(7, "w " * 3, "a")] * 101 + [(i, "w " * 5, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a, b = (sorted(map(str, mixing.mix_report(d).collect())) for d in (docs, docs.repartition(5, F.rand(2))))
    assert a == b and len(a) == len(rows)
    got = mixing.mix_report(docs).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        by[r["doc_id"], r["source"]] += len(r["text"].split())
    want = defaultdict(int)
    for r in got:
        want[r["doc_id"], "b" if r["size"] == 5 else "a"] += r["taken"]
    assert {k: v for k, v in want.items() if v} == by


def test_odd_rows(docs):
    got = mixing.mix_report(docs())
    assert got.count() == docs().count()
    size = re.compile(r"[^\x20\x09-\x0D]+")
    want = sorted(len(size.findall(t["text"] or "")) for t in docs().collect())
    assert sorted(r["size"] for r in got.collect()) == want
    assert mixing.mixed_documents(docs()).columns == docs().columns
    assert mixing.mix_report(docs([])).collect() == []
