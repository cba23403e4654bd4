import numpy as np
import pytest
import xxhash

from orrery.llm import simhash as S


def brute(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: (f"{f:016x}", x) for i, (f, x) in enumerate(zip(fps, label, strict=True))}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "  \n", "a", "A", "a b", "A\tb c"]
    for _ in range(40):
        base = list(rng.choice(words, 400))
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.integers(400)] = "x"
            texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_groups(docs).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("limit", [4, 16])
def test_large_buckets_are_cut(spark, monkeypatch, limit):
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 6), replace=False)) for _ in range(300)})
    nodes = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "id long, fp binary")
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    monkeypatch.setattr(S, "CELL_ROWS", limit)
    got = {r.id: r.component for r in S.near_groups(nodes, S.exact_tables(len(fps)), 3).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(label))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(docs).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.simhash_groups(docs).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]


def test_tables_cover_every_difference():
    rng = np.random.default_rng(3)
    for rows in (10, 10**6, 10**9, 10**11):
        tables = S.exact_tables(rows)
        for _ in range(50):
            off = set(rng.choice(64, 3, replace=False).tolist())
            assert any(not off & set(t) for t in tables)
