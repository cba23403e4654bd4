import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from orrery.llm import simhash

DATA = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = set(simhash.shingles(a, 5)), set(simhash.shingles(b, 5))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_go(spark, docs):
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 60)):
                edited[rng.randrange(len(base))] = "edit"
            texts.append(" ".join(edited))
        far = list(base)
        for k in range(0, len(far), 7):
            far[k] = f"other{k}"
        texts.append(" ".join(far))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    kept = simhash.drop_near_duplicates(docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    assert kept.columns == docs().columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_near_duplicates_odd_rows(docs):
    kept = simhash.drop_near_duplicates(docs()).collect()
    assert sorted(str((r["doc_id"], (r["text"] or "")[:10])) for r in kept) == sorted(
        str(x) for x in [(1, "one two th"), (1, "another te"), (2, ""), (None, "a text wit"), (5, "word thing"), (6, "Ünïcode 文字")]
    )
    assert simhash.drop_near_duplicates(docs([])).collect() == []


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= before or name == "mix"
        before = n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == before


def kept_by_brute_force(texts):
    label = list(range(len(texts)))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sorted(set(label))


@pytest.mark.parametrize("cell", [512, 8])
def test_near_copies_inside_a_template(docs, monkeypatch, cell):
    """Documents that share most of a passage (similarity 0.7 to 0.79) hide no true pair among them."""
    monkeypatch.setattr(simhash, "CELL_SETS", cell)
    rng = random.Random(8)
    shared = [f"t{i}" for i in range(170)]
    texts = []
    for d in range(60):
        own = [f"d{d}w{i}" for i in range(22)]
        texts.append(" ".join(shared + own))
        if d % 3 == 0:  # close above 0.8
            texts.append(" ".join(shared + own[: rng.randint(6, 12)] + [f"e{d}w{i}" for i in range(16)]))
    kept = simhash.drop_near_duplicates(docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_by_brute_force(texts)


def test_equal_fingerprints_are_no_copies(docs):
    """One shingle that makes up most of a text says nothing about the rest of it."""
    run = " ".join(["-"] * 200)
    texts = [f"{run} " + " ".join(f"d{d}w{i}" for i in range(60)) for d in range(6)]
    assert len({simhash.fingerprint(simhash.shingles(t, 5), 256) for t in texts}) == 1
    kept = simhash.drop_near_duplicates(docs([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0] + " -"])]))
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_by_brute_force(texts) == list(range(6))


@pytest.mark.parametrize("size", [9, 45, 180, 900])
def test_pairs_close_above_the_threshold_meet(size):
    """At a similarity of 0.80 to 0.82 nearly all pairs share a band, whatever their length."""
    rng, met = np.random.default_rng(size), 0
    for _ in range(500):
        items = rng.integers(0, 1 << 64, size + size // 9, dtype=np.uint64)
        x, y = items[:size], items[size // 9 :]  # both have 8/9 of each: 8/10 of all
        met += bool(set(simhash.band_keys(x)) & set(simhash.band_keys(y)))
    assert met >= 499


def test_repeats_do_not_part_equal_sets(docs):
    """A passage repeated more often changes no shingle set by much, and so hides no pair."""
    own = " ".join(f"w{i}" for i in range(120))
    song = " ".join(f"la{i}" for i in range(12))
    texts = [own + f" {song}" * 2, own + f" {song}" * 40 + " end"]
    kept = simhash.drop_near_duplicates(docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    assert [r["doc_id"] for r in kept.collect()] == kept_by_brute_force(texts) == [0]


@pytest.mark.parametrize("cell", [512, 2])
def test_near_dedup_finds_candidates_by_the_index_of_fingerprints(spark, docs, monkeypatch, cell):
    """With bands that no two texts share, the stage still drops what is within the index's radius and verified."""
    rng, texts = random.Random(12), []
    for d in range(25):
        base = [f"d{d}w{i}" for i in range(600)]
        texts.append(" ".join(base))
        for _ in range(2):
            base[rng.randrange(600)] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(base))
    fp = [int.from_bytes(simhash.set_fingerprint(np.frombuffer(simhash.shingle_set(t, 5), dtype="<u8"))) for t in texts]
    for t, f in zip(texts[:5], fp, strict=False):
        hashes = {xxhash.xxh64_intdigest(x) for x in simhash.shingles(t, 5)}
        assert f == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (fp[i] ^ fp[j]).bit_count() <= 3 and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert len(set(label)) < 40
    monkeypatch.setattr(simhash, "CELL_SETS", cell)
    one = lambda items: [xxhash.xxh3_64_intdigest(items.tobytes(), k) >> 1 for k in range(simhash.BANDS)] if len(items) else []
    monkeypatch.setattr(simhash, "band_keys", one)
    kept = corpus_pipeline.near_dedup(spark, docs([(i, t, "en", "s", 1) for i, t in enumerate(texts)]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def spied(monkeypatch):
    """Tables that near-dedup writes, with the plans that they were written by."""
    written, plain = [], simhash.materialize

    def spy(df, *args):
        out = plain(df, *args)
        written.append((out, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(simhash, "materialize", spy)
    return written


def test_sets_meet_few_cells_without_a_shuffle(spark, monkeypatch):
    """Every round compares some sets: the others are not sent around for that."""
    written = spied(monkeypatch)
    texts = [f"{' '.join(f'a{k % 7}x{i}' for i in range(40))} tail{k}" for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = simhash.shingle_sets(rows, 5).localCheckpoint()
    cells = spark.range(40).selectExpr("id % 7 AS cell", "0 AS side", "id", "id AS label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = sorted(map(tuple, simhash.set_links(cells, sets, 0.8).collect()))
        assert "BroadcastHashJoin" in written[-1][1] and "SortMergeJoin" not in written[-1][1]
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
        many = sorted(map(tuple, simhash.set_links(cells, sets, 0.8).collect()))
        assert "SortMergeJoin" in written[-1][1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    label = list(range(40))
    for found in (few, many):
        label = list(range(40))
        for a, b in found:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        assert label == [k % 7 for k in range(40)]


def test_near_dedup_deletes_what_its_result_does_not_read(spark, docs, monkeypatch):
    written = spied(monkeypatch)
    kept = simhash.drop_near_duplicates(docs([(i, f"{'same words ' * 9}{i % 3}", "en", "s", 1) for i in range(12)] + [(1, f"{'same words ' * 9}1", "en", "s", 1)]))
    large = [t for t, _ in written if {"keys", "items"} & set(t.columns)]
    assert large and len(kept.collect()) == 3  # a half of two texts' shingles is the same

    def is_there(t):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._orrery_path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    assert not any(map(is_there, large))
