import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", "ß", "'", "s", "t", "ll", ".", ",", "!", "  ", "\n", "1", "23", "½", "—", "ﬁ", "İ", "ñ", "J̌", "́", "<|endoftext|>", "<|", "文", "Σς", "\x1c", " ", "th", "##", "***", "😀", "×"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    path = public_tokenizers.path(name)
    encoder, plain, rng = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        got = np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()
        assert got == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    encoder = tokens.Encoder(WORD)
    for text in ("a b c d e", "f g", "a b"):
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == [*encoder.plain(text), 1]


def test_known_words_are_bounded_in_bytes(monkeypatch):
    """Few long words take as much memory as many short ones."""
    monkeypatch.setattr(tokens, "CACHED_BYTES", 1 << 20, raising=False)
    encoder, rng = tokens.Encoder(WORD), random.Random(8)
    for _ in range(60):
        text = "often " + "".join(rng.choices("abcdefgh", k=30_000))
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == [*encoder.plain(text), 1]
    kept = [*encoder.known.items(), *encoder.older.items()] if hasattr(encoder, "older") else encoder.known.items()
    assert sum(len(w) + len(ids) for w, ids in kept) < 2.5 * (1 << 20)
    assert b"often" in encoder.known  # it moved over


def test_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_tokens(docs(), path, WORD, shard_bytes=64)
    plain = Tokenizer.from_file(WORD)
    rows = [(r["doc_id"], r["text"]) for r in docs().collect()]
    ids = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    got = tokens.read_digests(spark.read.parquet(path)).collect()
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(x), crc(x)) for d, x in ids)
    place = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in place] == [sum(x["n_tokens"] for x in place[:k]) for k in range(len(place))]
    keys = [(r["doc_id"] is None, r["doc_id"] or 0) for r in place]
    assert keys == sorted(keys)
    assert tokens.lookup(spark, path, 6) == dict(ids)[6]
    assert tokens.lookup(spark, path, 12345) is None
    assert tokens.lookup(spark, path, None) == tokens.lookup(spark, path, None, 1) == dict(ids)[None]
    assert tokens.lookup(spark, path, None, 2) is None


def test_smallest_id_is_an_id(spark, tmp_path):
    path, least = str(tmp_path / "t"), -(1 << 63)
    docs = spark.createDataFrame([(least, "a b"), (None, "c"), (0, "d"), (0, "e e")], "doc_id long, text string")
    tokens.write_tokens(docs, path, WORD)
    got = tokens.read_digests(spark.read.parquet(path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [least, 0, 0, None]
    plain = Tokenizer.from_file(WORD)
    assert tokens.lookup(spark, path, least) == [*plain.encode("a b", add_special_tokens=False).ids, 1]
    assert tokens.lookup(spark, path, None) == [*plain.encode("c", add_special_tokens=False).ids, 1]


def test_single_lookups_agree_with_the_whole_index():
    keys = tokens.index_keys(np.concatenate([np.arange(-40_000, 1, 2, dtype="<i8"), np.zeros(5, "<i8")]), 5)
    levels = tokens.build_levels(keys)
    raw, slots = tokens.pack_levels(levels), tokens.slots_of(keys, levels)
    assert sorted(slots) == list(range(len(keys)))
    assert [tokens.slot_of(keys[i : i + 1], raw) for i in range(0, len(keys), 97)] == slots[::97].tolist()


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer unlike the one that splits at words is never fed parts."""
    made = Tokenizer.from_file(WORD).to_str().replace('"Lowercase"', '"StripAccents"')
    (tmp_path / "t.json").write_text(made)
    assert tokens.Encoder(WORD).by_word and not tokens.Encoder(str(tmp_path / "t.json")).by_word


def test_index_is_minimal_and_perfect():
    keys = tokens.index_keys(np.array(sorted([5, 5, 5, *range(1000, 9000, 3)]), dtype="<i8"))
    levels = tokens.unpack_levels(tokens.pack_levels(tokens.build_levels(keys)))
    assert sorted(tokens.slots_of(keys, levels)) == list(range(len(keys)))


def test_empty_table(spark, docs, tmp_path):
    tokens.write_tokens(docs([]), str(tmp_path / "t"), WORD)
    shards = spark.read.schema(tokens.SHARD_SCHEMA).parquet(str(tmp_path / "t"))
    assert tokens.read_digests(shards).collect() == []
