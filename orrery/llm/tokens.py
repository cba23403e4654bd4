"""Token ids in shards, with a minimal perfect hash from document keys to places in the raw payload.

File format: a Parquet table, so that a task's output is committed whole or not at all on any file system,
with one row for each shard and
  shard     long    order of the shards; documents ascend by doc_id within and across shards
  first_id, last_id long   range of doc_id, for pruning (null if a null doc_id is in the shard)
  n_docs, n_tokens long
  n_null    long    how many of the shard's doc_ids are null; they come last
  keys      binary  int64 doc_ids in order, for listing (0 in place of null)
  levels    binary  uint32 count, then for each level uint32 words, uint64 slots before it, its rank blocks (uint32
                    bits set before each BLOCK words) and its uint64 bitmap words
  slots     binary  for each slot of the hash: uint64 first id's place, uint32 ids, uint32 fingerprint
  width     long    bytes of an id: 2 if the vocabulary has 65,536 ids or fewer, else 4
  payload   binary  ids as little-endian unsigned integers of that width, nothing between documents
A key's slot is the number of bits set before its own, over all levels: the level's slots, its rank block's count and
the bits of at most BLOCK words, whatever the shard's size; the ids are then read at their place. A key unlike any
stored is told by the fingerprint, up to one in 2^32. The n-th repeat of a doc_id in a shard is a key of its own.

Null text is the empty text: only the end id. A null doc_id comes last. A very long text is encoded whole and may make
a shard of its own. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans import materialize, running_sum
from orrery.plans.workers import released

END = 1
SHARD_BYTES = 4 << 20
CACHED_WORDS = 1_200_000
#: Bytes of words and their ids that an encoder's newer cache holds; the one before it has as many.
CACHED_BYTES = 48 << 20
#: Bytes of a cached word besides its own and its ids': two objects' heads and a place in the table.
ENTRY = 120
#: A run that ends in a letter (a-z or U+00C0 to U+00FF without the signs among them), then ASCII signs but for the apostrophe.
TAILED = re.compile(rb"([a-z\x80-\xff]*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)").fullmatch
#: Bytes of ASCII without the apostrophe and of U+00C0 to U+00FF; runs of letters and of others but white space in such a text.
EASY = bytes(b for b in range(0xC0) if b != 39) + b"\xc3"
RUNS = re.compile(rb"[a-z\x80-\xff]+|[^\sa-z\x80-\xff]+").findall
#: Small letters: a-z and U+00DF to U+00FF without the sign among them.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: How byte-level models write bytes that are no printable Latin-1 sign: code points from 256 on, in order.
BYTE_SIGNS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: What a tokenizer must encode alike whole and in parts to be taken word by word.
PROBE = "Ab  cd,\nEf's zählt ÄRGER! über; 12x3 (ça) \t naïve... Ho-ho&& x"
#: Bitmap words of a rank block.
BLOCK = 8
SHARD_SCHEMA = "shard long, first_id long, last_id long, n_docs long, n_null long, n_tokens long, keys binary, levels binary, slots binary, width long, payload binary"
#: The normaliser and pre-tokeniser for which parts can be encoded apart.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
SLOT = np.dtype([("at", "<u8"), ("ids", "<u4"), ("print", "<u4")])


class Encoder:
    """Ids of texts as bytes.

    A tokenizer with the normaliser and pre-tokeniser of SPLITTING, which drops white space, parts signs from letters and
    ignores case, encodes part by part: each new part once, a word's tail of ASCII signs apart, and a run of small letters by the model
    alone, since normalising and pre-tokenising leave such a run whole. Texts in which a special token or a
    combining mark could be in play are not lower-cased here. Any other tokenizer gets whole texts.

    Ids of parts are kept in two caches of CACHED_BYTES. When the newer is full it takes the place of the older, and
    parts that come again move over from there, so that frequent ones stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        made = json.loads(self.tokenizer.to_str())
        known = all(made[k] == v for k, v in SPLITTING.items()) and all(t["content"].startswith("<|") for t in made["added_tokens"])
        parts = [(w, *TAILED(w.encode()).groups()) for w in PROBE.lower().split() if TAILED(w.encode())]
        self.by_word = known and self.plain(PROBE) == [i for w in PROBE.lower().split() for i in self.plain(w)]
        self.by_word &= all(self.plain(w) == [*self.plain(run.decode()), *self.plain(tail.decode())] for w, run, tail in parts)
        self.by_run = self.by_word and all(self.model(run) == self.pack(self.plain(run.decode())) for _, run, _ in parts if RUN(run))

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def model(self, run: bytes) -> bytes:
        return self.pack([t.id for t in self.tokenizer.model.tokenize(run.decode("latin-1").translate(BYTE_SIGNS))])

    def words(self, text: str | None) -> list[bytes]:
        """Parts of the text between which the tokenizer always splits.

        With nothing but ASCII other than the apostrophe and the letters of Latin-1, those are runs of letters and
        runs of other signs; else words.
        """
        raw = text.encode() if text else b""
        if b"<|" in raw:
            return raw.split()
        if not raw.translate(None, EASY) and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw:
            return RUNS(text.lower().encode()) if raw else []
        return raw.split() if b"\xcc" in raw or b"\xcd" in raw else raw.lower().split()

    def learn(self, fresh: set[bytes]) -> None:
        """Put the ids of new words into `known`."""
        known, older, tails, runs, before = self.known, self.older, [], set(), len(self.known)
        for w in fresh:
            if w in older:
                known[w] = older[w]
                continue
            m = TAILED(w)
            if m:
                tails.append((w, m[1], m[2]))
                runs.update(m.groups())
            else:
                runs.add(w)
        rest = []
        for w in runs:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
            elif self.by_run and RUN(w):
                known[w] = self.model(w)
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = self.pack(e.ids)
        for w, run, tail in tails:
            known[w] = known[run] + known[tail]
        self.held += ENTRY * (len(known) - before) + sum(len(w) + len(known[w]) for w in fresh | runs)

    def encode(self, texts: list[str | None], end: int = END) -> list[bytes]:
        stop = self.pack([end])
        if not self.by_word:
            return [self.pack(e.ids) + stop for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if self.held > CACHED_BYTES or len(self.known) > CACHED_WORDS:
            self.older, self.known, self.held = self.known, {}, 0
        split, get = [self.words(t) for t in texts], self.known.get
        found = [list(map(get, words)) for words in split]
        missing = [k for k, ids in enumerate(found) if None in ids]
        if missing:
            self.learn({w for k in missing for w, ids in zip(split[k], found[k], strict=True) if ids is None})
            for k in missing:
                found[k] = list(map(get, split[k]))
        return [b"".join(ids) + stop for ids in found]


#: By path; one of each for a worker process, kept between its tasks.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the hash -------------------------------------------------------------------------------------


def _mix64(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def index_keys(ids: np.ndarray, n_null: int = 0) -> np.ndarray:
    """64-bit keys of sorted doc_ids, the last n_null of which are null; repeats of an id are numbered."""
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    at = np.arange(len(ids))
    first[at == len(ids) - n_null] = True
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    own = _mix64(ids.astype(np.int64).view(np.uint64), 1)
    own[len(ids) - n_null :] = _mix64(np.zeros(n_null, np.uint64), 4)
    return own ^ np.where(again == 0, np.uint64(0), _mix64(again.astype(np.uint64), 2))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bitmaps: a key's bit is set in the first level in which no other key left falls on it."""
    left, out = np.unique(keys), []
    while len(left):
        words = (2 * len(left) + 63) // 64
        at = (_mix64(left, 16 + len(out)) % np.uint64(words * 64)).astype(np.int64)
        hits = np.bincount(at, minlength=words * 64)
        out.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
        left = left[hits[at] != 1]
    return out


def slots_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key, -1 for a key that no level holds."""
    out, base, todo = np.full(len(keys), -1, dtype=np.int64), 0, np.arange(len(keys))
    for n, bitmap in enumerate(levels):
        at = _mix64(keys[todo], 16 + n) % np.uint64(len(bitmap) * 64)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap).astype(np.int64))])
        on = (bitmap[word] >> bit) & np.uint64(1) == 1
        under = np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[todo[on]] = (base + before[word] + under)[on]
        todo, base = todo[~on], base + int(before[-1])
    return out


def pack_levels(levels: list[np.ndarray]) -> bytes:
    out, base = [np.uint32(len(levels)).tobytes()], 0
    for words in levels:
        counts = np.bitwise_count(words).astype(np.int64)
        blocks = np.add.reduceat(counts, np.arange(0, len(words), BLOCK))
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        out += [np.uint32(len(words)).tobytes(), np.uint64(base).tobytes(), ranks.tobytes(), words.tobytes()]
        base += int(counts.sum())
    return b"".join(out)


def _levels(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """For each level: words, slots before it, and where its rank blocks and its words begin; nothing else is read."""
    at = 4
    for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
        n, base = int(np.frombuffer(raw, "<u4", 1, at)[0]), int(np.frombuffer(raw, "<u8", 1, at + 4)[0])
        words = at + 12 + 4 * -(-n // BLOCK)
        yield n, base, at + 12, words
        at = words + 8 * n


def unpack_levels(raw: bytes) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u8", n, words) for n, _, _, words in _levels(raw)]


def slot_of(key: np.ndarray, raw: bytes) -> int:
    """The slot of one key, -1 for a key that no level holds: a word a level, and one rank block."""
    for level, (n, base, ranks, words) in enumerate(_levels(raw)):
        at = int(_mix64(key, 16 + level)[0] % np.uint64(n * 64))
        word, bit = at >> 6, at & 63
        if int(np.frombuffer(raw, "<u8", 1, words + 8 * word)[0]) >> bit & 1:
            start = word // BLOCK * BLOCK
            before = [int(x) for x in np.frombuffer(raw, "<u8", word - start + 1, words + 8 * start)]
            before[-1] &= (1 << bit) - 1
            return base + int(np.frombuffer(raw, "<u4", 1, ranks + 4 * (word // BLOCK))[0]) + sum(x.bit_count() for x in before)
    return -1


def prints(keys: np.ndarray) -> np.ndarray:
    return (_mix64(keys, 3) >> np.uint64(32)).astype(np.uint32)


def pack(shard: int, ids: list[int | None], encoded: list[bytes], width: int) -> dict:
    """A shard's row."""
    raw, n_null = np.array([i or 0 for i in ids], dtype="<i8"), sum(i is None for i in ids)
    keys = index_keys(raw, n_null)
    levels = build_levels(keys)
    length = np.array([len(e) // width for e in encoded], dtype=np.int64)
    slots = np.zeros(len(keys), dtype=SLOT)
    at = slots_of(keys, levels)
    slots["at"][at], slots["ids"][at], slots["print"][at] = np.cumsum(length) - length, length, prints(keys)
    ends = (ids[0], ids[-1]) if None not in (ids[0], ids[-1]) else (None, None)
    return {
        "shard": shard, "first_id": ends[0], "last_id": ends[1], "n_docs": len(ids), "n_null": n_null, "n_tokens": int(length.sum()),
        "keys": raw.tobytes(), "levels": pack_levels(levels), "slots": slots.tobytes(), "width": width, "payload": b"".join(encoded),
    }


def find(row: dict, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
    """The ids of a document in a shard's row, in a time that does not depend on the shard's size, or None."""
    own = _mix64(np.array([doc_id], dtype=np.int64).view(np.uint64), 1) if doc_id is not None else _mix64(np.zeros(1, np.uint64), 4)
    key = own ^ (_mix64(np.array([repeat], dtype=np.uint64), 2) if repeat else np.uint64(0))
    slot = slot_of(key, row["levels"])
    if slot < 0:
        return None
    s = np.frombuffer(row["slots"], SLOT, 1, SLOT.itemsize * slot)[0]
    if s["print"] != prints(key)[0]:
        return None
    return np.frombuffer(row["payload"], f"<u{row['width']}", int(s["ids"]), row["width"] * int(s["at"]))


# --- writing and reading --------------------------------------------------------------------------


def encode_shards(docs: DataFrame, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards' rows. Equal doc_ids can be in two partitions: their texts' hashes order them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = _encoder(tokenizer), None
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([pack(base + n, ids, held, encoder.dtype.itemsize)], schema=schema)

        schema = pa.schema([(c, pa.binary() if k == "binary" else pa.int64()) for c, k in (x.split() for x in SHARD_SCHEMA.split(", "))])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for i, e in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist(), end), strict=True):
                    ids.append(i)
                    held.append(e)
                    size += len(e)
                    if size >= shard_bytes:
                        yield flush()
                        ids, held, size, n = [], [], 0, n + 1
        if ids:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(released(run), SHARD_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the documents' ids as shards to `path`."""
    encode_shards(docs, tokenizer, end, shard_bytes).write.option("compression", "none").parquet(path)


def lookup(spark: SparkSession, path: str, doc_id: int | None, repeat: int = 0) -> list[int] | None:
    """One document's ids: the range prunes shards, executors look into those left, and only the ids come to the driver."""
    here = F.col("n_null") > 0 if doc_id is None else ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)) | F.col("first_id").isNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                ids = find(row, doc_id, repeat)
                if ids is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["shard", "ids"])

    rows = spark.read.parquet(path).where(here).select("shard", "levels", "slots", "width", "payload")
    found = rows.mapInArrow(released(run), "shard long, ids array<long>").orderBy("shard").first()
    return found["ids"] if found else None


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read through the index of its shard."""
    starts = materialize(running_sum(shards.select("shard", "n_tokens"), ["shard"], "n_tokens", "base").select("shard", "base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                ids = np.frombuffer(row["keys"], "<i8")
                keys = index_keys(ids, row["n_null"])
                at = slots_of(keys, unpack_levels(row["levels"]))
                s = np.frombuffer(row["slots"], SLOT)[at]
                if (at < 0).any() or (s["print"] != prints(keys)).any():
                    raise ValueError(f"shard {row['shard']}: a key is missing from its index")
                view = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                crc = [zlib.crc32(view[a : a + n]) for a, n in zip(s["at"].tolist(), s["ids"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=np.arange(len(ids)) >= len(ids) - row["n_null"]), pa.array(row["base"] + s["at"].astype(np.int64)), pa.array(s["ids"].astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    whole = shards.join(starts, "shard").select("shard", "base", "n_null", "keys", "levels", "slots", "width", "payload")
    return whole.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
