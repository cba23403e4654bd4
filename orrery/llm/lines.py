"""Line dedup by a segment-partition edit join.

Lines within TAU edits share a segment: cut the shorter one's n characters into TAU + 1 segments of near-equal
length, and TAU edits leave one of them whole, shifted by no more than the edits on either side of it. A line is
indexed under each (its length, segment number, segment), and probes every length from its own down to TAU less
with the substrings that the shift allows. Pairs that meet must also have nearly equal parities of hashed
character pairs (an edit changes four at most); that is tested inside the join, so that a segment shared by
many lines makes no rows. What passes is verified by a banded bit-parallel edit distance.

Segments of a line of SHORT characters or fewer would say little. Where the shorter line of a pair is so short, both
are probed whole instead, under all that is left of them without up to TAU of their characters: lines within TAU edits
have such a rest in common. Lines of TAU characters or fewer are all within TAU edits of each other; they are
linked and counted without pairing them. So every line that is not blank is joined with every other, at any length.

Equal lines (by a 128-bit hash) are one line, whatever their number. Blank lines are never duplicates. Lines are those
between `\\n`; a null or empty text has one blank line, a very long text has its lines like others, and an empty table
gives an empty one. A null doc_id sorts first. Of several texts under one doc_id that of the smallest hash comes
first; of rows that repeat doc_id and text one comes first, and the lines of the others are duplicates of its lines.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.components import components
from orrery.plans import materialize

TAU = 2
#: Lines of so many characters are joined by what is left of them, not by segments.
SHORT = 8
#: Ids of lines to verify that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def parities(lines: list[str]) -> np.ndarray:
    """By line, 64 parities of how often it has a pair of neighbouring characters, by the pair's hash."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    out, some = np.zeros(len(lines), dtype=np.uint64), size > 0
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(x):
        at = np.zeros(len(x), dtype=np.uint64)
        at[:-1] = ((x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)) >> np.uint32(7)) & np.uint32(63)
        bit = np.uint64(1) << at
        bit[np.cumsum(size[some]) - 1] = 0  # a line's last character begins no pair
        out[some] = np.bitwise_xor.reduceat(bit, (np.cumsum(size) - size)[some])
    return out


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, t and copies: a row for each (doc_id, text); t tells texts of one doc_id apart and is 0 where there is one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = materialize(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    once = rows.select("*", F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("copies"))
    n = again.count()
    if not n:
        return once
    on, few = F.col("doc_id").eqNullSafe(F.col("again")), F.broadcast(again) if n <= BROADCAST_ROWS else again
    each = rows.join(few, on, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return once.join(few, on, "left_anti").union(materialize(each.select("doc_id", "text", "t", "copies")))


def split_lines(rows: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, t, line_no, h1, h2 (hash) and blank of every line of told_apart's rows; with `whole` also line, len and sig, else copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for start in range(0, every.num_rows, 512):
                b = every.slice(start, 512)
                place, lines, times = [], [], []
                for text in b.column(1).to_pylist():
                    parts = (text or "").split("\n")
                    times.append(len(parts))
                    place += range(len(parts))
                    lines += [p if p.strip(" \t\x0b\x0c\r") else "" for p in parts]
                again = pa.array(np.repeat(np.arange(len(times)), times))
                hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), dtype="<i8").reshape(-1, 2)
                columns = {"doc_id": b.column(0).take(again), "t": b.column(2).take(again), "line_no": pa.array(place, pa.int32()), "h1": pa.array(hashes[:, 0]), "h2": pa.array(hashes[:, 1])}
                columns["blank"] = pa.array([not x for x in lines], pa.bool_())
                if whole:
                    sig = np.concatenate([parities(lines[a : a + 128]) for a in range(0, len(lines), 128)]).view(np.int64)
                    columns |= {"line": pa.array(lines, pa.string()), "len": pa.array([len(x) for x in lines], pa.int32()), "sig": pa.array(sig)}
                else:
                    columns["copies"] = b.column(3).take(again)
                yield pa.RecordBatch.from_pydict(columns)

    more = "line string, len int, sig long" if whole else "copies long"
    return rows.select("doc_id", "text", "t", "copies").mapInArrow(run, f"doc_id long, t long, line_no int, h1 long, h2 long, blank boolean, {more}")


def segment(n: int, i: int, tau: int) -> tuple[int, int]:
    """Start and length of segment i of a line of n characters; the short ones come first."""
    short, longer = divmod(n, tau + 1)
    late = max(0, i - (tau + 1 - longer))
    return i * short + late, short + (i >= tau + 1 - longer)


def index_places(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, end) under which a line of n characters is indexed."""
    return [(n, i, a, a + size) for i in range(tau + 1) for a, size in [segment(n, i, tau)]]


def probe_places(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, end) that a line of n characters probes.

    With at most i edits before segment i and tau - i after it, it is shifted by no more than that, counted
    from the front and from the back.
    """
    out = []
    for less in range(tau + 1):
        for i in range(tau + 1):
            a, size = segment(n - less, i, tau)
            for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
                if 0 <= a + shift and a + shift + size <= n:
                    out.append((n - less, i, a + shift, a + shift + size))
    return out


def segment_keys(lines: DataFrame, tau: int, probe: bool) -> DataFrame:
    """key, id, len, sig: a row for each place under which a line is indexed, or that it probes."""
    places = probe_places if probe else index_places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list[tuple[int, int]], np.ndarray]] = {}  # by length: slices, and what tells them apart
        for every in batches:
            for start in range(0, every.num_rows, 4096):
                b = every.slice(start, 4096)
                hashes: list[int] = []
                salts, times = [], []
                for line in b.column(1).to_pylist():
                    n = len(line)
                    if n not in known:
                        if len(known) > 20_000:
                            known.clear()
                        at = places(n, tau)
                        salt = np.array([length * (tau + 1) + i for length, i, _, _ in at], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        known[n] = [(a, z) for _, _, a, z in at], salt
                    cut, salt = known[n]
                    hashes += [xxhash.xxh3_64_intdigest(line[a:z]) for a, z in cut]
                    salts.append(salt)
                    times.append(len(cut))
                key = np.array(hashes, dtype=np.uint64) ^ np.concatenate(salts) if salts else np.zeros(0, np.uint64)
                again = pa.array(np.repeat(np.arange(b.num_rows), times))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(c).take(again) for c in ("id", "len", "sig"))], ["key", "id", "len", "sig"])

    return lines.select("id", "line", "len", "sig").mapInArrow(run, "key long, id long, len int, sig long")


def rests(line: str, tau: int) -> set[str]:
    """The line, and what is left of it without up to tau characters, but for nothing."""
    out = last = {line}
    for _ in range(tau):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out - {""}


def rest_keys(lines: DataFrame, tau: int) -> DataFrame:
    """key, id, len, sig: a row for each of a line's rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for start in range(0, every.num_rows, 4096):
                b = every.slice(start, 4096)
                found = [[xxhash.xxh3_64_intdigest(x) for x in rests(line, tau)] for line in b.column(1).to_pylist()]
                key = np.array([h for x in found for h in x], dtype=np.uint64).view(np.int64)
                again = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(again) for c in ("id", "len", "sig"))], ["key", "id", "len", "sig"])

    return lines.select("id", "line", "len", "sig").mapInArrow(run, "key long, id long, len int, sig long")


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    low, short = 0, min(len(a), len(b))
    while low < short and a[low] == b[low]:
        low += 1
    high = 0
    while high < short - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= most:
        return min(_plain(a, b), most + 1)
    return banded(a, b, most)


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def banded(a: str, b: str, most: int) -> int:
    """Bit-parallel edit distance over the 2 * most + 1 diagonals around the main one; len(a) > most.

    The band moves down a row with each character of b. Its lowest diagonal's value is followed until that
    diagonal leaves a, then the last row's value is.
    """
    width = 2 * most + 1
    full, lowest = (1 << width) - 1, 1 << width - 1
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    up, down = full >> most << most, 0  # vertical steps of +1 and -1
    value, row = most, lowest >> 1
    for j, c in enumerate(b):
        at = where.get(c, 0)
        match = (at >> j - most if j >= most else at << most - j) & full
        flat = ((match & up) + up ^ up | match | down) & full  # diagonal steps of 0
        right, left = (down | ~(flat | up)) & full, flat & up  # horizontal steps of +1 and -1
        if j < len(a) - most:
            value += not flat & lowest
            if value > most + len(b) - (len(a) - most):
                return most + 1
        else:
            value += bool(right & row) - bool(left & row)
            row >>= 1
        up, down = (left | ~(flat >> 1 | right)) & full, flat >> 1 & right
    return min(value, most + 1)


def verified(pairs: DataFrame, most: int = TAU) -> DataFrame:
    """The pairs (a, b, line_a, line_b) within `most` edits, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [edit_distance(x, y, most) <= most for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def met(index: DataFrame, probe: DataFrame, tau: int) -> DataFrame:
    """(a, b), a < b, of lines that meet under a key and have lengths and parities that tau edits allow.

    Both sides are plain shuffles, sorted and spilled where they must be, so that a key of many lines can be split.
    """
    index, probe = (x.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", "id", "len", "sig")]) for s, x in (("i", index), ("p", probe)))
    shorter = (F.col("i_len") < F.col("p_len")) | ((F.col("i_len") == F.col("p_len")) & (F.col("i_id") < F.col("p_id")))
    close = (F.col("p_len") - F.col("i_len") <= tau) & (F.bit_count(F.col("i_sig").bitwiseXOR(F.col("p_sig"))) <= 4 * tau)
    both = probe.join(index, (F.col("p_key") == F.col("i_key")) & shorter & close & (F.col("p_len") > tau))
    return both.select(F.least("i_id", "p_id").alias("a"), F.greatest("i_id", "p_id").alias("b")).distinct()


def near_lines(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b) of all lines within tau edits, a < b, but for pairs of lines of tau characters or fewer; lines has id, line, len and sig, with distinct texts."""
    long = lines.where(F.col("len") > SHORT)
    pairs = met(segment_keys(long, tau, False), segment_keys(long, tau, True), tau)
    short = materialize(rest_keys(lines.where(F.col("len") <= SHORT + tau), tau))
    pairs = materialize(pairs.union(met(short.where(F.col("len") <= SHORT), short, tau)))
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_ROWS
    texts = materialize(lines.select("id", "line").join(F.broadcast(ids) if few else ids, "id"))
    a, b = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    return verified(pairs.join(a, "a").join(b, "b"), tau)


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_links and kept of every line of every document.

    A class's name is its first line in order of doc_id and line_no, and only that is kept. n_links counts the
    other texts within tau edits. Blank lines are kept and are classes of their own.
    """
    rows = told_apart(docs)
    full = split_lines(rows).where("not blank")
    place = F.struct("doc_id", "t", "line_no")
    grouped = full.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("line").alias("line"), F.first("len").alias("len"), F.first("sig").alias("sig"))
    lines = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), codec="zstd")
    links = materialize(near_lines(lines, tau))
    # the shortest lines are all linked: each to one of them, and each counted with all of them
    tiny = F.col("len") <= tau
    n_tiny, one = lines.where(tiny).agg(F.count(F.lit(1)), F.min("id")).first()
    star = lines.where(tiny & (F.col("id") > F.lit(one))).select(F.lit(one).alias("a"), F.col("id").alias("b"))
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    member = materialize(components(links.union(star) if n_tiny > 1 else links, "a", "b"))
    named = lines.select("h1", "h2", "id", "first", tiny.alias("tiny")).join(materialize(degree), "id", "left").join(member, "id", "left")
    n_links = F.coalesce("n_links", F.lit(0)) + F.when(F.col("tiny"), F.lit(max(n_tiny - 1, 0))).otherwise(F.lit(0))
    named = materialize(named.select("h1", "h2", F.coalesce("component", "id").alias("class"), "first", n_links.alias("n_links")))
    heads = materialize(named.groupBy("class").agg(F.min("first").alias("head")))
    of_text = materialize(named.join(heads, "class").select("h1", "h2", "head", "n_links"))
    places = materialize(split_lines(rows, whole=False))
    known = places.where("not blank").join(of_text, ["h1", "h2"]).select("doc_id", "t", "line_no", "blank", "copies", "head", "n_links")
    blank = places.where("blank").select("doc_id", "t", "line_no", "blank", "copies", place.alias("head"), F.lit(0).cast("long").alias("n_links"))
    # a row for each copy, of which the first stands for all
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    each = known.union(blank)
    each = each.where("copies = 1").withColumn("copy", F.lit(1).cast("long")).union(each.where("copies > 1").select("*", copy))
    kept = F.col("blank") | (F.col("head").eqNullSafe(place) & (F.col("copy") == 1))
    return each.select("doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))
