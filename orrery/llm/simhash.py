"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints go into exact tables keyed by some of their bits. Each bucket is sorted by Gray rank, so
neighbours share long bit patterns; runs of neighbours become leaves, and upper nodes keep the bits
that all rows below share (a mask and a pattern). A search walks pairs of nodes from the top, adds up
the differences in the bits that both share, and drops the whole group of pairs once the sum passes the
radius. Buckets larger than CELL_ROWS are cut into chunks along the same order; pairs of chunks
whose patterns already differ by more than the radius are dropped, each other pair is a task's cell of
its own. Links are reduced to a spanning forest inside each cell, never emitted as pairs.

Null and empty texts have fingerprint zero. Repeated rows share one fingerprint and are linked
through it. A null doc_id is kept and labelled with its fingerprint's smallest non-null id (null if
there is none). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.components import components
from orrery.plans import materialize, ranked, release
from orrery.plans.workers import released

#: Rows of a bucket that one search takes whole; larger buckets are cut into chunks of half as many.
CELL_ROWS = 8192
FAN = 8
PAIRS = 1 << 18
#: Each byte's eight bits spread over the eight lanes of a 64-bit word, most significant bit first.
SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


# --- fingerprints ---------------------------------------------------------------------------------


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased: all of them, repeats included."""
    words = text.encode().lower().split() if text else []
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, starts = b" ".join(words), (ends[: len(words) - width + 1] - [len(w) + 1 for w in words[: len(words) - width + 1]]).tolist()
    return [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(items: list[bytes], bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half the items' hashes; no items give zeros."""
    if not items:
        return bytes(bits // 8)
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(items), 1 << 14):
        part = items[at : at + (1 << 14)]
        if bits == 64:
            got = np.array([xxhash.xxh64_intdigest(x, 42) for x in part], dtype=">u8").view(np.uint8)
        else:
            got = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x, s) for x in part for s in range(bits // 128)), dtype=np.uint8)
        ones += set_bits(got.reshape(len(part), bits // 8))
    return np.packbits(2 * ones > len(items)).tobytes()


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """By bit, how many of the hashes (rows of bytes) have it set."""
    ones = np.zeros(8 * hashes.shape[1], dtype=np.int64)
    lanes = SPREAD[hashes]
    for a in range(0, len(hashes), 255):  # a lane holds 255 at most
        ones += lanes[a : a + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return ones


def set_fingerprint(items: np.ndarray) -> bytes:
    """The 64-bit fingerprint of a set of hashes."""
    parts = [items[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8) for at in range(0, len(items), 1 << 14)]
    return np.packbits(2 * sum(map(set_bits, parts), np.zeros(64, dtype=np.int64)) > len(items)).tobytes()


def gray_rank(words: np.ndarray) -> np.ndarray:
    """The rank in Gray order of each row's first word."""
    x = words.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingles(t, width), bits) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, fp binary")


# --- tables ---------------------------------------------------------------------------------------


def exact_tables(rows: int, radius: int = 3, bits: int = 64) -> list[list[int]]:
    """Bit positions of each table: whichever `radius` bits differ, one table's bits all agree.

    With b blocks, every choice of b - radius of them is a table. b is the least that leaves few of
    `rows` random fingerprints in a bucket; every b finds the same links.
    """
    for blocks in range(radius + 1, 2 * radius + 4):
        if bits * (blocks - radius) // blocks >= log2(max(rows, 2)) - 4:
            break
    cut = np.array_split(np.arange(bits), blocks)
    return [sorted(np.concatenate(c).tolist()) for c in combinations(cut, blocks - radius)]


def _words(fps: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint8)
    return raw.reshape(len(fps), -1)


def _keys(raw: np.ndarray, tables: list[list[int]]) -> list[np.ndarray]:
    on = np.unpackbits(raw, axis=1)
    return [on[:, bits].astype(np.int64) @ (np.int64(1) << np.arange(len(bits), dtype=np.int64)) + (np.int64(t) << 53) for t, bits in enumerate(tables)]


def keyed(nodes: DataFrame, tables: list[list[int]], whole: bool) -> DataFrame:
    """A row for each node and table: key, and with `whole` also id, fp and Gray rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                raw = _words(b.column(1))
                n, keys = len(raw), np.concatenate(_keys(raw, tables))
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
                    continue
                again = pa.array(np.tile(np.arange(n), len(tables)))
                gray = gray_rank(raw[:, :8].copy().view(">u8").ravel()).view(np.int64)
                cols = [pa.array(keys), b.column(0).take(again), b.column(1).take(again), pa.array(gray).take(again)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "id", "fp", "gray"])

    return nodes.select("id", "fp").mapInArrow(released(run), "key long, id long, fp binary, gray long" if whole else "key long")


# --- search ---------------------------------------------------------------------------------------


def _span(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: which run each of sum(c) places is in, and its place there."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


class Forest:
    """Components of the links found so far among rows 0..n-1, and the links that made them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.made: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) != 0])]  # one link for each root that goes
            self.root[high[first]] = low[first]
            self.made.append((i[first], j[first]))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def search(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, radii: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs within the last of `radii` inside each cell, as two arrays of rows.

    The radii ascend, and pairs within a smaller one are linked first, so that any two rows of a tree are joined
    over links about as short as the best way between them allows. Rows are sorted by (cell, side, Gray rank); fp
    has a column for each 64 bits. A cell with one side is searched against itself; in a cell with two, the first
    against the second.
    """
    n = len(cell)
    forest = Forest(n)
    if n < 2:
        return cell[:0], cell[:0]
    group = np.concatenate([[0], np.cumsum((np.diff(cell) != 0) | (np.diff(side) != 0))])
    # levels from the leaves up: first child, number of children, shared mask and pattern, group
    levels = []
    low, high, of, at_level = fp, fp, group, 0
    while True:
        first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        start = np.flatnonzero(place % FAN == 0)
        low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
        levels.append((start, np.diff(np.append(start, len(of))), ~(low ^ high), low))
        of, at_level = of[start], at_level + 1
        if len(of) == group[-1] + 1:
            break
    at = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))  # a root for each group
    cells, sides = cell[at], side[at]
    two = np.flatnonzero((cells[1:] == cells[:-1]) & (sides[1:] != sides[:-1]))
    alone = np.setdiff1d(np.arange(len(at)), np.concatenate([two, two + 1]))
    a, b = np.concatenate([alone, two]), np.concatenate([alone, two + 1])
    none = np.zeros((len(a), fp.shape[1]), dtype=np.uint64)
    for radius in radii:
        _walk(levels, fp, forest, [(at_level - 1, a, b, none, np.zeros(len(a), dtype=np.int32))], radius)
    made = forest.made
    return (np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])) if made else (cell[:0], cell[:0])


def _walk(levels: list, fp: np.ndarray, forest: Forest, stack: list, radius: int) -> None:
    while stack:
        level, a, b, seen, sofar = stack.pop()
        start, size, mask, pattern = levels[level]
        common = mask[a] & mask[b]
        sofar = sofar + _bits((pattern[a] ^ pattern[b]) & common & ~seen)  # only bits not counted above
        near = sofar <= radius
        a, b, common, sofar = a[near], b[near], common[near], sofar[near]
        made = size[a] * size[b]
        ends = np.cumsum(made)
        if not len(a):
            continue
        take = max(1, int(np.searchsorted(ends, PAIRS, side="right")))
        if take < len(a):  # the rest later, counted anew
            stack.append((level, a[take:], b[take:], common[take:] * np.uint64(0), np.zeros(len(a) - take, dtype=np.int32)))
            a, b, common, sofar, made = a[:take], b[:take], common[:take], sofar[:take], made[:take]
        run, k = _span(made)
        i, j = start[a][run] + k // size[b][run], start[b][run] + k % size[b][run]
        use = (a[run] != b[run]) | ((i < j) if level == 0 else (i <= j))
        i, j, run = i[use], j[use], run[use]
        if level:
            stack.append((level - 1, i, j, common[run], sofar[run]))
        else:
            rest = forest.root[i] != forest.root[j]
            i, j = i[rest], j[rest]
            near = _bits(fp[i] ^ fp[j]) <= radius
            forest.link(i[near], j[near])


def linked(cells: DataFrame, radii: list[int]) -> DataFrame:
    """(src, dst) of a spanning forest of each cell's links; cells has cell, side, gray, id, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            cell, side, ids = (t.column(c).to_numpy() for c in ("cell", "side", "id"))
            fp = _words(t.column("fp").combine_chunks()).copy().view(np.uint64)
            i, j = search(cell, side, fp, radii)
            return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64())], ["src", "dst"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= 4 * CELL_ROWS:
                t = pa.Table.from_batches(held)
                cell = t.column("cell").to_numpy()
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if whole:
                    yield solve(t.slice(0, whole))
                    held = t.slice(whole).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return cells.select("cell", "side", "id", "fp").mapInArrow(released(run), "src long, dst long")


def chunked(keys: DataFrame, hot: DataFrame, radius: int, width: int) -> DataFrame:
    """Cells for buckets over CELL_ROWS: every pair of chunks whose shared patterns may be within radius."""
    rows = ranked(keys.join(hot.select("key"), "key", "left_semi"), ["gray", "id"], ["key"])
    chunk = rows.withColumn("chunk", F.floor(F.col("rank") / (CELL_ROWS // 2)).cast("long")).drop("rank")
    part = [F.conv(F.substring(F.hex("fp"), 16 * i + 1, 16), 16, -10).cast("long") for i in range(width)]
    chunk = materialize(chunk)
    node = chunk.groupBy("key", "chunk").agg(
        F.array(*[F.bit_and(p) for p in part]).alias("low"), F.array(*[F.bit_or(p) for p in part]).alias("high")
    )
    node = materialize(node)
    a = node.select("key", F.col("chunk").alias("c1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    b = node.select("key", F.col("chunk").alias("c2"), F.col("low").alias("l2"), F.col("high").alias("h2"))

    def apart(i: int):
        l1, h1, l2, h2 = (F.col(c)[i] for c in ("l1", "h1", "l2", "h2"))
        shared = F.bitwise_not(l1.bitwiseXOR(h1)).bitwiseAND(F.bitwise_not(l2.bitwiseXOR(h2)))
        return F.bit_count(l1.bitwiseXOR(l2).bitwiseAND(shared))

    differ = sum((apart(i) for i in range(1, width)), apart(0))
    pairs = a.join(b, "key").where((F.col("c1") <= F.col("c2")) & (differ <= radius)).select("key", "c1", "c2")
    pairs = pairs.withColumn("cell", F.xxhash64("key", "c1", "c2"))
    ends = pairs.select("key", F.col("c1").alias("chunk"), "cell", F.lit(0).alias("side")).union(
        pairs.where("c1 < c2").select("key", "c2", "cell", F.lit(1))
    )
    return chunk.join(materialize(ends), ["key", "chunk"]).select("cell", "side", "gray", "id", "fp")


def near_links(nodes: DataFrame, tables: list[list[int]], radii: list[int], bits: int = 64) -> DataFrame:
    """(src, dst) of links that connect all nodes within the last of `radii`; nodes has distinct id long and fp binary."""
    size = keyed(nodes, tables, whole=False).groupBy("key").count().where(F.col("count") > CELL_ROWS)
    hot = materialize(size.select("key"))
    keys = keyed(nodes, tables, whole=True)
    plain = keys if hot.isEmpty() else keys.join(hot, "key", "left_anti")
    cells = plain.select(F.col("key").alias("cell"), F.lit(0).alias("side"), "gray", "id", "fp")
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = linked(cells.repartition(count, "cell").sortWithinPartitions("cell", "side", "gray"), radii)
    if not hot.isEmpty():
        more = chunked(keys, hot, radii[-1], bits // 64)
        found = found.union(linked(more.repartition(count, "cell").sortWithinPartitions("cell", "side", "gray"), radii))
    return materialize(found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())


def near_groups(nodes: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """(id, component) of every node with a link."""
    found = near_links(nodes, tables, [radius])
    out = components(found)
    release(found)
    return out


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document; links at `radius` bits or fewer."""
    fps = materialize(fingerprints(docs, width).withColumn("id", F.conv(F.hex("fp"), 16, -10).cast("long")))
    nodes = materialize(fps.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    groups = near_groups(nodes.select("id", "fp"), exact_tables(nodes.count(), radius), radius)
    member = materialize(groups)
    least = nodes.join(member, "id", "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    smallest = materialize(least.groupBy("component").agg(F.min("least").alias("component_id")))
    label = materialize(materialize(least.select("id", "component")).join(smallest, "component").select("id", "component_id"))
    return fps.join(label, "id").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# --- dropping near-duplicate documents ------------------------------------------------------------

#: A pair of similarity J shares the least shingle under one of the BANDS * ROWS orders with probability J, all ROWS of
#: a band with J ** ROWS, and no band with (1 - J ** ROWS) ** BANDS: 7e-5 at 0.8, for short texts as for long ones.
BANDS, ROWS = 24, 5
#: Fingerprints of shingle sets that differ in so many bits are candidates by themselves.
RADIUS = 3
_RNG = np.random.default_rng(7)
SALTS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Documents whose texts or keys are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingle sets of a group of candidates that are compared in one cell; larger groups are cut into chunks of as many.
CELL_SETS = 512


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matched(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between rows whose sets have a Jaccard similarity of `least` or more, enough to connect all such rows.

    Rows of one label are connected already. Every other pair is compared, or with two sides every pair across
    them, but those that links found before connect.
    """
    root = np.unique(label, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    on = np.zeros(len(values), dtype=bool)
    two, made = side[0] != side[-1], []
    for i in range(len(sets) - 1):
        other = (root[i + 1 :] != root[i]) & (np.minimum(size[i + 1 :], size[i]) >= least * np.maximum(size[i + 1 :], size[i]))
        rest = np.flatnonzero(other & (side[i + 1 :] != side[i]) if two else other) + i + 1
        if not len(rest):
            continue
        own = code[start[i] : start[i] + size[i]]
        on[own] = True
        for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) >> 20)) + 1):
            run, k = _span(size[part])
            both = np.bincount(run, weights=on[code[start[part][run] + k]], minlength=len(part))
            for j in part[both >= least * (size[i] + size[part] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    made.append((i, j))
        on[own] = False
    return made


def set_links(cells: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst) of the links that `matched` finds in each cell of (cell, side, id, label); sets has id and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            side, ids, label = (t.column(c).to_numpy() for c in ("side", "id", "label"))
            made = matched(label, side, [np.frombuffer(x, dtype="<u8") for x in t.column("items").to_pylist()], least) if len(ids) > 1 else []
            src, dst = ([ids[x[k]] for x in made] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            cell = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                if held and held[-1].column(0)[0].as_py() != cell[at]:
                    yield solve(held)
                    held = []
                held.append(b.slice(at, end - at))
        if held:
            yield solve(held)

    count = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = materialize(cells)
    # cells are a few longs a row and often few beside the sets, which then stay where they are but for those of a cell
    rows = _few(cells).join(sets.where("octet_length(items) > 0"), "id").select("cell", "side", "id", "label", "items")
    out = materialize(rows.repartition(count, "cell").sortWithinPartitions("cell", "side").mapInArrow(released(run), "src long, dst long"))
    release(cells)
    return out


def similar(groups: DataFrame, sets: DataFrame, least: float, tables: list[list[int]]) -> DataFrame:
    """Links (src, dst) that connect the ids whose shingle sets have a Jaccard similarity of `least` or more.

    groups has id, keys, component and fp, sets has id and items (sorted hashes). In a group of CELL_SETS ids or fewer every
    pair is compared but those that verified links connect. A larger group may be a chain of unlike texts, so
    its pairs are those that share a key, of its own or of its fingerprint's in `tables`: first its ids are cut into chunks in the order of one key after another, and
    one id of each set of connected ones goes on as long as that connects more; then every key whose ids are not
    all connected is a cell. A key of over CELL_SETS ids is cut into chunks, and all pairs of its chunks are
    compared whose ids are not all connected and whose sizes allow the similarity.
    """
    large = materialize(groups.groupBy("component").count().where(F.col("count") > CELL_SETS).select("component"))
    small = groups.join(large, "component", "left_anti")
    found = set_links(small.select(F.col("component").alias("cell"), F.lit(0).alias("side"), "id", F.col("id").alias("label")), sets, least)
    if large.isEmpty():
        return found
    named = materialize(groups.join(large, "component").select("id", "component", "keys", F.col("id").alias("label")))
    before = named.count()
    for turn in range(BANDS):
        part = named.where("id = label").select("id", "component", F.get("keys", F.lit(turn)).alias("key"))
        chunk = ranked(part, ["key", "id"], ["component"]).withColumn("chunk", F.floor(F.col("rank") / CELL_SETS))
        new = set_links(chunk.select(F.xxhash64("component", "chunk").alias("cell"), F.lit(0).alias("side"), "id", F.col("id").alias("label")), sets, least)
        found = found.union(new)
        # the links are between labels, so that each turn's are fewer
        member = components(new).select(F.col("id").alias("label"), F.col("component").alias("then"))
        named = materialize(named.join(materialize(member), "label", "left").select("id", "component", "keys", F.coalesce("then", "label").alias("label")))
        left = named.where("id = label").count()
        if left > 0.9 * before:
            break
        before = left
    every = with_table_keys(groups.join(large, "component", "left_semi"), tables)
    at = materialize(every.join(named.select("id", "label"), "id").select("id", "label", F.explode("keys").alias("key")))
    mixed = materialize(at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key", "n"))
    few = at.join(mixed.where(F.col("n") <= CELL_SETS).select("key"), "key")
    inside = set_links(few.select(F.col("key").alias("cell"), F.lit(0).alias("side"), "id", "label"), sets, least)
    many = at.join(mixed.where(F.col("n") > CELL_SETS).select("key"), "key")
    return found.union(inside).union(across(many, sets, least))


def across(at: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (src, dst) among the ids of a key, of (id, label, key), by pairs of chunks of CELL_SETS ids."""
    sized = at.join(sets.select("id", (F.octet_length("items") / 8).alias("size")), "id")
    chunk = materialize(ranked(sized, ["label", "size", "id"], ["key"]).withColumn("chunk", F.floor(F.col("rank") / CELL_SETS)))
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("label", "size")]
    node = materialize(chunk.groupBy("key", "chunk").agg(*ends))
    a, b = (node.select("key", *[F.col(c).alias(f"{c}_{k}") for c in node.columns[1:]]) for k in "ab")
    same = "min_label_a = max_label_a and min_label_b = max_label_b and min_label_a = min_label_b"
    fits = (F.col("max_size_a") >= least * F.col("min_size_b")) & (F.col("max_size_b") >= least * F.col("min_size_a"))
    pairs = a.join(b, "key").where("chunk_a <= chunk_b").where(f"not ({same})").where(fits)
    pairs = materialize(pairs.select("key", "chunk_a", "chunk_b", F.xxhash64("key", "chunk_a", "chunk_b").alias("cell")))
    sides = pairs.select("key", F.col("chunk_a").alias("chunk"), "cell", F.lit(0).alias("side")).union(
        pairs.where("chunk_a < chunk_b").select("key", "chunk_b", "cell", F.lit(1))
    )
    return set_links(chunk.join(sides, ["key", "chunk"]).select("cell", "side", "id", "label"), sets, least)


def shingle_set(text: str | None, width: int) -> bytes:
    """The sorted hashes of the text's distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles(text, width)], dtype="<u8")).tobytes()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, items) of rows (id, text): the sorted hashes of the text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], ["id", "items"])

    return docs.select("id", "text").mapInArrow(released(run), "id long, items binary")


def band_keys(items: np.ndarray) -> list[int]:
    """A key for each band: a hash of the least items under its orders. No items have no keys."""
    if not len(items):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(items), 512):
        mixed = (items[at : at + 512, None] ^ SALTS) * FACTORS
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def band_links(nodes: DataFrame) -> DataFrame:
    """(src, dst): each id of nodes (id, keys) and the least id that shares one of its keys, where that is another."""
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    least = materialize(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return keyed.join(least, "key").where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst")).distinct()


def index_links(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(src, dst): links that connect the ids of nodes (id, fp) whose fingerprints differ in RADIUS bits or fewer.

    Ids of one fingerprint are linked to the least of them, which stands for it in the index.
    """
    rows = nodes.select("id", "fp", F.conv(F.hex("fp"), 16, -10).cast("long").alias("word"))
    least = materialize(rows.groupBy("word").agg(F.min("id").alias("least"), F.first("fp").alias("fp")))
    same = rows.join(least.select("word", "least"), "word").where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst"))
    return near_links(least.select(F.col("least").alias("id"), "fp"), tables, [RADIUS]).union(same)


def with_table_keys(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """nodes (id, keys, fp) with the keys of its fingerprint in `tables` after its own: a pair that the index links shares one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for at in range(0, every.num_rows, 2000):
                b = every.slice(at, 2000)
                more = np.stack(_keys(_words(b.column(2)), tables), axis=1).tolist()
                keys = [k + m for k, m in zip(b.column(1).to_pylist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return nodes.select("id", "keys", "fp").mapInArrow(released(run), "id long, keys array<long>")


def drop_near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) without all but the first document, by doc_id, of each group of near-duplicates.

    Candidates are all pairs of documents that the index of fingerprints above links, by SimHash of their distinct
    `width`-word shingles and at RADIUS bits; and, since RADIUS bits reach no similarity near `least` (more would need
    hundreds of tables), those that share a band of least hashes besides. Candidates only say which documents may belong
    together: they are then compared on whole shingle sets, and none but verified links make a pair needless.
    Texts with the same set of shingles are copies of each other; so are all texts without a word. Documents
    that repeat doc_id and text are one document; of several texts under one doc_id the smallest hash comes first.
    Very long texts are read whole; an empty table gives an empty one; columns besides these stay as they are.
    Names that begin with `_near_` are reserved.
    """
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("_near_h", h)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            ids = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], dtype=np.uint64).view(np.int64)
            items = [np.frombuffer(x, dtype="<u8") for x in sets]
            keys, fps = pa.array([band_keys(x) for x in items], pa.list_(pa.int64())), pa.array([set_fingerprint(x) for x in items], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), keys, fps], ["doc_id", "h", "id", "keys", "fp"])

    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_near_h").alias("h"), F.col("text").cast("string").alias("text"))
    marked = materialize(texts.mapInArrow(released(mark), "doc_id long, h long, id long, keys array<long>, fp binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    nodes = materialize(marked.groupBy("id").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), first))
    tables = exact_tables(nodes.count(), RADIUS)
    candidates = index_links(nodes.where(F.size("keys") > 0), tables).union(band_links(nodes))
    groups = materialize(components(candidates))
    held = nodes.join(groups, "id").select("id", "keys", "fp", "component", F.col("first.doc_id").alias("k_id"), F.col("first.h").alias("k_h"))
    held = materialize(held)
    # a text of each shingle set that has a link
    own = texts.join(_few(held.select("id", "k_id", "k_h")), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))).select("id", "text")
    sets = materialize(shingle_sets(own, width).dropDuplicates(["id"]))
    member = materialize(components(similar(held.select("id", "keys", "fp", "component"), sets, least, tables)))
    of = nodes.select("id", "first").join(member, "id", "left").select("id", "first", F.coalesce("component", "id").alias("group"))
    of = materialize(of)
    heads = materialize(of.groupBy("group").agg(F.min("first").alias("head")))
    head = materialize(of.join(heads, "group").select("id", F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h")))
    copies = marked.join(head, "id").where(~F.col("doc_id").eqNullSafe(F.col("head_id")) | (F.col("h") != F.col("head_h")))
    gone = materialize(copies.select(F.col("doc_id").alias("_near_gone_id"), F.col("h").alias("_near_gone_h")).distinct())
    kept = rows.join(_few(gone), F.col("doc_id").eqNullSafe(F.col("_near_gone_id")) & (F.col("_near_h") == F.col("_near_gone_h")), "left_anti")
    again = marked.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_near_gone_id"), F.col("h").alias("_near_gone_h"))
    again = materialize(again)
    release(marked, nodes, groups, held, sets, member, of, heads, head)
    if again.isEmpty():
        return kept.drop("_near_h")
    on = F.col("doc_id").eqNullSafe(F.col("_near_gone_id")) & (F.col("_near_h") == F.col("_near_gone_h"))
    few = _few(again)
    return kept.join(few, on, "left_anti").union(kept.join(few, on, "left_semi").dropDuplicates(["doc_id", "_near_h"])).drop("_near_h")
