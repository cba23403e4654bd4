"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source_size times. The whole part is taken; the fractions are
rounded by the pivotal method: two documents meet, and words move from one to the other until one fraction is 0
or 1. Which way is drawn anew for every meeting, with chances that keep both fractions' expectations, whatever
happened before; the words taken from the two stay the same. Longer documents meet first, so that what is left
over is short. What is left over, one document at most for each node, meets the other leftovers further up a tree
of fan-in 64, and the last one at the root is drawn by its fraction. A source's words therefore miss its target by
no more than one document's words, and every document keeps its expectation.

Rounding works on keys (doc_id, hash of the text, source, size); texts join the outcome afterwards. Leaves are fixed by
hashes of the keys, and a node's draws by its name, so a rerun over other partitions takes the same copies, and
a hot source spreads over all leaves. Rows that repeat doc_id, text and source are one key of n times the
fraction, whose copies they share evenly. Null text has size 0, null source is a source of its own, in the last
place; a document of no words is taken by a draw of its own, as no words depend on it. Very long texts are one
document of many words; an empty table gives an empty one. Other columns are carried along by mixed_documents
(of repeated rows one row's); names starting with `_mix_` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans import materialize, ranked
from orrery.plans.workers import released

MOST = 3
LEAF_ROWS = 4_000
FAN_BITS = 6
EPS = 1e-9
#: Keys of documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating by code point order of the source, null last.

    sizes has source and size. A target is its weight's share of all words, `most` times its source's size at
    most; the excess is shared among the others by weight until none is above.
    """
    by = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weighed = materialize(
        ranked(by, [F.col("source").asc_nulls_last()], out="place").select(
            "source", "source_size", (F.lit(most).cast("long") * F.col("source_size")).alias("cap"), (F.col("place") % 3 + 1).alias("weight")
        )
    )
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total / weight if weight else 0.0), -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        held, caps, rest = weighed.agg(F.count_if(at_cap), F.sum(F.when(at_cap, F.col("cap"))), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if held == full or not rest:
            break
        full, level = held, (total - (caps or 0)) / rest
    target = F.when(at_cap, F.col("cap").cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def pivot(size: list[int], p: list[float], draw: Callable[[], float]) -> int | None:
    """Round the fractions p in place by pairs, keeping sum(size * p); the place left over, if any.

    `draw` gives a new number in [0, 1) at every meeting. A meeting moves `up` words to the first with probability
    down / (up + down), or `down` words from it, so that neither fraction's expectation changes.
    """
    held: int | None = None
    for j in range(len(p)):
        if not EPS < p[j] < 1 - EPS:
            p[j] = float(round(p[j]))
            continue
        if held is None:
            held = j
            continue
        i = held
        fill, drain = size[i] * (1 - p[i]), size[j] * p[j]
        give, room = size[i] * p[i], size[j] * (1 - p[j])
        up, down = min(fill, drain), min(give, room)
        if draw() * (up + down) < down:
            p[i], p[j] = (1.0 if fill <= drain else p[i] + up / size[i]), (0.0 if drain <= fill else p[j] - up / size[j])
        else:
            p[i], p[j] = (0.0 if give <= room else p[i] - down / size[i]), (1.0 if room <= give else p[j] + down / size[j])
        for k in (i, j):
            if not EPS < p[k] < 1 - EPS:
                p[k] = float(round(p[k]))
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return held


def rounded(size: list[int], p: list[float], name: str, last: bool) -> int | None:
    """Round a node's fractions in place, by draws that its name fixes; the place left over unless it is the `last` node."""
    draw = Random(xxhash.xxh3_64_intdigest(name)).random
    for i in range(len(p)):
        if not size[i]:
            p[i] = float(draw() < p[i])
    left = pivot(size, p, draw)
    if left is not None and last:
        p[left], left = float(draw() < p[left]), None
    return left


def _rounded(keys: list[str], seed: int, level: int):
    """Rounds each node's rows; the row left over keeps its fraction unless the level is 0."""

    def solve(t: pa.Table, node: tuple) -> Iterator[pa.RecordBatch]:
        size, p, whole = (t.column(c).to_pylist() for c in ("_mix_size", "_mix_p", "_mix_whole"))
        left = rounded(size, p, repr((seed, level, *node)), level == 0)
        copies = [None if i == left else w + int(x) for i, (w, x) in enumerate(zip(whole, p, strict=True))]
        done = {"_mix_p": pa.array(p, pa.float64()), "_mix_copies": pa.array(copies, pa.int64())}
        yield from pa.table({c: done.get(c, t.column(c)) for c in t.column_names}).to_batches(max_chunksize=5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            start = 0
            for i, k in enumerate(names):
                if k != node:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    if held:
                        yield from solve(pa.Table.from_batches(held), node)
                    node, held, start = k, [], i
            if start < len(names):
                held.append(b.slice(start))
        if held:
            yield from solve(pa.Table.from_batches(held), node)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, _mix_h (a hash of the text) and _mix_size of every row."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", F.xxhash64(text).alias("_mix_h"), n_words(text).alias("_mix_size"))


def mix(keys: DataFrame, seed: int = 11, most: int = MOST) -> DataFrame:
    """Each distinct row of keys with _mix_rows, _mix_total (its source's words), _mix_target and _mix_copies of all its rows."""
    held = materialize(keys.groupBy("doc_id", "source", "_mix_h", "_mix_size").agg(F.count(F.lit(1)).alias("_mix_rows")))
    sizes = materialize(held.groupBy("source").agg(F.sum(F.col("_mix_size") * F.col("_mix_rows")).alias("size"), F.count(F.lit(1)).alias("rows")))
    # leaves of LEAF_ROWS rows or fewer, 2^bits for a source
    bits = F.greatest(F.ceil(F.log2(F.col("rows") / LEAF_ROWS) / FAN_BITS), F.lit(0)) * FAN_BITS
    rows = sizes.select(F.col("source").alias("_mix_source"), bits.cast("int").alias("_mix_bits"))
    of = source_targets(sizes, most).join(rows, F.col("source").eqNullSafe(F.col("_mix_source")))
    of = materialize(of.select("_mix_source", "_mix_bits", F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target")))
    level = of.agg(F.max("_mix_bits")).first()[0] or 0
    share = F.when(F.col("_mix_total") > 0, F.col("_mix_target") / F.col("_mix_total")).otherwise(F.lit(0.0)) * F.col("_mix_rows")
    hashed = F.xxhash64(F.lit(seed + 1), "doc_id", "_mix_h", "_mix_size", "source")
    # of has a row for each source: it is broadcast if it is small, else a hot source's rows are split
    leaf = (
        held.join(of, F.col("source").eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_whole", F.floor(share).cast("long"))
        .withColumn("_mix_p", share - F.floor(share))
        .withColumn("_mix_node", F.pmod(hashed, F.expr("shiftleft(1L, _mix_bits)")))
        .withColumn("_mix_copies", F.lit(None).cast("long"))
        .drop("_mix_source", "_mix_bits")
    )
    parts, names = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["_mix_node", "source"]
    done: DataFrame | None = None
    while True:
        last = level == 0
        # no two rows tie, so that a node's meetings are the same in every run; a node has few rows, or 64 leftovers
        ordered = leaf.repartition(parts, *names).sortWithinPartitions(*names, F.col("_mix_size").desc(), "doc_id", "_mix_h")
        stage = materialize(ordered.mapInArrow(released(_rounded(names, seed, level)), leaf.schema))
        settled = stage.where(F.col("_mix_copies").isNotNull())
        done = settled if done is None else done.union(settled)
        if last:
            break
        level -= FAN_BITS
        leaf = stage.where(F.col("_mix_copies").isNull()).withColumn("_mix_node", F.shiftright("_mix_node", FAN_BITS))
    return done.drop("_mix_whole", "_mix_p", "_mix_node")


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Repeated rows are one row, taken as often as all of them.
    """
    same = ["doc_id", "source", "_mix_h", "_mix_size"]
    marked = docs.withColumns({"_mix_h": F.xxhash64(F.col("text").cast("string")), "_mix_size": n_words(F.col("text").cast("string"))})
    taken = materialize(mix(keyed(docs), seed).where("_mix_copies > 0").select(*[F.col(c).alias(f"_mix_of_{i}") for i, c in enumerate(same)], "_mix_rows", "_mix_copies"))
    on = F.lit(True)
    for i, c in enumerate(same):
        on &= F.col(c).eqNullSafe(F.col(f"_mix_of_{i}"))
    both = marked.join(F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken, on)
    if not taken.where("_mix_rows > 1").isEmpty():
        both = both.where("_mix_rows = 1").union(both.where("_mix_rows > 1").dropDuplicates(same))
    repeats = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_copy")
    return both.select(*[F.col(c) for c in docs.columns], repeats).drop("_mix_copy")


def mix_report(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row."""
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_rows"))).alias("_mix_row")
    each = mix(keyed(docs), seed).select("*", row)
    own = F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (F.col("_mix_row") <= F.col("_mix_copies") % F.col("_mix_rows")).cast("long")
    return each.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * own).alias("taken"))
