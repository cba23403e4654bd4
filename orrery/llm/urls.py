"""URL filters: fixed rules first, then a tree of path templates judged by smoothed purity.

The tree has a level for every path segment of a host, down to the last. A segment of digits, or of eight or more
hexadecimal digits, is variable and becomes a wildcard, with its file ending. From the top down, the branches of a
node are put in order of their share of blocked pages, and neighbours in that order are merged unless their shares
differ by more than Z standard errors of that difference; branches without labelled pages are merged with each
other. A node is not cut further once its labelled pages are all of one verdict, or it has none, or has one path only,
since no branch can then stand apart; its pages' template ends in `**`. Labels are the verdicts of the rules. A
template's purity is its blocked share, smoothed by WEIGHT pages of its host's share, which is smoothed by WEIGHT
pages of the whole table's; BAD or more is blocked.

Branches of equal counts are one row when they are put in order, so that a node of many branches is no large sort.
Null urls, and those without `://`, have an empty host and path; they form a template like others. Very long urls are
read whole; a level is taken for each segment that tells mixed pages apart. Without labelled pages every
purity is 0. An empty table gives an empty one. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans import materialize

#: The fixed rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
Z = 2.0
WEIGHT = 4.0
BAD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def lexical(path: Column) -> Column:
    """The path's segments joined by `/`, none of them empty, variable ones as wildcards."""

    def general(s: Column) -> Column:
        variable = s.rlike(r"^[0-9]+(\.[a-z]{2,5})?$") | s.rlike(r"^[0-9a-fA-F]{8,}$")
        return F.when(variable, F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[a-z]{2,5})?$", 1))).otherwise(s)

    return F.array_join(F.transform(F.array_remove(F.split(path, "/"), ""), general), "/")


def branches(children: DataFrame) -> DataFrame:
    """host, tpl, child, name: what each branch (child) of a node is called; children has b blocked of l labelled pages.

    The name is the branch's own if it is merged with no other, else the number of the merged ones.
    """
    node = ["host", "tpl"]
    alike = children.groupBy(*node, "b", "l").agg(F.count(F.lit(1)).alias("m"))
    order = W.partitionBy(*node).orderBy(F.col("l") > 0, F.try_divide("b", "l"), "l")
    b0, l0 = F.lag("b").over(order), F.lag("l").over(order)
    q = (F.col("b") + b0) / (F.col("l") + l0)
    off = F.abs(F.try_divide("b", "l") - F.try_divide(b0, l0)) > Z * F.sqrt(q * (1 - q) * (F.try_divide(F.lit(1.0), "l") + F.try_divide(F.lit(1.0), l0)))
    parted = alike.withColumn("parts", F.when((F.col("l") > 0) & ((F.coalesce(l0, F.lit(0)) == 0) | off), 1).otherwise(0))
    numbered = parted.withColumn("group", F.sum("parts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    size = F.sum("m").over(W.partitionBy(*node, "group")).alias("members")
    named = materialize(numbered.select(*node, "b", "l", "group", size))
    name = F.when(F.col("members") == 1, F.col("child")).otherwise(F.concat(F.lit("{"), "group", F.lit("}")))
    return children.join(named, [*node, "b", "l"]).select(*node, "child", name.alias("name"))


def template_tree(pages: DataFrame) -> DataFrame:
    """host, lex, template, purity of every lexical path; pages has host, lex and bad (1, 0 or null)."""
    rows = pages.groupBy("host", "lex").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("lab"))
    live, done, level = materialize(rows.withColumn("tpl", F.lit(""))), None, 0
    parts = F.split("lex", "/")
    depth = F.when(F.col("lex") == "", 0).otherwise(F.size(parts))
    while True:
        whole = live.groupBy("host", "tpl").agg(F.sum("bad").alias("nb"), F.sum("lab").alias("nl"), F.count(F.lit(1)).alias("nr"))
        known = materialize(live.join(materialize(whole), ["host", "tpl"]))
        mixed = (F.col("nb") > 0) & (F.col("nb") < F.col("nl"))
        cuts = mixed & (F.col("nr") > 1) & (depth > level)
        rest = F.concat("tpl", F.lit("/"), F.array_join(F.slice(parts, level + 1, F.greatest(depth, F.lit(1))), "/"))
        ended = F.when(depth <= level, F.col("tpl")).when(mixed, rest).otherwise(F.concat("tpl", F.lit("/**")))
        closed = known.where(~cuts).select("host", "lex", "bad", "lab", ended.alias("tpl"))
        done = closed if done is None else done.union(closed)
        going = known.where(cuts).select("host", "lex", "bad", "lab", "tpl", parts[level].alias("child"))
        if going.isEmpty():
            break
        children = materialize(going.groupBy("host", "tpl", "child").agg(F.sum("bad").alias("b"), F.sum("lab").alias("l")))
        named = materialize(branches(children))
        live = materialize(going.join(named, ["host", "tpl", "child"]).select("host", "lex", "bad", "lab", F.concat("tpl", F.lit("/"), "name").alias("tpl")))
        level += 1
    done = materialize(done)
    total = done.agg(F.sum("bad"), F.sum("lab")).first()
    share = total[0] / total[1] if total[1] else 0.0
    hosts = materialize(done.groupBy("host").agg(((F.sum("bad") + WEIGHT * F.lit(share)) / (F.sum("lab") + WEIGHT)).alias("hp")))
    sums = materialize(done.groupBy("host", "tpl").agg(F.sum("bad").alias("tb"), F.sum("lab").alias("tl")))
    purity = (F.col("tb") + WEIGHT * F.col("hp")) / (F.col("tl") + WEIGHT)
    judged = materialize(sums.join(hosts, "host").select("host", "tpl", purity.alias("purity")))
    return materialize(done.join(judged, ["host", "tpl"]).select("host", "lex", F.concat("host", "tpl").alias("template"), "purity"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    marked = known.select("*", rule.alias("rule"), verdict.alias("said"), lexical(F.col("path")).alias("lex"))
    marked = materialize(marked.withColumn("bad", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int"))))
    judged = F.when(F.col("purity") >= BAD, "block").otherwise("allow")
    return marked.join(template_tree(marked), ["host", "lex"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "template", F.round("purity", 9).alias("purity")
    )
