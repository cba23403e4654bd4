"""Decontamination, lines, shards and urls against plain Python, with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from orrery.llm import decontamination, lines, sharding, sql, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for s in range(max(1, len(w) - 7)):
            if w:
                wins[tuple(w[s : s + 8])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "délta", "x1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 3, 7, 8, 9, 20, 40])]
    items += [(8, items[7][1]), (None, "one two three four five six seven eight nine"), (9, None), (10, "never said in any of the documents here")]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 5, 60, 300)] + [f"pre {items[6][1]}; {items[7][1].upper()} post"]
    rows = [(100 + i, t, None, None, None) for i, t in enumerate(texts)] + [tuple(r)[:5] for r in docs().collect()]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.decontaminate(docs(rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == contaminated([r[:2] for r in rows], items)
    if most:
        kept = decontamination.drop_contaminated(docs(rows), bench)
        assert kept.columns == docs().columns
        assert kept.count() == sum(x[3] == 0 for x in contaminated([r[:2] for r in rows], items))
        assert decontamination.decontaminate(docs([]), bench).collect() == []
        assert {r["n_items"] for r in decontamination.decontaminate(docs(), bench.limit(0)).collect()} == {0}


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abc")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        for most in (1, 2, 3):
            assert lines.edit_distance("".join(a), "".join(b), most) == min(lines._plain("".join(a), "".join(b)), most + 1)


def test_line_classes(docs):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(21, 60))) for _ in range(25)]
    every = []
    for x in base:
        for _ in range(rng.randint(1, 5)):
            y = list(x)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(y))
                y[k : k + 1] = rng.choice([[], ["z"], ["z", "q"]])
            every.append("".join(y))
    every += ["short", "short", "shore", "", " "]
    rng.shuffle(every)
    rows = [(i, "\n".join(every[5 * i : 5 * i + 5]), None, None, None) for i in range(len(every) // 5 + 1)]
    rows += [(90, None, None, None, None), (None, base[0], None, None, None)]
    at = {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                at.setdefault(line, (d, n))
    texts = list(at)
    near = {x: [y for y in texts if y != x and lines._plain(x, y) <= 2] for x in texts}
    label = {x: x for x in texts}
    for _ in texts:
        label = {x: min((label[y] for y in [x, *near[x]]), key=lambda y: (at[y][0] is not None, at[y])) for x in texts}
    got = lines.line_classes(docs(rows)).collect()
    assert len(got) == sum(len((t or "").split("\n")) for _, t, *_ in rows)
    by_place = {d: (t or "").split("\n") for d, t, *_ in rows}
    for r in got:
        line = by_place[r["doc_id"]][r["line_no"]]
        if line.strip():
            assert (r["class_doc_id"], r["class_line_no"]) == at[label[line]], line
            assert r["n_links"] == len(near[line])
        else:
            assert r["kept"] and not r["n_links"]
    assert sum(r["kept"] for r in got if by_place[r["doc_id"]][r["line_no"]].strip()) == len(set(label.values()))
    assert lines.line_classes(docs([])).collect() == []
    assert lines.line_classes(docs()).count() == sum(len((r["text"] or "").split("\n")) for r in docs().collect())


def test_shards(spark, docs):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 400), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), 1) for i in range(3000)]
    rows += [(5000 + i, "the same text again and again", "en", "hot", 1) for i in range(1500)] + [(7000 + i, f"pair {i // 2}", str(i), str(i), 1) for i in range(100)]
    got = sharding.shard_table(docs(rows)).collect()
    assert len(got) == len(rows)
    size, slots, shard = defaultdict(int), defaultdict(list), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]] = r["shard"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    mean = sum(size.values()) / 16
    assert len(size) == 16 and all(abs(s - mean) < 0.05 * mean for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(shard[7000 + i] == shard[7000 + i + 1] for i in range(0, 100, 2))  # copies stay together
    odd = sharding.shard_table(docs()).collect()
    assert len(odd) == docs().count() and {r["shard"] for r in odd} <= set(range(16))
    assert sharding.shard_table(docs([])).collect() == []


def test_tree_against_plain_python(spark):
    """The tree's cuts, worked out by hand on the same units."""
    rng = random.Random(5)
    groups = [(i, rng.randint(1, 900), rng.choice("aaab"), rng.choice("xy"), rng.choice([1, 2, 3, 50])) for i in range(400)]
    units = sharding.placed_units(spark.createDataFrame(groups, "g long, w long, source string, lang string, size long"))
    rows = [r.asDict() for r in units.collect()]
    total = sum(r["w"] for r in rows)
    for c, d in ((2, "d_source"), (3, "d_lang"), (4, "d_size")):
        value = {g[0]: g[c] for g in groups}
        for r in rows:
            own = value[r["g"]]
            middle = sum(g[1] for g in groups if g[c] < own) + sum(g[1] for g in groups if g[c] == own) / 2
            assert r[d] == int(middle * sharding.BINS / total)
    room = [10.0, 0.0, 5.0, 5.0, 7.0]

    def cut(part, lo, hi):
        if hi - lo == 1 or not part:
            return {r["g"]: lo for r in part}
        mid = (lo + hi) // 2
        share = sum(room[lo:mid]) / sum(room[lo:hi]) if sum(room[lo:hi]) else 1.0
        d = max(sharding.DIMENSIONS, key=lambda d: max(r[d] for r in part) - min(r[d] for r in part))
        left, sofar = sum(r["w"] for r in part) * share, 0
        for b in sorted({r[d] for r in part}):
            here = sum(r["w"] for r in part if r[d] == b)
            if sofar + here >= left:
                break
            sofar += here
        want, sofar, h_cut = left - sofar, 0, 1 << sharding.HASH_BITS
        for h in sorted({r["h"] for r in part if r[d] == b}):
            here = sum(r["w"] for r in part if r[d] == b and r["h"] == h)
            if sofar + here / 2 > want:
                h_cut = h
                break
            sofar += here
        right = [r for r in part if r[d] > b or (r[d] == b and r["h"] >= h_cut)]
        return cut([r for r in part if r not in right], lo, mid) | cut(right, mid, hi)

    got = {r["g"]: r["shard"] for r in sharding.tree(units, room).collect()}
    assert got == cut(rows, 0, len(room)) and len(set(got.values())) == 4


def test_groups_are_never_torn(spark, docs):
    """Groups of every size, one of them larger than a shard, share a shard each, and the rest is level."""
    sizes = [2, 3, 8, 40, 200, 300, 6000]
    rows = [(1000 * k + i, f"group {k} " + "y" * 90, "en", str(i % 3), 1) for k, n in enumerate(sizes) for i in range(n)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(10**6 + i, "z" * (i % 300), "de", "s", 1) for i in range(4000)]
    got = sharding.shard_table(docs(rows)).collect()
    text = {r[0]: r[1] for r in rows}
    at, bytes_of = defaultdict(set), defaultdict(int)
    for r in got:
        at[text[r["doc_id"]]].add(r["shard"])
        bytes_of[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in at.values())
    (alone,) = at["group 6 " + "y" * 90]
    rest = [n for s, n in bytes_of.items() if s != alone]
    assert len(rest) == 15 and max(rest) < 1.05 * min(rest) < bytes_of[alone]
    few = sharding.kd_shards(spark.createDataFrame([(i, 100, i, "a", "b") for i in range(50)], "doc_id long, size long, g long, source string, lang string"), target_bytes=1000)
    assert sorted(r["count"] for r in few.groupBy("shard").count().collect()) == [10] * 5


ODD_URLS = [None, "", "no scheme", "http://", "http://HOST.Example.ORG", "https://example.org/es/1?x", "http://a.example.org/en/12#top", "x://b.com/fr/a/b/c/d/e", "http://b.com/de/", "http://notorg/en/1", "http://a.net/0123456789abcdef/" + "y" * 30, "a://b://c/d", "http://x.org?q=/es/"]


def test_urls_against_sql(spark):
    rng = random.Random(1)
    made = [f"http://h{rng.randint(0, 3)}.{rng.choice(['org', 'com', 'net', 'example.org'])}/{rng.choice(['en', 'de', 'fr', 'es', 'blog'])}/{rng.choice(['1', '20', 'a', 'b'])}{rng.choice(['', '.html', '/x/9', '/x/y/z' + rng.choice('abc') + '/deep/' + rng.choice('pq')])}" for _ in range(900)]
    made += [f"http://h0.example.org/en/{rng.choice(['a', '1'])}b/{rng.choice('abcd')}/{rng.choice('xy')}/{rng.randint(0, 3)}/{rng.choice('mnop')}/end" for _ in range(300)]
    rows = [(i, u) for i, u in enumerate(ODD_URLS + made + made[:20])]
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "url AS host", "url AS path")).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(sql.URL_FILTER).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].fillna("").itertuples(index=False, name=None)))
    assert key(got) == key(want)
    by = {r.page_id: r for r in got.itertuples()}
    assert (by[5].rule, by[5].verdict) == ("example.org/es/", "block")
    assert (by[6].rule, by[6].verdict) == ("example.org/en/1", "block")
    assert (by[7].host, by[7].path, by[7].verdict) == ("b.com", "/fr/a/b/c/d/e", "allow")
    assert by[12].path == "" and by[12].host == "x.org"
    assert urls.url_verdicts(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_deep_paths_and_similar_branches(spark):
    """Branches are told apart at any depth, and those of about one share are merged, whatever their number."""
    rows = [f"http://a.net/p/q/r/s/t/{c}/{i}" for c in ("good", "fine", "bad", "vile", "new") for i in range(60)]
    rules = [("block", "a.net", f"/p/q/r/s/t/{c}/{i}") for c in ("bad", "vile") for i in range(1, 10)]
    rules += [("allow", "a.net", f"/p/q/r/s/t/{c}/{i}") for c in ("good", "fine") for i in range(1, 10)]
    got = urls.url_verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"), rules).collect()
    free = {(r["path"].split("/")[6], r["template"], r["verdict"]) for r in got if r["rule"] is None}
    assert {(c, v) for c, _, v in free} >= {("good", "allow"), ("fine", "allow"), ("bad", "block"), ("vile", "block")}
    of = {c: t for c, t, _ in free}
    assert of["good"] == of["fine"] != of["bad"] == of["vile"] and of["good"].startswith("a.net/p/q/r/s/t/{")
    long = "http://b.net/" + "/".join(f"s{i}" for i in range(3000))
    assert urls.url_verdicts(spark.createDataFrame([(1, long), (2, long + "x")], "page_id bigint, url string")).count() == 2


def line_truth(rows, tau=2):
    """(doc_id, line_no, class place, n_links, kept) of every line, by comparing all texts."""
    places, seen = [], defaultdict(int)
    for d, text in rows:
        text = text or ""
        seen[d, text] += 1
        places += [((d is not None, d or 0), text, seen[d, text], n, line) for n, line in enumerate(text.split("\n"))]
    texts = sorted({p[4] for p in places if p[4].strip()})
    near = {x: [y for y in texts if y != x and abs(len(x) - len(y)) <= tau and lines._plain(x, y) <= tau] for x in texts}
    label = {x: x for x in texts}
    changed = True
    while changed:
        after = {x: min(label[y] for y in [x, *near[x]]) for x in texts}
        changed, label = after != label, after
    return places, label, near


def test_lines_of_every_length(docs):
    """Lines of 1 to 25 characters, repeated rows, several texts of one document and null ids, against all pairs."""
    rng = random.Random(12)
    every = [rng.choice(["a", "b", "ab", "ba", "é", "xyz", "x z"]) for _ in range(12)]
    for n in range(3, 26):
        x = "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "q"
        every.append(x)
        for _ in range(4):
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(y)) if y else 0
                y[k : k + 1] = rng.choice([[], ["z"], ["z", "q"]])
            every.append("".join(y))
    rng.shuffle(every)
    rows = [(i // 2 if i < 8 else i, "\n".join(every[4 * i : 4 * i + 4])) for i in range(len(every) // 4 + 1)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, rows[1][1]), (None, "menu\n\nmenus"), (500, None), (500, None)]
    places, label, near = line_truth(rows)
    got = lines.line_classes(docs([(d, t, None, None, None) for d, t in rows])).collect()
    want = sorted((str(p[0][1] if p[0][0] else None), p[3], len(near[p[4]]) if p[4].strip() else 0) for p in places)
    assert sorted((str(r["doc_id"]), r["line_no"], r["n_links"]) for r in got) == want
    blank = sum(not p[4].strip() for p in places)
    assert sum(r["kept"] for r in got) == blank + len(set(label.values()))  # one line of every class
    # lines of unique places name the first place of their class
    held = defaultdict(list)
    for p in places:
        if p[4].strip():
            held[label[p[4]]].append(p[0])
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["line_no"]), set()).add((r["class_doc_id"] is not None, r["class_doc_id"] or 0))
    for p in places:
        if p[4].strip() and p[0][0]:
            assert min(held[label[p[4]]]) in by[p[0][1], p[3]]


def test_repeated_rows_keep_one_of_each_line(docs):
    rows = [(1, "one line here\nanother line there", None, None, None)] * 2 + [(None, "no id at all\nno id at all", None, None, None)] * 3
    got = sorted((str(r["doc_id"]), r["line_no"], r["kept"]) for r in lines.line_classes(docs(rows)).collect())
    assert got == [("1", 0, False), ("1", 0, True), ("1", 1, False), ("1", 1, True)] + [("None", 0, False)] * 2 + [("None", 0, True)] + [("None", 1, False)] * 3


def test_short_lines_link(docs):
    """Short lines join as long ones do, and so do lines on either side of 8, 10 and 20 characters."""
    texts = ["Share this page", "Share this page.", "Click to read more", "Click to read more!", "abcdefghij klmnopqr", "abcdefghij klmnopqrst", "12345678", "1234567890", "Menu", "Menus", "xyz", "no"]
    near = [sum(x != y and lines._plain(x, y) <= 2 for y in texts) for x in texts]
    got = {r["doc_id"]: (r["n_links"], r["kept"]) for r in lines.line_classes(docs([(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i][0] for i in range(len(texts))] == near == [1] * 10 + [0] * 2
    assert sorted(i for i in got if got[i][1]) == [0, 2, 4, 6, 8, 10, 11]


def test_parities_against_plain_python():
    rng = random.Random(11)
    rows = ["", "a", "ab", "", "\U0001f600x\ud800", *("".join(rng.choice("ab \U0001f600文") for _ in range(rng.randint(0, 90))) for _ in range(300)), ""]
    want = []
    for row in rows:
        want.append(0)
        for x, y in zip(row, row[1:]):
            want[-1] ^= 1 << ((ord(x) * 0x9E3779B1 + ord(y) * 0x85EBCA77) >> 7 & 63)
    assert lines.parities(rows).tolist() == want
    assert lines.parities([]).tolist() == [] and lines.parities(["", ""]).tolist() == [0, 0]
