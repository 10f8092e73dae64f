"""Overlays, nested blocks, chains of records and conditional reachability against plain versions."""

import random
import struct

import pytest

from glyphmill.operators import blocks, graph, intervals, joins
from glyphmill.sources import records

# Overlay of ranges


def painted(rows):
    """Every position is painted by the ranges in the order of what lies below what."""
    out = {}
    for k in {r[0] for r in rows}:
        paint = {}
        for _, lo, hi, priority, name in sorted((r for r in rows if r[0] == k and None not in r[1:3]), key=lambda r: (float("-inf") if r[3] is None else r[3], r[4])):
            paint |= dict.fromkeys(range(lo, hi), name)
        out |= {(k, at): name for at, name in paint.items()}
    return out


def ranges(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lo = rng.randint(-50, 150)
        rows.append((rng.choice(["a", "a", "a", "b", None]), lo, lo + rng.choice([0, -3, 1, 1, 2, 5, 40, 250]), rng.choice([0.0, 1.0, 1.0, 2.5, -1.0, None]), i))
    rows += [("c", 0, 1000, 1.0, 1), ("c", 10, 20, 0.0, 2), ("c", 500, None, 9.0, 3), ("c", None, 5, 9.0, 4), ("d", 5, 5, 1.0, 1), ("e", 0, 5, 1.0, 7), ("e", 5, 9, 1.0, 7), ("e", 0, 9, 0.0, 8)]
    return rows + rows[:40]


@pytest.mark.parametrize("swept, handed", [(1_000_000, 50_000), (20, 3)])
def test_overlay(spark, monkeypatch, swept, handed):
    monkeypatch.setattr(intervals, "SWEPT", swept)  # a key is swept as a whole, or cut into parts
    rows = ranges()
    df = spark.createDataFrame(rows, "k string, lo long, hi long, priority double, name long").repartition(4)
    got = [tuple(r) for r in intervals.overlay(df, "k", "lo", "hi", "priority", "name").collect()]
    want = painted(rows)
    assert {(k, at): name for k, lo, hi, name in got for at in range(lo, hi)} == want
    assert sum(hi - lo for _, lo, hi, _ in got) == len(want)
    # No two pieces of one name touch.
    assert not {(k, hi, name) for k, _, hi, name in got} & {(k, lo, name) for k, lo, _, name in got}


def test_overlay_of_nothing(spark):
    none = spark.createDataFrame([], "k string, lo long, hi long, priority double, name long")
    assert intervals.overlay(none, "k", "lo", "hi", "priority", "name").count() == 0


def test_overlap_keeps_repeated_rows(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (2, 90, 300), (3, 7, 1), (4, 5, 0), (2, 90, 300)], "id long, s long, n long").repartition(3)
    b = spark.createDataFrame([(4, 2), (4, 2), (100, 1), (250, 9)], "s long, n long")
    assert sorted(r["id"] for r in joins.overlapping(a, b, "s", "n", 10).collect()) == [1, 1, 2, 2]


# Nested blocks


def test_logical_lines():
    text = 'label start:  # go\n\n    e "a # b\n    c" at (1,\n  2)  # tail\n\t# only\n\tmenu:\n\t\t"x \\" y":\n    """long\n  [ text"""\nend (\nnever'
    assert list(blocks.logical_lines(text, blocks.Signs())) == [
        (1, 1, 0, "label start:"),
        (3, 5, 4, 'e "a # b c" at (1, 2)'),
        (7, 7, 4, "menu:"),
        (8, 8, 8, '"x \\" y":'),
        (9, 10, 4, '"""long [ text"""'),
        (11, 12, 0, "end ( never"),
    ]


def plain_tree(lines):
    """(line, parent, depth, end) by looking back and ahead from each line; lines are (number, indent)."""
    out, depth = [], {None: -1}
    for i, (no, indent) in enumerate(lines):
        parent = max((b for b, x in lines[:i] if x < indent), default=None)
        depth[no] = depth[parent] + 1
        after = next((k for k in range(i + 1, len(lines)) if lines[k][1] <= indent), len(lines))
        out.append((no, parent, depth[no], lines[after - 1][0]))
    return out


def test_indent_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HANDED", 7)
    rng = random.Random(2)
    texts = ["\n".join(" " * rng.choice([0, 1, 2, 4, 4, 8]) + rng.choice(["say x", "screen y", "", "z"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "   ", "\n".join(" " * k + "deep" for k in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {k: [] for k in range(len(texts))}
    for r in blocks.indent_blocks(df, {"screen"}).collect():
        got[r["doc_id"]].append(r)
    for k, text in enumerate(texts):
        lines = [(i + 1, len(x) - len(x.lstrip())) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        own = sorted(got[k], key=lambda r: r["line_no"])
        assert [(r["line_no"], r["parent"], r["depth"], r["block_end"]) for r in own] == plain_tree(lines)
        skipped = {r["line_no"]: r["line"].startswith("screen") for r in own}
        for r in own:
            skipped[r["line_no"]] |= skipped.get(r["parent"], False)
        assert [r["skipped"] for r in own] == [skipped[r["line_no"]] for r in own]


# Chains of records


def plain_chains(data, prefix, sound):
    """By walking from every place."""
    size = {}
    for at in range(len(data) - prefix.width + 1):
        n = int.from_bytes(data[at : at + prefix.width], prefix.order)
        whole = -(-(prefix.width + n) // prefix.align) * prefix.align
        if prefix.low <= n <= prefix.high and at + whole <= len(data):
            size[at] = whole

    def walk(at):
        out = [at]
        while at + size[at] in size:
            at += size[at]
            out.append(at)
        return out, at + size[at]

    own = {at: walk(at) for at in size}
    good = sorted(at for at, (c, end) in own.items() if len(c) >= sound or end == len(data))
    rows, here = [], 0
    while here < len(data):
        rest = [at for at in good if at >= here]
        if not rest:
            return [*rows, ("skipped", here, len(data) - here)]
        some = [at for at in rest if at < own[rest[0]][1]]
        best = max(some, key=lambda at: (len(own[at][0]), -at))
        if best > here:
            rows.append(("skipped", here, best - here))
        rows += [("record", at, size[at]) for at in own[best][0]]
        here = own[best][1]
    return rows


@pytest.mark.parametrize("prefix", [records.Prefix(), records.Prefix(2, "big", 0, 40, 4), records.Prefix(1, "little", 1, 12)])
def test_record_chains(spark, monkeypatch, prefix):
    monkeypatch.setattr(records, "HANDED", 200)
    rng = random.Random(5)

    def file(damage):
        out, payloads = b"", []
        for i in range(rng.randint(0, 30)):
            body = bytes(rng.randrange(256) for _ in range(rng.randint(1, 12)))
            one = len(body).to_bytes(prefix.width, prefix.order) + body
            out += one + b"\0" * (-len(one) % prefix.align)
            payloads.append(body)
            if rng.random() < damage:
                out += bytes(rng.choice([255, 255, 1, 0, 7]) for _ in range(rng.randint(1, 9)))
        return out, payloads

    files = [file(x) for x in (0, 0, 0.05, 0.2, 0.5) for _ in range(8)] + [(b"", []), (None, []), (b"\xff" * 50, []), (bytes(range(256)), [])]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(files)], "path long, content binary").repartition(3)
    got = {k: [] for k in range(len(files))}
    for r in records.record_chains(df, prefix).collect():
        got[r["path"]].append((r["place"], r["kind"], r["size"], bytes(r["payload"])))
    for k, (data, payloads) in enumerate(files):
        rows = sorted(got[k])
        assert [(kind, place, size) for place, kind, size, _ in rows] == plain_chains(data or b"", prefix, records.SOUND)
        assert sum(r[2] for r in rows) == len(data or b"")
        if k < 16 and prefix.width == 4:
            assert [r[3] for r in rows] == payloads  # nothing is damaged


def test_damage_costs_only_what_it_hit(spark):
    body = [bytes([65 + i]) * (i + 3) for i in range(20)]
    parts = [struct.pack("<I", len(x)) + x for x in body]
    parts[7] = b"\x99\x99\x99\x7f" + parts[7][4:]  # a wrong length
    rows = list(records.chains(b"".join(parts)))
    assert [r[0] for r in rows].count("skipped") == 1 and [r[0] for r in rows].count("record") == 19
    assert next(r for r in rows if r[0] == "skipped")[1:3] == (sum(map(len, parts[:7])), len(parts[7]))


def test_a_place_beside_a_record_hides_none():
    one = lambda n: struct.pack("<I", n) + b"x" * n
    # Behind the damage, the last foreign byte and a length of 1 read as 511: that lands on the longer chain behind the next damage.
    parts = [one(9), b"\xff" * 5, one(1), one(20), one(480), b"\xff" * 5, one(7), one(7), one(7), one(7)]
    assert len(b"".join(parts[2:5])) + len(parts[5]) <= 518
    parts[4] = one(514 - len(parts[2]) - len(parts[3]) - 5 - 4)
    want, here = [], 0
    for x in parts:
        want.append(("skipped" if x[0] == 255 else "record", here, len(x)))
        here += len(x)
    content = b"".join(parts)
    prefix = records.Prefix(high=1 << 24)
    assert [x[:3] for x in records.chains(content, prefix, 1, inner=True)] == want
    assert [x[:3] for x in records.chains(content, prefix, 1)] != want


# Conditions


def plain_reach(nodes, constants, roots):
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def value(x):
        if x is None:
            return None
        return int(x) if x.lstrip("+-").isdigit() else constants.get(x)

    by = {}
    for n in sorted(nodes):
        by.setdefault(n[0], []).append(n)
    reached, missing = set(), set()
    for script, own in by.items():
        labels = {}
        for n in own:
            labels.setdefault(n[3], n[1])
        todo, seen = [next((n[1] for n in own if n[1] >= pos), None) for s, pos in roots if s == script], set()
        place = {n[1]: i for i, n in enumerate(own)}
        while todo:
            pos = todo.pop()
            if pos is None or pos in seen:
                continue
            seen.add(pos)
            _, _, kind, _, target, lhs, op, rhs = own[place[pos]]
            a, b = value(lhs), value(rhs)
            holds = (None if op not in ops or a is None or b is None else ops[op](a, b)) if op is not None else True if lhs is None else None if a is None else a != 0
            if kind in ("jump", "choose") and holds is not False:
                if target in labels and target is not None:
                    todo.append(labels[target])
                else:
                    missing.add((script, pos, target))
            if not (kind in ("jump", "stop") and holds is True):
                todo.append(own[place[pos] + 1][1] if place[pos] + 1 < len(own) else None)
        reached |= {(script, p) for p in seen}
    return reached, missing


def test_conditional_reachability(spark):
    rng = random.Random(7)
    constants = {"A": 1, "B": 0, "C": -5}
    nodes = []
    for script in range(12):
        for pos in range(0, 3 * rng.randint(1, 40), 3):
            lhs = rng.choice([None, "A", "B", "C", "D", "0", "7", "-5", "+1"])
            nodes.append((script, pos, rng.choice(["jump", "choose", "stop", "text", None, "jump"]), rng.choice([None, f"l{rng.randrange(12)}"]), rng.choice([f"l{rng.randrange(14)}", None]), lhs, rng.choice([None, "==", "!=", "<", "<=", ">", ">=", "~"]), rng.choice(["A", "1", "D", None, "-5"])))
    roots = [(s, rng.choice([0, 1, 10, 1000])) for s in range(12)] + [(3, 0), (99, 0)]
    df = spark.createDataFrame(nodes, "script long, pos long, kind string, label string, target string, lhs string, op string, rhs string").repartition(3)
    known = spark.createDataFrame([*constants.items(), ("D", 1), ("D", 2), ("E", None)], "name string, value long")  # D is told twice, so it isn't known
    reached, missing = graph.reachable_if(df, known, spark.createDataFrame(roots, "script long, pos long"))
    want = plain_reach(nodes, constants, roots)
    assert sorted(tuple(r) for r in reached.collect()) == sorted(want[0])
    key = lambda r: (r[0], r[1], r[2] or "")
    assert sorted((tuple(r) for r in missing.collect()), key=key) == sorted(want[1], key=key)
    assert 0 < len(want[0]) < len(nodes) and want[1]
