"""Conversation repair against plain Python: all edit sequences of short conversations, whole strings on long ones, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomwright.llm import repair

ROLES, COST = {"s": "system", "u": "user", "a": "assistant"}, {"K": 0, "R": 2, "D": 3, "I": 2}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        out += [] if h == 0 else [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall("[^\\x20\\x09-\\x0d]", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_way(rows, marks, most=2):
    """All (cost, audit, roles) of a short conversation."""
    gaps = [["", *("".join(p) for n in range(1, most + 1) for p in itertools.product("ua", repeat=n))]] * (len(rows) + 1)
    each = []
    for (_, _, role, _), mark in zip(rows, marks):
        ways = [("D", "")]
        if mark not in ("b", "d"):
            ways += [("K", role[:1] or "-"), ("R", "u"), ("R", "a")]
        each.append(ways)
    for ways in itertools.product(*each):
        base = sum(COST[e] for e, _ in ways) + sum(m == "t" and e != "D" for m, (e, _) in zip(marks, ways))
        for extra in itertools.product(*gaps):
            roles = extra[0] + "".join(r + x for (_, r), x in zip(ways, extra[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(extra[0]) + "".join(e + "I" * len(x) for (e, _), x in zip(ways, extra[1:]))
                yield base + 2 * sum(map(len, extra)), audit, roles


def by_strings(rows, marks):
    """Shortest path with whole strings."""
    onward = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def offer(table, state, way):
        table[state] = min(way, table.get(state, way))

    def insert():
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                offer(best, onward[state], (cost + 2, audit + "I"))

    for (_, _, role, _), mark in zip(rows, marks):
        insert()
        after = {}
        for state, (cost, audit) in best.items():
            offer(after, state, (cost + 3, audit + "D"))
            if mark in ("b", "d"):
                continue
            cost += mark == "t"
            offer(after, onward[state], (cost, audit + "K") if role[:1] == onward[state] else (cost + 2, audit + "R"))
            if state == "" and role[:1] == "s":
                offer(after, "s", (cost, audit + "K"))
        best = after
    insert()
    return min(best[s] for s in ("", "a") if s in best)


def rewritten(rows, audit):
    odd = (len(audit) - audit.count("D")) % 2
    left, lines = iter(rows), []
    for e in audit:
        row = next(left) if e != "I" else (None, None, "", "")
        if e != "D":
            lines.append((row[2] if e == "K" else ("user", "assistant")[(len(lines) - odd) % 2]) + ":" + row[3])
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_report(original, damaged):
    out = []
    for conv in dict.fromkeys(r[0] for r in original):
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = plain_faults(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = by_strings(rows, marks) if rows else (0, "")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(marks.count, "bdt"), illegal, cost, audit, rewritten(rows, audit)))
    return sorted(out, key=str)


def random_talk(pick, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", " ", "tool", "usher", ""]
    texts = ["Yes.", "no", " \t\n", "", "What? ", "So!\r\n", "a\u00a0", "Hm\u2026", "One. Two"]
    return [(conv, pick.choice([None, k, k, k, k + 3]), pick.choice(roles), pick.choice(texts) + pick.choice(["", "", f" {k}."])) for k in range(n)]


def code_of(role):
    return "sua".find(role[:1]) if role[:1] in set("sua") else 3


def test_the_search_is_the_best_of_all_ways():
    pick = random.Random(4)
    for n in [0, 1, 1, 2, 2, 3, 3, 3, 3]:
        rows = random_talk(pick, 1, n)
        marks = plain_faults(rows)
        cost, audit, _ = min(every_way(rows, marks))
        assert by_strings(rows, marks) == (cost, audit)


@pytest.mark.parametrize("seed", range(6))
def test_edits_as_nodes_equal_whole_strings(seed):
    pick = random.Random(seed)
    rows = random_talk(pick, 1, pick.choice([5, 40, 400]))
    marks = plain_faults(rows)
    search, whole = repair.Search(), {"b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.TRUNCATED, "": repair.FINE}
    for (_, _, role, _), mark in zip(rows, marks):
        search.row(code_of(role), whole[mark])
    search.insert()
    cost, node = min((search.best[q] for q in repair.ENDS if search.best[q]), key=lambda held: (held[0], search.edits.spell(held[1])))
    assert (cost, search.edits.spell(node)) == by_strings(rows, marks)


def test_comparison_of_edits_also_when_hashes_collide(monkeypatch):
    for prime in (repair.Edits.PRIME, 3):
        monkeypatch.setattr(repair.Edits, "PRIME", prime)
        pick, edits, nodes = random.Random(2), repair.Edits(), [0]
        for _ in range(300):
            nodes.append(edits.push(pick.choice(nodes[-20:]), pick.choice("DIKR")))
        for _ in range(3000):
            a, b = pick.choice(nodes), pick.choice(nodes)
            assert edits.less(a, b) == (edits.spell(a) < edits.spell(b))


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, pos int"


def odd_table():
    pick = random.Random(11)
    rows = [r for conv in range(40) for r in random_talk(pick, conv, pick.randint(1, 14))]
    rows += random_talk(pick, 77, 300) + random_talk(pick, None, 9) + [(90, None, None, None), (91, 0, "user", None), (92, 5, "system", "Only this.")]
    rows += [(93, 1, "user", "word " * 50_000 + "end."), (93, 2, "assistant", "Fine.")] + rows[:30]
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 7])
def test_report(spark, block):
    rows = odd_table()
    talks = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(4)
    damaged = repair.damage(talks)
    assert sorted(map(tuple, damaged.collect()), key=str) == sorted(plain_damage(rows), key=str)
    got = repair.report(talks, damaged, block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(rows, plain_damage(rows))


def test_hot_conversation_is_numbered_in_chunks(spark, small_groups):
    rows = odd_table()[:200]
    talks = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = repair.report(talks, repair.damage(talks), 5)
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(rows, plain_damage(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none, repair.damage(none)).collect() == []
