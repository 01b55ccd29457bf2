"""Spelling variants against plain Python: random words, odd rows, hot prefixes, long words."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomwright.llm import spelling


def plain_words(rows, least_length=6, least_count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_groups(counts, times=5):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def random_counts(seed, n, letters, longest):
    pick = random.Random(seed)
    found = {}
    while len(found) < n:
        base = "".join(pick.choice(letters) for _ in range(pick.randint(1, longest)))
        for _ in range(3):
            at, c = pick.randint(0, len(base) - 1), pick.choice(letters)
            found[pick.choice([base, base[:at] + c + base[at + 1:], base[:at] + base[at + 1:] or c, base[:at] + c + base[at:]])] = pick.choice([5, 6, 30, 200, 1500])
    return found


@pytest.mark.parametrize("seed, letters, longest, a_row", [(1, "ab", 7, 4096), (2, "abc\u00e9\u00ff", 6, 3), (3, "aab", 12, 8)])
def test_neighbours(spark, monkeypatch, seed, letters, longest, a_row):
    monkeypatch.setattr(spelling, "WORDS_A_ROW", a_row)
    counts = random_counts(seed, 150, letters, longest)
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = [tuple(r) for r in spelling.neighbours(table).collect()]
    want = {frozenset((a, b)) for a in counts for b in counts if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((a, b)) for a, _, b, _ in got} == want
    assert all(counts[a] == n and counts[b] == m for a, n, b, m in got)


def test_groups_of_documents(spark):
    counts = random_counts(5, 60, "abcd\u00e9", 9)
    pick = random.Random(8)
    pool = [w.title() if k % 7 == 0 else w for k, (w, n) in enumerate(counts.items()) for _ in range(min(n, 60))]
    pick.shuffle(pool)
    rows = [(k % 300 if k % 11 else None, " ".join(pool[k * 20:(k + 1) * 20]) + pick.choice([".", "1x", "\n\u00d7\u00f7abcdef"])) for k in range(len(pool) // 20)]
    rows += [(1, None), (2, ""), (3, "short one"), (4, "a" * 5000 + " "), (5, ("b" * 3000 + " ") * 5 + ("b" * 2999 + " ") * 30)]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(4)
    got = sorted(tuple(r) for r in spelling.group(docs).collect())
    assert got == plain_groups(plain_words(rows)) and any(r[1] for r in got)


def test_chain_of_forms_and_empty_table(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(k, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.group(docs).collect()}
    counts = plain_words(rows)
    assert got == {w: (f, r) for w, f, r, *_ in plain_groups(counts)} and got["aaaaaa"][1] == "aabbbb"
    assert spelling.group(docs.limit(0)).collect() == []
