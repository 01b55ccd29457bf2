"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate, as an audit string.

Rows of a conversation stand by turn (NULL first, then role, text). Each row is kept (0), gets another role (2) or is
deleted (3; a must for blank rows and for repetitions of an earlier role and text); rows with role user or assistant and
no text are inserted (2); an undeleted row that breaks off costs 1 more. The first letters of the roles that are left
spell ``(s?(ua)+)?``. Of the cheapest ways the one whose edits, K R D I in order, are least in ASCII order is taken.

The search is a shortest path over the rows and four states of the pattern. Its edit strings are persistent: a node is an
edit and a link to what stands before, with jumps to the ancestors 2^k steps back and a rolling hash of the whole string,
so that equally dear strings share their beginnings and are compared by a search for their longest common prefix. Equal
hashes are verified along the links, as far as the two strings are kept apart.

Rows are numbered by the library's ordered scan and packed into blocks of ``BLOCK`` rows; every block is solved on its own
for each state it may be entered in, and a conversation's blocks are put together in order. What is common to the strings
of all states is set aside meanwhile, so that little is copied. Each task holds a block, or the edits of one conversation
(as long as the audit it returns); texts only stream through. The hash of a repaired conversation is one SHA-256 over its
texts in order, so its rows pass one task, one after the other, whatever their number.

NULL roles and texts are one space, a NULL conversation is one of its own; a NULL or other role fits no place and is
replaced or deleted; repeated rows are repetitions, texts of any length are whole, other columns play no part. Without any
rows a conversation has zeros, no audit and the hash of nothing. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.words import slices
from loomwright.plans.scan import row_numbers
from loomwright.plans.store import cut

WHITE = " \t\n\x0b\x0c\r"
DAMAGE_OF = 20
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, BROKEN_COST = 2, 3, 2, 1
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row. The pattern may end at ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a user or assistant row leads from each state, and the kinds of rows: system, user, assistant, any other.
ONWARD = (USER, USER, ASSISTANT, USER)
KINDS = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with repeatable faults, by the hash of conversation and turn: rows are dropped, emptied,
    robbed of their full stops, repeated or given to the user."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = (F.crc32(key.cast("binary")) % DAMAGE_OF).alias("fault")
    each = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return each.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn, role, text) as a written table."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return cut(row_numbers(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], order, "pos", by=[F.col(c) for c in ("turn", "role", "text")]))


def _same(a: DataFrame, b: DataFrame, *names: str) -> tuple[DataFrame, Column]:
    """``b`` with its key columns renamed, and the NULL-safe condition on them."""
    on = None
    for name in names:
        b = b.withColumnRenamed(name, f"__{name}")
        each = a[name].eqNullSafe(b[f"__{name}"])
        on = each if on is None else on & each
    return b, on


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, kind, fault) of ordered rows: the first fault that a row has."""
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    bare = F.rtrim("text", F.lit(WHITE))
    kind = F.coalesce(F.nullif(F.instr(F.lit(KINDS), F.left("role", F.lit(1))), F.lit(0)), F.lit(len(KINDS) + 1)) - 1
    kind = F.when(F.col("role") == "", len(KINDS)).otherwise(kind)
    light = rows.select("conv_id", "pos", content.alias("content"), kind.alias("kind"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("closed"))
    first = light.groupBy("conv_id", "content").agg(F.min("pos").alias("first"))
    first, on = _same(light, first, "conv_id", "content")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("closed"), FINE).otherwise(TRUNCATED)
    return light.join(first, on).select("conv_id", "pos", "kind", fault.alias("fault"))


class Edits:
    """Edit strings as nodes of a growing tree; node 0 is the empty string."""

    BASE, PRIME = 911382323, (1 << 61) - 1

    def __init__(self):
        self.letter, self.length, self.hash, self.up = [""], [0], [0], [[]]

    def push(self, node: int, letter: str) -> int:
        up = [node]
        while len(further := self.up[up[-1]]) >= len(up):
            up.append(further[len(up) - 1])
        self.letter.append(letter)
        self.length.append(self.length[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.PRIME)
        self.up.append(up)
        return len(self.letter) - 1

    def spell(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lift(self, node: int, length: int) -> int:
        while (over := self.length[node] - length) > 0:
            node = self.up[node][over.bit_length() - 1]
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two strings of one length and one hash are the same letter by letter."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """String a before string b in ASCII order."""
        short = min(self.length[a], self.length[b])
        x, y = self._lift(a, short), self._lift(b, short)
        if self.hash[x] == self.hash[y]:
            return self.length[a] < self.length[b] if self._equal(x, y) else self.spell(a) < self.spell(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self._equal(self.up[x][0], self.up[y][0]):
            return self.spell(a) < self.spell(b)
        return self.letter[x] < self.letter[y]


class Search:
    """Best (cost, edits) of each state, row by row."""

    def __init__(self, entry: int = START):
        self.edits = Edits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[entry] = (0, 0)

    def _offer(self, best: list, state: int, cost: int, before: int, letter: str) -> bool:
        held = best[state]
        if held and held[0] < cost:
            return False
        node = self.edits.push(before, letter)
        if held and held[0] == cost and not self.edits.less(node, held[1]):
            return False
        best[state] = (cost, node)
        return True

    def insert(self) -> None:
        changed = True
        while changed:
            changed = False
            for state, held in enumerate(self.best):
                if held:
                    changed |= self._offer(self.best, ONWARD[state], held[0] + INSERT_COST, held[1], INSERT)

    def row(self, kind: int, fault: int) -> None:
        self.insert()
        after: list[tuple[int, int] | None] = [None] * 4
        for state, held in enumerate(self.best):
            if not held:
                continue
            cost, node = held
            self._offer(after, state, cost + DELETE_COST, node, DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            cost += BROKEN_COST if fault == TRUNCATED else 0
            onward = ONWARD[state]
            if kind == onward - 1:
                self._offer(after, onward, cost, node, KEEP)
            else:
                self._offer(after, onward, cost + REROLE_COST, node, REROLE)
                if kind == 0 and state == START:
                    self._offer(after, SYSTEM, cost, node, KEEP)
        self.best = after


_BLOCKS = "conv_id bigint, block bigint, counts array<bigint>, ends array<int>, costs array<bigint>, audits array<string>"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def solved(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: counts (blank, duplicate, truncated, illegal pairs inside), kinds at its ends, and the best way from
    each state (outer) to each state (inner)."""
    number = F.floor((F.col("pos") - 1) / block).alias("block")
    packed = rows.groupBy("conv_id", number).agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("fault") * 4 + F.col("kind")).cast("int").alias("code")))).alias("r"))

    def run(batches):
        for batch in slices(batches, 64):
            out = []
            for conv, at, codes in zip(*[c.to_pylist() for c in batch.columns]):
                kinds, marks = [c % 4 for c in codes], [c // 4 for c in codes]
                illegal = sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:]))
                costs, audits = [None] * 16, [None] * 16
                for entry in range(4) if at else [START]:
                    search = Search(entry)
                    for kind, mark in zip(kinds, marks):
                        search.row(kind, mark)
                    for state, held in enumerate(search.best):
                        if held:
                            costs[entry * 4 + state], audits[entry * 4 + state] = held[0], search.edits.spell(held[1])
                out.append((conv, at, [marks.count(BLANK), marks.count(DUPLICATE), marks.count(TRUNCATED), illegal], [kinds[0], kinds[-1]], costs, audits))
            if out:
                yield _batch(out, ["conv_id", "block", "counts", "ends", "costs", "audits"], [
                    pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())])

    return packed.select("conv_id", "block", F.transform("r", lambda x: x["code"]).alias("codes")).mapInArrow(run, _BLOCKS)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Joined:
    """The blocks of one conversation put together: of each state the cost and the edits behind what all states share."""

    def __init__(self):
        self.shared: list[str] = []
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.counts, self.last = np.zeros(4, np.int64), None

    def add(self, counts: list[int], ends: list[int], costs: list, audits: list) -> None:
        self.counts += counts
        if self.last is not None:
            self.counts[3] += (self.last, ends[0]) not in _LEGAL
        self.last = ends[1]
        after: list[tuple[int, str] | None] = [None] * 4
        for state in range(4):
            ways = [(held[0] + costs[q * 4 + state], held[1] + audits[q * 4 + state]) for q, held in enumerate(self.best) if held and costs[q * 4 + state] is not None]
            after[state] = min(ways, default=None)
        texts = [held[1] for held in after if held]
        low, high = min(texts), max(texts)
        n = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
        self.shared.append(low[:n])
        self.best = [held and (held[0], held[1][n:]) for held in after]

    def result(self) -> tuple[int, str]:
        """Cost and audit, after what is inserted at the end."""
        best = list(self.best)
        for _ in range(len(best)):
            for state, held in enumerate(best):
                if held:
                    way = (held[0] + INSERT_COST, held[1] + INSERT)
                    best[ONWARD[state]] = min(way, best[ONWARD[state]] or way)
        cost, audit = min(best[state] for state in ENDS if best[state])
        return cost, "".join(self.shared) + audit


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of rows (conv_id, pos, kind, fault)."""
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        def finished():
            return (conv, *held.counts.tolist(), *held.result())

        conv, held = None, None
        for batch in slices(batches, 64):
            out = []
            for name, _, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or name != conv:
                    if held is not None:
                        out.append(finished())
                    conv, held = name, Joined()
                held.add(*rest)
            if out:
                yield _batch(out, names, [pa.int64()] * 6 + [pa.string()])
        if held is not None:
            yield _batch([finished()], names, [pa.int64()] * 6 + [pa.string()])

    parted = solved(rows, block).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return parted.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'audit' else 'bigint'}" for n in names))


class Lines:
    """The lines of a repaired conversation, ``role:text``, as its rows come by in order."""

    ROLES = ("user", "assistant")

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.odd = (len(audit) - audit.count(DELETE)) % 2  # an odd number of rows starts with the system's

    def _line(self, role: str | None, text: str) -> str:
        role = self.ROLES[(self.out - self.odd) % 2] if role is None else role
        self.out += 1
        return f"{role}:{text}"

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._line(None, "")

    def of(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            yield self._line(role if edit == KEEP else None, text)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, line): the repaired conversations' lines, numbered from 1; ``rows`` ordered, ``found`` with audits."""

    def run(batches):
        conv, lines, n = None, None, 0
        for batch in slices(batches):
            out = []
            for name, pos, role, text, audit in zip(*[c.to_pylist() for c in batch.columns]):
                if pos == 0:
                    if lines:
                        out += [(conv, n := n + 1, x) for x in lines.inserted()]
                    conv, lines, n = name, Lines(audit), 0
                    continue
                out += [(conv, n := n + 1, x) for x in lines.of(role, text)]
            if out:
                yield _batch(out, ["conv_id", "pos", "line"], [pa.int64(), pa.int64(), pa.string()])
        if lines and (out := [(conv, n := n + 1, x) for x in lines.inserted()]):
            yield _batch(out, ["conv_id", "pos", "line"], [pa.int64(), pa.int64(), pa.string()])

    return _rows_behind_audits(rows, found).mapInArrow(run, "conv_id bigint, pos bigint, line string")


def _rows_behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(0).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit")
    both = heads.unionByName(rows.select("conv_id", "pos", "role", "text", none.alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of lines that come in order within their partitions, as ``repaired`` gives them."""

    def run(batches):
        conv, held = None, None
        for batch in slices(batches):
            out = []
            for name, pos, line in zip(*[c.to_pylist() for c in batch.columns]):
                if pos == 1:
                    if held:
                        out.append((conv, held.hexdigest()))
                    conv, held = name, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(line.encode())
            if out:
                yield _batch(out, ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])
        if held:
            yield _batch([(conv, held.hexdigest())], ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])

    return lines.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def report(original: DataFrame, damaged: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``original``: what is wrong with its rows in ``damaged``, the edits and the repaired hash."""
    rows = ordered(damaged)
    found = cut(audits(faults(rows), block))
    hashes = digests(repaired(rows, found))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    out = original.select("conv_id").distinct()
    for more in (turns, found, hashes):
        more, on = _same(out, more, "conv_id")
        out = out.join(more, on, "left").drop("__conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
