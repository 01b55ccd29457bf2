"""Secret scan: fixed patterns, and high-entropy spans by a sliding window, in DataFrame expressions only.

Base spans are the leftmost non-overlapping matches of each kind; ``assign`` needs six characters in its value.
Entropy spans: within every maximal run of a character class, a window of fixed width slides by one character; the
number of each character in the window is kept and changed by the one that enters and the one that leaves, and with it
the sum of c*log2(c) over the counts c (as whole numbers, so that order never matters). Windows above the class's
entropy are joined where they overlap or touch. The allow list then drops joined spans that are no secrets.

NULL and empty texts have no spans. Offsets are code points, the end exclusive. Columns of the input whose names are
those of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that must be exactly these (fixed values).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex"]
VALUE_AT_LEAST = 6
#: Elements or windows that a step over an array takes at a time.
BLOCK = 256


@dataclass(frozen=True)
class CharClass:
    """A character class, its window and the least entropy (bits a character) of a window that counts."""

    name: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + self.alphabet.replace("-", "\\-") + "]{" + str(self.window) + ",}"

    @property
    def costs(self) -> list[int]:
        """Millionths of c*log2(c) for each count c."""
        return [round(1e6 * c * log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """Largest sum of costs that a window may have."""
        return round(1e6 * self.window * (log2(self.window) - self.bits))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "ABCDEF", 24, 3.0),
    CharClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_-", 24, 4.0),
)
#: A span is no secret if it matches one of these: no digit, no letter, a row of hyphens or underscores, a placeholder.
ALLOW = ("^[^0-9]*$", "^[^A-Za-z]*$", "[-_=]{6,}", "(?i)example|placeholder|changeme|lorem|xxxx")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefixes(values: Column, first: int, fold) -> Column:
    """What ``fold`` makes of ``first`` and all elements before each, in blocks, so that the work is nearly linear."""
    start = F.lit(first).cast("long")

    def running(part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, v: F.concat(acc, F.array(fold(F.element_at(acc, -1), v))))

    def cut_up(values: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.size(values) / BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))

    def put_together(blocks: Column) -> Column:
        before = running(F.transform(blocks, lambda b: F.aggregate(b, start, fold)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, base: F.transform(
            F.slice(running(b), F.lit(1), F.size(b)), lambda v: fold(v, base))))

    return let(let(values, cut_up), put_together)


def prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each."""
    return _prefixes(lengths, 0, lambda a, v: a + v)


def prefix_max(values: Column) -> Column:
    """Largest of all elements before each, -1 if there are none."""
    return _prefixes(values, -1, lambda a, v: F.greatest(a, v))


def match_starts(text: Column, pattern: str, found: Column) -> Column:
    """Start of every match: what lies between the matches and the matches themselves, added up."""
    gaps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("match")))
    return let(gaps, lambda gaps: F.zip_with(prefix_sums(F.transform(gaps, lambda g: g["gap"] + g["match"])), gaps, lambda b, g: b + g["gap"]))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


SPAN = "array<struct<at:bigint,rank:int,until:bigint,kind:string>>"


def _span(at: Column, rank: int, until: Column, kind: str) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(rank).alias("rank"), until.cast("long").alias("until"), F.lit(kind).alias("kind"))


def pattern_spans(text: Column, pattern: str, rank: int, kind: str, value: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = match_starts(text, pattern, found)
    spans = F.zip_with(starts, found, lambda s, m: _span(s, rank, s + F.length(m), kind))
    if value:
        long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), lambda v: F.length(v) >= VALUE_AT_LEAST)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("span"), long_enough.alias("ok")), lambda z: z["ok"]), lambda z: z["span"])
    return F.when(text.rlike(pattern), spans).otherwise(_none(SPAN))


def chunks(run: Column, size: int) -> Column:
    return F.regexp_extract_all(run, F.lit("(?s).{1,%d}" % size), F.lit(0))


def window_sums(run: Column, cls: CharClass) -> Column:
    """Sum of costs of every window of a run, each from the counts of the one before.

    The run is cut into blocks of ``BLOCK`` windows, each with the characters that the next block begins with, so that
    the work is linear in its length. Counts are packed into a few whole numbers.
    """
    def with_next(blocks: Column) -> Column:
        after = F.concat(F.slice(blocks, F.lit(2), F.size(blocks)), F.array(F.lit("")))
        return F.zip_with(blocks, after, lambda b, a: F.concat(b, F.substring(a, F.lit(1), F.lit(cls.window - 1))))

    return F.flatten(F.transform(let(chunks(run, BLOCK), with_next), lambda piece: _block_sums(piece, cls)))


def _block_sums(piece: Column, cls: CharClass) -> Column:
    costs = F.array(*[F.lit(c).cast("long") for c in cls.costs])
    width, bits = cls.window, cls.window.bit_length()
    per = 63 // bits
    words = -(-len(cls.alphabet) // per)

    def count(counts: Column, place: Column) -> Column:
        word = F.element_at(counts, F.floor((place - 1) / per).cast("int") + 1)
        return F.call_function("shiftright", word, F.pmod(place - 1, F.lit(per)) * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def changed(counts: Column, place: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), F.pmod(place - 1, F.lit(per)) * bits)
        at = F.floor((place - 1) / per)
        return F.transform(counts, lambda c, k: F.when(k == at, c + one).otherwise(c))

    def state(counts: Column, total: Column, sums: Column) -> Column:
        return F.struct(counts.alias("counts"), total.cast("long").alias("total"), sums.alias("sums"))

    def moved(s: Column, place: Column, by: int) -> Column:
        had = count(s["counts"], place)
        total = s["total"] + F.element_at(costs, had + 1 + by) - F.element_at(costs, had + 1)
        return state(changed(s["counts"], place, by), total, s["sums"])

    def step(s: Column, move: Column) -> Column:
        # one-element arrays hold what the step before made, so that it is computed once
        left = F.transform(F.array(s), lambda x: F.when(move["out"] > 0, moved(x, F.greatest(move["out"], F.lit(1)), -1)).otherwise(x))
        full = F.transform(left, lambda x: moved(x, move["into"], 1))
        return F.element_at(F.transform(full, lambda x: state(x["counts"], x["total"], F.when(
            move["last"], F.concat(x["sums"], F.array(x["total"]))).otherwise(x["sums"]))), 1)

    def moves(codes: Column) -> Column:
        out = F.slice(F.concat(F.array_repeat(F.lit(0), width), codes), F.lit(1), F.size(codes))
        return F.transform(F.arrays_zip(codes.alias("into"), out.alias("out")), lambda z, k: F.struct(
            z["into"].alias("into"), z["out"].alias("out"), (k + 1 >= width).alias("last")))

    codes = F.filter(F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(cls.alphabet), c)), lambda c: c > 0)
    start = state(F.array_repeat(F.lit(0).cast("long"), words), F.lit(0).cast("long"), _none("array<bigint>"))
    return F.aggregate(let(codes, moves), start, step, lambda s: s["sums"])


def dense_spans(run: Column, cls: CharClass) -> Column:
    """Joined windows of a run whose entropy is high: array of (at, until) within the run."""
    high = F.filter(
        F.transform(window_sums(run, cls), lambda s, k: F.struct(k.cast("long").alias("at"), s.alias("sum"))),
        lambda w: w["sum"] <= cls.most)
    return merged(F.transform(high, lambda w: F.struct(w["at"].alias("at"), (w["at"] + cls.window).alias("until"))))


def entropy_spans(text: Column, cls: CharClass, rank: int) -> Column:
    runs = F.regexp_extract_all(text, F.lit(cls.pattern), F.lit(0))
    starts = match_starts(text, cls.pattern, runs)

    def of_run(z: Column) -> Column:
        kept = F.filter(dense_spans(z["run"], cls), lambda d: ~_allowed(F.substring(z["run"], (d["at"] + 1).cast("int"), (d["until"] - d["at"]).cast("int"))))
        return F.transform(kept, lambda d: _span(z["start"] + d["at"], rank, z["start"] + d["until"], cls.name))

    spans = F.flatten(F.transform(F.arrays_zip(runs.alias("run"), starts.alias("start")), of_run))
    return F.when(text.rlike(cls.pattern), spans).otherwise(_none(SPAN))


def _allowed(found: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | found.rlike(pattern)
    return out


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """All columns, ``base_spans`` and ``all_spans``: arrays of (at, rank, until, kind) by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.array_sort(F.concat(
        pattern_spans(body, ASSIGN, 0, KINDS[0], value=2), pattern_spans(body, ACCESS, 1, KINDS[1]), pattern_spans(body, HEX, 2, KINDS[2])))
    more = [entropy_spans(body, c, len(KINDS) + k) for k, c in enumerate(classes)]
    kept = [c for c in docs.columns if c not in ("base_spans", "all_spans", "__more")]
    first = docs.select(*kept, plain.alias("base_spans"), F.concat(*more).alias("__more") if more else _none(SPAN).alias("__more"))
    return first.select(*kept, "base_spans", F.array_sort(F.concat("base_spans", "__more")).alias("all_spans"))


def merged(spans: Column) -> Column:
    """Spans by start, overlapping or touching ones joined: array of (at, until). A span begins a new one if all before
    it have ended; how far they reach is a running maximum, taken in blocks like sums."""
    def joined(spans: Column) -> Column:
        untils = F.transform(spans, lambda s: s["until"])
        heads = F.filter(F.zip_with(spans, prefix_max(untils), lambda s, r: F.struct(s["at"].alias("at"), r.alias("before"))), lambda h: h["before"] < h["at"])
        return let(heads, lambda heads: F.zip_with(
            heads, F.concat(F.slice(F.transform(heads, lambda h: h["before"]), F.lit(2), F.size(heads)), F.array(F.array_max(untils))),
            lambda h, e: F.struct(h["at"].alias("at"), e.alias("until"))))

    none = _none("array<struct<at:bigint,until:bigint>>")
    return let(spans, lambda s: F.when(F.size(s) > 0, joined(s)).otherwise(none))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows with every span of ``all_spans`` replaced by ``mark``."""
    joined = merged(F.col("all_spans"))
    body = F.col(text)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(joined, lambda s: s["until"]))
    starts = F.concat(F.transform(joined, lambda s: s["at"]), F.array(F.length(body).cast("long")))
    clean = F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(body, (e + 1).cast("int"), (s - e).cast("int"))), mark)
    return scanned.withColumn(text, F.when(F.size("all_spans") > 0, clean).otherwise(body))
