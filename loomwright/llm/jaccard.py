"""N-gram Jaccard join: which documents share at least 80% of their word shingles.

Documents and shingles form a sparse 0/1 matrix; overlaps are entries of the product with its own transpose. The product
is taken in blocks, and pairs whose sizes rule them out are discarded as early as possible:

1. Rows with equal shingle sets are one class (by a 128-bit digest). Copies need no pair.
2. Columns are ordered alike in all rows: shingles in few documents first, very common ones last, then by hash. With
   sizes a and b a pair needs ceil(4(a+b)/9) common shingles, so it has one among the first a - ceil(4a/5) + 1 of either
   row: only these columns are multiplied at first. From the place of that common shingle follows how many more there
   can be (position bound), and sizes differ by a quarter at most (size bound). Each block of columns is one task's.
3. Classes that pass are joined in rounds: each takes one candidate of another group, its overlap is counted in full, and
   links join groups. What is left are pairs of different groups; a parity sketch of each row (its bits are parities, so
   a bit that differs is a shingle that differs) discards most, and the rest is counted in full.

Groups decide which pairs are still of interest, so that a large group of near copies needs no pair of its own members;
no link between two groups is lost. Shingle hashes have 64 bits.

Texts without words (NULL, empty) have no shingles and link with nothing; with fewer words than a shingle, the whole
sequence is one. Rows with NULL doc_id have no component, but documents that link over one are linked. Rows that share an id and a text are equal rows.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import SCHEMA, Dealer, batch_of, brought_together, from_planes, gathered, part_of, parts_for, starts_of
from loomwright.llm.graph import components
from loomwright.llm.words import Rolling, WordHashes, shingle_set, slices
from loomwright.plans.store import cut, fresh_path, release

SHINGLE, ROUNDS = 5, 2
#: The most common shingles, ``MOST_COMMON`` at most, go last; rows of a token that are compared without blocks.
MOST_COMMON, SMALL = 1 << 20, 64
#: Bits of a parity sketch, and rows of a column that are compared at a time.
SKETCH_BITS, BLOCK = 2048, 512
#: Bits, as powers of two, of the map of wanted rows (8 MB at every size of the input) and of each of its pieces (4 KB).
MAP_BITS, PIECE_BITS = 26, 15


def needed(a: Column, b: Column) -> Column:
    """Least overlap of a link: 100 * overlap >= 80 * union, in whole numbers."""
    return F.ceil((a + b) * 4 / F.lit(9.0)).cast("int")


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def _sets(batches, shingle: int):
    """(row values without the text, shingle set) of all rows; the text is the last column."""
    hashes, rolling = WordHashes(), Rolling()
    for batch in slices(batches):
        for *keys, body in zip(*[c.to_pylist() for c in batch.columns]):
            yield keys, shingle_set(hashes.of(body.lower().split() if body else []), shingle, rolling)


HEAD = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("code", pa.int64()), ("documents", pa.int64())]
TOKEN = [("token", pa.int64()), ("class", pa.binary()), ("n", pa.int32()), ("at", pa.int32())]
SET = [("class", pa.binary()), ("n", pa.int32()), ("shingles", pa.binary()), ("sketch", pa.binary())]


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _heads_and_counts(docs: DataFrame, text: str, parts: int, shingle: int) -> DataFrame:
    """Two kinds of rows from one pass over all texts: (doc_id, n_shingles, class) of every document, and the codes
    (part and lower 32 bits) of shingles that are in more than two documents, with their number."""

    def deal(batches):
        dealer, heads, turn = Dealer(parts, "<u4"), [], 0

        def counted():
            nonlocal heads, turn
            if dealer.held:
                hashes, number = np.unique(np.concatenate(dealer.hashes), return_counts=True)
                dealer.clear()
                dealer.add(hashes, number.astype(np.int32), (0,))
                yield from dealer.flush()
            if heads:
                doc, n, name = zip(*heads)
                known = np.array([d is not None for d in doc])
                yield batch_of([(turn % parts, b"", np.array([d or 0 for d in doc], "<i8").tobytes() + known.tobytes(), np.array(n, "<i8").tobytes(), b"".join(name))])
                heads, turn = [], turn + 1

        for (doc,), s in _sets(batches, shingle):
            heads.append((doc, len(s), _fingerprint(s)))
            if dealer.add(s, s, (0,)):
                yield from counted()
        yield from counted()

    def often(batches):
        last, held = None, []

        def found():
            hashes = np.concatenate([np.frombuffer(m[0], "<u4") for m in held])
            number = np.concatenate([from_planes(m[1]) for m in held])
            order = np.argsort(hashes, kind="stable")
            hashes, number = hashes[order], number[order]
            begin = starts_of(hashes)
            documents = np.add.reduceat(number.astype(np.int64), begin)
            many = documents > 2
            codes = pa.array(hashes[begin][many].astype(np.int64) | np.int64(last) << 32)
            none = [pa.nulls(len(codes), k) for _, k in HEAD[:3]]
            return pa.RecordBatch.from_arrays([*none, codes, pa.array(documents[many])], [n for n, _ in HEAD])

        for batch in batches:
            for part, hashes, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if not hashes:
                    doc, n, name = rest[0], np.frombuffer(rest[1], "<i8").tolist(), rest[2]
                    ids, known = np.frombuffer(doc[:8 * len(n)], "<i8").tolist(), doc[8 * len(n):]
                    yield _batch([(i if k else None, m, name[16 * r:16 * r + 16] if m else None, None, None) for r, (i, k, m) in enumerate(zip(ids, known, n))], HEAD)
                    continue
                if part != last and held:
                    yield found()
                    held = []
                last = part
                held.append((hashes, *rest))
        if held:
            yield found()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return brought_together(source.mapInArrow(deal, SCHEMA), parts).mapInArrow(often, "doc_id bigint, n_shingles bigint, class binary, code bigint, documents bigint")


def _common(counts: DataFrame) -> np.ndarray:
    """Sorted codes of the shingles in most documents: above the least power of two that leaves ``MOST_COMMON`` at most."""
    limits = [2**k for k in range(1, 63)]
    row = counts.agg(*[F.count(F.when(F.col("documents") > n, 1)).alias(str(n)) for n in limits]).first()
    limit = next(n for n in limits if row[str(n)] <= MOST_COMMON)
    return np.sort(counts.filter(F.col("documents") > limit).select("code").toArrow().column(0).to_numpy())


def _leading(s: np.ndarray, parts: int, common: np.ndarray) -> np.ndarray:
    """The first columns of a row in the order of all rows: the common ones last, each half by hash."""
    want = prefix_size(len(s))
    if not len(common):
        return s[:want]
    for upto in sorted({min(len(s), 2 * want), len(s)}):
        some = s[:upto]
        code = part_of(some, parts).astype(np.int64) << 32 | (some & np.uint64(0xFFFFFFFF)).astype(np.int64)
        last = common[np.minimum(np.searchsorted(common, code), len(common) - 1)] == code
        rare = some[~last]
        if len(rare) >= want:
            return rare[:want]
    return np.concatenate([rare, some[last]])[:want]


def _tokens(docs: DataFrame, text: str, parts: int, shingle: int, common: np.ndarray) -> DataFrame:
    """(token, class, n, at): leading columns of rows of different classes that share them."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def deal(batches):
        dealer = Dealer(parts, "<u8", width=3)
        for _, s in _sets(batches, shingle):
            if len(s):
                lead = _leading(s, parts, shared.value)
                a, b = np.frombuffer(_fingerprint(s), "<i8").tolist()
                if dealer.add(lead, np.arange(len(lead), dtype=np.int32), (a, b, len(s))):
                    yield from dealer.flush()
        yield from dealer.flush()

    def several(batches):
        for hashes, at, owners in gathered(batches, "<u8", width=3):
            order = np.lexsort((owners[:, 1], owners[:, 0], hashes))
            hashes, at, owners = hashes[order], at[order], owners[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:, :2] != owners[:-1, :2]).any(axis=1)
            hashes, at, owners = hashes[fresh], at[fresh], owners[fresh]
            keep = np.flatnonzero(_with_partner(hashes, owners[:, 2], at))
            for i in range(0, len(keep), 1 << 16):
                k = keep[i:i + (1 << 16)]
                raw = np.ascontiguousarray(owners[k, :2], "<i8")
                name = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[k].view(np.int64)), name, pa.array(owners[k, 2].astype(np.int32)), pa.array(at[k])], [n for n, _ in TOKEN])

    source = docs.select(F.col(text).cast("binary").alias("body"))
    return brought_together(source.mapInArrow(deal, SCHEMA), parts).mapInArrow(several, "token bigint, class binary, n int, at int")


def _with_partner(tokens: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that the size and position bounds let link with another row of their token; all rows of very common tokens."""
    begin = starts_of(tokens)
    size = np.diff(np.concatenate([begin, [len(tokens)]]))
    size = np.repeat(size, size)
    has = size > SMALL
    left = n - at
    for step in range(1, SMALL):
        i = np.flatnonzero(tokens[step:] == tokens[:-step]) if len(tokens) > step else np.empty(0, np.int64)
        i = i[size[i] <= SMALL]
        if not len(i):
            break
        j = i + step
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (5 * small >= 4 * large) & (np.minimum(left[i], left[j]) >= -(-4 * (small + large) // 9))
        has[i[ok]] = has[j[ok]] = True
    return has


def _may_link(x: str, y: str) -> Column:
    """Size bound and position bound of two rows at a shared column, taken as their first."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (1 + F.least(n - 1 - i, m - 1 - j) >= needed(n, m))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each bit."""
    bits = np.bincount((s >> np.uint64(7)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _perhaps_wanted(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` whose doc_id falls on a bit of the wanted ones. The map keeps its size, so that it can be broadcast
    whatever the input; where it fills up, more rows pass and the exact join after it has more to do."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    piece, spot = F.shiftright(bit, PIECE_BITS).cast("int"), bit.bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    marks = wanted.select(piece.alias("piece"), spot.alias("spot")).repartition("piece")
    pieces = marks.groupBy("piece").agg(F.bitmap_construct_agg("spot").alias("bits"))
    octet = F.conv(F.hex(F.substring(F.col("bits"), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tried = source.withColumn("piece", piece).join(F.broadcast(pieces), "piece")
    return tried.filter(F.getbit(octet, (spot % 8).cast("int")) == 1).drop("piece", "bits")


def _rows_of(docs: DataFrame, text: str, shingle: int, wanted: DataFrame, parts: int) -> DataFrame:
    """(class, n, shingles, sketch) of the wanted (doc_id, class), once a class. Texts that may be wanted are named by their
    own class and move once, to its task; their sets, which are several times as large, don't move."""

    def named(batches):
        hashes, rolling = WordHashes(), Rolling()
        for batch in slices(batches):
            sets = (shingle_set(hashes.of(body.lower().split() if body else []), shingle, rolling) for body in batch.column(0).to_pylist())
            names = pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([names, batch.column(0)], ["class", "body"])

    def run(batches):
        hashes, rolling, rows, held, seen = WordHashes(), Rolling(), [], 0, set()
        for batch in slices(batches):
            for name, body in zip(*[c.to_pylist() for c in batch.columns]):
                if name in seen:
                    continue
                seen.add(name)
                s = shingle_set(hashes.of(body.lower().split()), shingle, rolling)
                rows.append((name, len(s), s.astype("<u8").tobytes(), sketch(s)))
                held += len(s)
                if held > 1 << 19:
                    yield _batch(rows, SET)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, SET)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    some = _perhaps_wanted(source.filter("doc_id is not null"), wanted.filter("doc_id is not null")).select("body")
    if not wanted.filter("doc_id is null").isEmpty():  # classes that only rows without an id have
        some = some.unionByName(source.filter("doc_id is null").select("body"))
    some = some.mapInArrow(named, "class binary, body binary")
    # an inner join, as a class is wanted once: a semi join would be moved below the repartition and shuffle the texts again
    exact = some.filter("class is not null").repartition(parts, "class").join(wanted.select("class"), "class")
    return exact.select("class", "body").mapInArrow(run, "class binary, n int, shingles binary, sketch binary")


@contextmanager
def _by_class(rows: DataFrame, parts: int):
    """The rows in a table in buckets by class: joins by class then move the pairs, not the sets."""
    spark, name = rows.sparkSession, f"loomwright_rows_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, "class").sortBy("class").option("path", fresh_path(spark, "rows")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def _close(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that differ in no more bits of their sketches than a link may have shingles apart."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(n), -1) for k in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= n // 9))

    one = rows.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    two = rows.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a binary, b binary")


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlap, counted in full, makes a link."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    both = int((t[place] == s).sum())
                    keep.append(100 * both >= 80 * (len(s) + len(t) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = rows.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    two = rows.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _grouped(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens with the group of each class, where their classes are of several groups."""
    known = tokens.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("group", F.coalesce("root", "class")).drop("root")
    mixed = known.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("token")
    return known.join(mixed, "token", "left_semi")


def _one_each(tokens: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each class one class of another group that it may link with, the same for many."""
    luck = F.xxhash64(F.lit(turn), "class")
    pivots = tokens.groupBy("token").agg(F.min_by(F.struct("class", "n", "at", "group"), luck).alias("p")).select("token", "p.*")
    may = tokens.alias("x").join(pivots.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & _may_link("x", "y"))
    return may.groupBy(F.col("x.class").alias("a")).agg(F.min_by(F.col("y.class"), F.xxhash64(F.lit(turn), "y.class")).alias("b"))


def _left_over(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): pairs of different groups that pass the size, position and sketch bounds; large columns in blocks."""
    size = cut(tokens.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")))
    full = tokens.join(size, "token").join(rows.select("class", "sketch"), "class")
    own = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = full.select("token", own.alias("own"), copies.alias("other"), "class", "group", "n", "at", "sketch")
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("token", lo.alias("lo"), hi.alias("hi"), "own", "class", "group", "n", "at", "sketch")

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if key is not None and tuple(ids[i]) != key and held:
                    yield from _block_pairs(held)
                    held = []
                key = tuple(ids[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from _block_pairs(held)

    pairs = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(run, "a binary, b binary")
    return pairs.distinct()


def _block_pairs(held: list[pa.RecordBatch]):
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    if rows.num_rows < 2:
        return
    lo, hi, own = rows.column(1)[0].as_py(), rows.column(2)[0].as_py(), rows.column(3).to_numpy()
    name, group = np.array(rows.column(4).to_pylist(), object), np.unique(np.array(rows.column(5).to_pylist(), object), return_inverse=True)[1]
    n, at = rows.column(6).to_numpy().astype(np.int64), rows.column(7).to_numpy().astype(np.int64)
    bits = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint64).reshape(rows.num_rows, -1)
    for i in range(rows.num_rows - 1):
        j = np.arange(i + 1, rows.num_rows)
        total = n[j] + n[i]
        may = (group[j] != group[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))
        may &= 1 + np.minimum(n[j] - 1 - at[j], n[i] - 1 - at[i]) >= -(-4 * total // 9)
        if lo != hi:
            may &= own[j] != own[i]
        j = j[may]
        if not len(j):
            continue
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        j = j[differ <= total[may] // 9]
        if len(j):
            flip = np.array([name[i] < name[k] for k in j])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[i] if f else name[k] for f, k in zip(flip, j)], pa.binary()), pa.array([name[k] if f else name[i] for f, k in zip(flip, j)], pa.binary())], ["a", "b"])


def _counted_apart(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The links among the pairs; the shuffle files of the search go before the sets move."""
    found = cut(pairs)
    release(rows.sparkSession)
    return cut(_linked(found, rows))


def _joined_groups(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the classes that links join."""
    links, groups, open_ = None, None, tokens.withColumn("group", F.col("class"))
    for turn in range(ROUNDS):
        found = _counted_apart(_close(_one_each(open_, turn), rows), rows)
        links = found if links is None else links.unionByName(found)
        groups = components(links)
        open_ = cut(_grouped(tokens, groups))
        release(tokens.sparkSession)
    found = _counted_apart(_left_over(open_, rows), rows)
    return groups if found.isEmpty() else components(links.unionByName(found))


def join(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    parts = parts_for(docs, text)
    first_pass = cut(_heads_and_counts(docs, text, parts, shingle))
    release(spark)
    heads = first_pass.filter("code is null").select("doc_id", "n_shingles", "class")
    whole = heads.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    common = _common(first_pass.filter("code is not null"))
    tokens = cut(_tokens(docs, text, parts, shingle, common))
    release(spark)
    wanted = cut(whole.join(tokens.select("class").distinct(), "class").select(F.col("first").alias("doc_id"), "class"))
    with _by_class(_rows_of(docs, text, shingle, wanted, parts), parts) as rows:
        release(spark)
        groups = _joined_groups(tokens, rows)
    release(spark)
    named = cut(whole.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    first = named.groupBy("root").agg(F.min("first").alias("component"))
    ids = named.join(first, "root").select("class", "component")
    out = heads.join(ids, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
