"""Spelling variants: words one edit apart, grouped under the frequent form, by a frontier that walks a trie as tables.

The trie is path-compressed: a node is a prefix at which words part or one ends, an edge carries the letters to the next
node. A level is one join of the frontier with the edges of that level. A state is (word, target, depth): the prefix of
``depth`` letters of the target is the node it stands at; a target of NULL means no edit yet, the node lies on the word's
own path. Two words one edit apart part at a node, so edits are made at nodes alone: replace the next letter by the
first of another edge, or leave it out. Both are made in one direction (to the larger letter, to the shorter word), so
that each pair comes up once. The state then follows the one edge that its target spells. A target that ends where a
word ends is a neighbour. Words without an edit yet are what the next level's edges are made of.

Edges of a node are at most as many as there are letters, so they stand in one row; a node with many words has as many
rows as its words need, and states are dealt over them by a hash of their word. Every level is a written table.

Words: maximal runs of ASCII and Latin-1 letters, A-Z in lower case. A rare, repeatable typing fault is put into the runs
(see ``noisy``); words of at least ``least_length`` letters with at least ``least_count`` occurrences count. NULL and
empty texts have no words, a NULL id is the text 'null' in the fault's hash, repeated rows count each, other columns play
no part. Ties between equally frequent near words go to the smaller one in code-point order. An empty table gives none.
"""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.store import cut, discard, fresh_path, release

LETTERS = "a-zÀ-ÿ"
FAULT_EVERY = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words of a node that one row of its edges serves.
WORDS_A_ROW = 4096


def noisy(doc_id: Column, run: Column) -> Column:
    """The run; without one of its letters where the hash of id and run says so."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run)
    h = F.crc32(key.cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % FAULT_EVERY == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts; runs that are too short already are not even taken out."""
    lower = F.translate(F.col(text), ascii_uppercase, ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)).alias("run"))
    found = runs.select(noisy(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _rows(n: Column) -> Column:
    return F.ceil(n / WORDS_A_ROW).cast("int")


def _shared_letters(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _edges(paths: DataFrame) -> DataFrame:
    """(node, salt, edges) of a level, from the words (word, n, depth) that stand at its nodes.

    The smallest and the largest word of an edge share what all its words share: that is its far end.
    """
    node, letter = F.expr("left(word, depth)"), F.expr("substr(word, depth + 1, 1)")
    each = paths.groupBy(node.alias("node"), "depth", letter.alias("letter")).agg(
        F.count(F.lit(1)).alias("words"), F.min(F.struct("word", "n")).alias("low"), F.max("word").alias("high"))
    until = F.when(F.col("words") == 1, F.length("low.word")).otherwise(_shared_letters(F.col("low.word"), F.col("high")))
    edge = F.struct("letter", F.expr("substr(low.word, depth + 2, until - depth - 1)").alias("more"), "until", "words",
                    F.expr("if(length(low.word) = until, low.n, null)").alias("end_n"))
    real = F.when(F.col("letter") != "", edge)  # a word that ends here counts for the node, but has no edge
    nodes = each.withColumn("until", until).groupBy("node").agg(F.collect_list(real).alias("edges"), F.sum("words").alias("words"))
    return nodes.select("node", F.explode(F.sequence(F.lit(0), _rows(F.col("words")) - 1)).alias("salt"), "edges")


#: Whether what is left of a target fits an edge, its first letter apart; ``left_over`` starts behind that letter.
_FITS = "left({left_over}, e.until - depth - 1) = e.more and if(length({left_over}) = e.until - depth - 1, e.end_n is not null, e.words > 1)"
_AS_MOVE = "struct({target} as target, e.until as depth, e.words as words, e.end_n as end_n)"


def _moves() -> str:
    """SQL of all moves of a state over the edges of its node."""
    def over(condition: str, left_over: str, target: str) -> str:
        return f"transform(filter(edges, e -> {condition} and {_FITS.format(left_over=left_over)}), e -> {_AS_MOVE.format(target=target)})"

    follow = over("e.letter = next", "rest", "target")
    keep = f"transform(filter(edges, e -> e.letter = next and e.words > 1), e -> {_AS_MOVE.format(target='cast(null as string)')})"
    replace = over("e.letter > next", "rest", "concat(left(word, depth), e.letter, rest)")
    leave_out = over("e.letter = after and after <> next", "substr(rest, 2)", "concat(left(word, depth), rest)")
    last = "if(after = '' and end_n is not null, array(struct(left(word, depth) as target, depth, 1L as words, end_n)), array())"
    return f"if(target is null, concat({keep}, {replace}, {leave_out}, {last}), {follow})"


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further; ``done`` where the target is a word."""
    spelled = "coalesce(target, word)"
    at = states.filter("target is not null or length(word) > depth").selectExpr(
        "*", f"left({spelled}, depth) as node", "cast(pmod(xxhash64(word), salts) as int) as salt",
        f"substr({spelled}, depth + 1, 1) as next", f"substr({spelled}, depth + 2) as rest", f"substr({spelled}, depth + 2, 1) as after")
    moved = at.join(edges, ["node", "salt"]).select("word", "n", F.explode(F.expr(_moves())).alias("m"))
    return moved.select("word", "n", F.col("m.target").alias("target"), F.col("m.depth").alias("depth"), _rows(F.col("m.words")).alias("salts"),
                        F.col("m.end_n").alias("end_n"), F.expr("coalesce(length(m.target) = m.depth, false)").alias("done"))


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs one edit apart, each pair once; ``counted`` has distinct (word, n)."""
    spark = counted.sparkSession
    counted = cut(counted.select("word", F.col("n").cast("long").alias("n")))
    total = counted.count()
    states = counted.select("word", "n", F.lit(None).cast("string").alias("target"), F.lit(0).alias("depth"),
                            F.lit(max(1, math.ceil(total / WORDS_A_ROW))).alias("salts"), F.lit(None).cast("long").alias("end_n"))
    levels, old = [], None
    while True:
        step = _step(states, _edges(states.filter("target is null").select("word", "n", "depth")))
        path = fresh_path(spark, "spelling")
        step.write.partitionBy("done").parquet(path)
        level = spark.read.schema(step.schema).parquet(path)
        levels.append(level.filter("done").select("word", "n", F.col("target").alias("near"), F.col("end_n").alias("near_n")))
        if old:
            discard(spark, f"{old}/done=false")
        release(spark)
        states, old = level.filter("not done").drop("done"), path
        if states.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by jumping over half of the way each round."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return at


def group(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if ``times`` as frequent."""
    counted = cut(words(docs, text, least_length, least_count))
    pairs = neighbours(counted)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = counted.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    formed = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
