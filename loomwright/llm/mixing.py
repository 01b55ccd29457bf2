"""Mixing sources to target weights.

Tokens per source give each source's target and repetition rate (target / size). A document is emitted floor(rate)
times, and once more if a hash of its id and a seed, read as a number in [0, 1), is below the fraction of the rate.

Sources are ranked by code point, NULL last, and weigh 5, 2, 1 in turn. A source takes at most ``repeats`` times its
size; what is over goes to the others by weight, again until none is above. Texts without words (NULL, empty) have size
0 and are emitted by the same rule; a source of size 0 has target and rate 0. Rows are taken as they are, repeated rows
included; rows with one id share one draw. Columns of the input whose names are those of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.store import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, rank from 0): sorted once by ranges, numbered within ranges, shifted by the ranges before."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = cut(per.orderBy(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("__at")))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.alias("x").join(counts.alias("y"), F.col("y.__part") < F.col("x.__part"), "left")
    before = earlier.groupBy(F.col("x.__part").alias("__part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(before, "__part").select("source", "source_size", (F.col("__before") + row).alias("rank"))


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of a table with ``source`` and ``size``."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked_sources(sized).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).alias("most")))

    def above(left: int, total: int) -> Column:
        wide = "decimal(38,0)"
        return F.col("most").cast(wide) * F.lit(total).cast(wide) < F.col("weight").cast(wide) * F.lit(left).cast(wide)

    first = table.agg(F.sum("source_size").alias("left"), F.sum("weight").alias("total")).first()
    whole = first["left"] or 0
    level = (whole, first["total"] or 1)
    while True:
        over = above(*level)
        row = table.agg(F.sum(F.when(over, F.col("most"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("total")).first()
        after = (whole - (row["capped"] or 0), row["total"] or 1)
        if after == level:
            break
        level = after
    share = (F.lit(level[0]).cast("long") * F.col("weight")).cast("double") / F.lit(float(level[1]))
    return cut(table.select("source", "source_size", F.when(over, F.col("most").cast("double")).otherwise(share).alias("target")))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, text: str = "text", seed: str = SEED, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """All columns and size, source_size, target, copies: how often the mix emits each row."""
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in new]
    targets = source_targets(docs.select("source", word_count(F.col(text)).alias("size")), weights, repeats)
    sized = docs.select(*kept, word_count(F.col(text)).alias("size"))
    by = targets.select(F.col("source").alias("__source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(by, F.col("source").eqNullSafe(F.col("__source")), "left")
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(*kept, "size", "source_size", "target", copies.alias("copies"))


def emit(planned: DataFrame) -> DataFrame:
    """The mix itself: every row as often as ``copies`` says, without the columns of the plan."""
    kept = [c for c in planned.columns if c not in ("size", "source_size", "target", "copies")]
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return planned.filter("copies > 0").select(*kept, times.alias("__copy")).drop("__copy")
