"""Derived views used by several queries, as DataFrames and as the same text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def null_every(value: str, key: str, k: int):
    return F.when(F.col(key) % k != 0, F.col(value))


def orders_nulled(spark: SparkSession, d: str) -> DataFrame:
    """Orders with missing cells in price, priority and status."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        null_every("o_orderstatus", "o_orderkey", 5).alias("o_orderstatus"),
        null_every("o_totalprice", "o_orderkey", 7).alias("o_totalprice"),
        null_every("o_orderpriority", "o_orderkey", 11).alias("o_orderpriority"),
    )


ORDERS_NULLED = """(SELECT o_orderkey, o_custkey, o_orderdate,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def lineitem_nulled(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.withColumn("l_quantity", null_every("l_quantity", "l_orderkey", 7)).withColumn(
        "l_extendedprice", null_every("l_extendedprice", "l_partkey", 9))


LINEITEM_NULLED = """(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice END AS l_extendedprice) FROM lineitem)"""


def part_nulled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", null_every("p_brand", "p_partkey", 7).alias("p_brand"),
                    null_every("p_type", "p_partkey", 5).alias("p_type"),
                    null_every("p_size", "p_partkey", 3).alias("p_size"), "p_retailprice")


PART_NULLED = """(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS p_brand,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS p_type,
  CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"""


def split_col(key: str):
    """Train/test split: four of five ids train."""
    return F.when(F.col(key) % 5 < 4, F.lit("train")).otherwise(F.lit("test"))


def split_sql(key: str) -> str:
    return f"CASE WHEN {key} % 5 < 4 THEN 'train' ELSE 'test' END"


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem with a split; the test side is shifted by a tenth so that drift is not zero."""
    l = table(spark, d, "lineitem")
    test = F.col("l_orderkey") % 5 >= 4
    return l.select(
        "l_orderkey", split_col("l_orderkey").alias("split"),
        F.when(test, F.col("l_quantity") + 2.0).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(test, F.col("l_extendedprice") * 1.5).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        (F.col("l_discount") + 0.0).alias("l_discount"), "l_tax",
        F.when(test & (F.col("l_returnflag") == "A"), F.lit("R")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )


SPLIT_LINES = f"""(SELECT l_orderkey, {split_sql('l_orderkey')} AS split,
  CASE WHEN l_orderkey % 5 >= 4 THEN l_quantity + 2.0 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 5 >= 4 THEN l_extendedprice * 1.5 ELSE l_extendedprice END AS l_extendedprice,
  l_discount + 0.0 AS l_discount, l_tax,
  CASE WHEN l_orderkey % 5 >= 4 AND l_returnflag = 'A' THEN 'R' ELSE l_returnflag END AS l_returnflag FROM lineitem)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Three scored runs over all orders: (run, row_id, y, score in [0,1], fold)."""
    o = table(spark, d, "orders")
    month = F.month("o_orderdate")
    y = (F.col("o_orderstatus") == "F").cast("int")
    a = F.floor(F.col("o_totalprice") / 500.0).cast("int") * 5 + y * 400
    b = ((F.col("o_custkey") * 7919) % 1000).cast("int") * 3 + y * 250
    c = (month * 211 + F.col("o_orderkey") % 50).cast("int") + y * 150
    base = o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), F.col("o_custkey").alias("cust"),
                    (F.col("o_orderkey") % 5).cast("int").alias("fold"),
                    (a / 6000.0).alias("a"), (b / 4000.0).alias("b"), (c / 3000.0).alias("c"))
    return base.unpivot(["row_id", "y", "fold"], ["a", "b", "c"], "run", "score")


SCORES_WIDE = """(SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS y, (o_orderkey % 5)::INT AS fold,
  (floor(o_totalprice / 500.0)::INT * 5 + (o_orderstatus = 'F')::INT * 400)::INT / 6000.0::DOUBLE AS a,
  ((((o_custkey * 7919) % 1000)::INT * 3 + (o_orderstatus = 'F')::INT * 250)::INT) / 4000.0::DOUBLE AS b,
  ((month(o_orderdate) * 211 + o_orderkey % 50)::INT + (o_orderstatus = 'F')::INT * 150)::INT / 3000.0::DOUBLE AS c
  FROM orders)"""
SCORES = f"""(SELECT row_id, y, fold, 'a' AS run, a AS score FROM {SCORES_WIDE} UNION ALL
  SELECT row_id, y, fold, 'b', b FROM {SCORES_WIDE} UNION ALL SELECT row_id, y, fold, 'c', c FROM {SCORES_WIDE})"""


def scores_wide(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("row_id", "y", "fold").pivot("run", ["a", "b", "c"]).agg(F.first("score"))


def class_probs(spark: SparkSession, d: str) -> DataFrame:
    """Five-class probabilities per order: (row_id, y, fold, p array), ties included."""
    o = table(spark, d, "orders")
    y = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")).cast("int") - 1
    base = o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), F.col("o_custkey").alias("cust"),
                    F.month("o_orderdate").alias("m"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))
    raw = F.array(*[
        ((F.col("cust") * (c + 3) + F.col("m") * (c + 1)) % 17 + 1
         + F.when((F.col("y") == c) & (F.col("row_id") % 3 == 0), 10).otherwise(0)).cast("int")
        for c in range(5)
    ])
    w = base.withColumn("raw", raw)
    total = w["raw"][0] + w["raw"][1] + w["raw"][2] + w["raw"][3] + w["raw"][4]
    return w.select("row_id", "y", "fold", F.transform("raw", lambda x: x / total).alias("p"))


CLASS_LONG = """(SELECT row_id, y, fold, c, raw, raw / (sum(raw) OVER (PARTITION BY row_id))::DOUBLE AS p FROM (
  SELECT o_orderkey AS row_id, (left(o_orderpriority, 1)::INT - 1) AS y, (o_orderkey % 5)::INT AS fold, c::INT AS c,
    ((o_custkey * (c + 3) + month(o_orderdate) * (c + 1)) % 17 + 1
     + CASE WHEN (left(o_orderpriority, 1)::INT - 1) = c AND o_orderkey % 3 = 0 THEN 10 ELSE 0 END)::INT AS raw
  FROM orders, range(5) t(c)))"""


# three class-probability runs over the same rows: multipliers and bonus of their integer raw scores
_RUN_RULES = {"m0": (3, 1, 17, 3, 10), "m1": (7, 2, 13, 4, 8), "m2": (11, 5, 19, 5, 9)}


def class_runs(spark: SparkSession, d: str) -> DataFrame:
    """Wide: (row_id, y, fold, m0, m1, m2), each run an array of five probabilities."""
    o = table(spark, d, "orders")
    y = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")).cast("int") - 1
    base = o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), F.col("o_custkey").alias("cust"),
                    F.month("o_orderdate").alias("m"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))
    for run, (a, b, mod, every, bonus) in _RUN_RULES.items():
        base = base.withColumn(f"raw_{run}", F.array(*[
            ((F.col("cust") * (c + a) + F.col("m") * (c + b)) % mod + 1
             + F.when((F.col("y") == c) & (F.col("row_id") % every == 0), bonus).otherwise(0)).cast("int") for c in range(5)]))

    def normal(r):
        r = F.col(r)
        return F.transform(r, lambda x: x / (r[0] + r[1] + r[2] + r[3] + r[4]))

    return base.select("row_id", "y", "fold", *[normal(f"raw_{run}").alias(run) for run in _RUN_RULES])


CLASS_RUNS = "(" + " UNION ALL ".join(
    f"""SELECT '{run}' AS run, row_id, y, fold, c, raw / (sum(raw) OVER (PARTITION BY row_id))::DOUBLE AS score FROM (
  SELECT o_orderkey AS row_id, (left(o_orderpriority, 1)::INT - 1) AS y, (o_orderkey % 5)::INT AS fold, c::INT AS c,
    ((o_custkey * (c + {a}) + month(o_orderdate) * (c + {b})) % {mod} + 1
     + CASE WHEN (left(o_orderpriority, 1)::INT - 1) = c AND o_orderkey % {every} = 0 THEN {bonus} ELSE 0 END)::INT AS raw
  FROM orders, range(5) t(c))""" for run, (a, b, mod, every, bonus) in _RUN_RULES.items()) + ")"


def class_runs_long(spark: SparkSession, d: str) -> DataFrame:
    w = class_runs(spark, d)
    runs = list(_RUN_RULES)
    long = w.select("row_id", "y", "fold", F.explode(F.array(*[
        F.struct(F.lit(r).alias("run"), F.col(r).alias("p")) for r in runs])).alias("s"))
    return long.select("s.run", "row_id", "y", "fold", F.posexplode("s.p").alias("c", "score"))
