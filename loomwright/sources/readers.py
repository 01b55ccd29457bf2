"""Declared-schema file sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.plans.scan import row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None,
    timestamp_format: str | None = None, header: bool = True,
) -> DataFrame:
    """CSV to a declared schema; only the named columns are parsed."""
    reader = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_dimension(
    spark: SparkSession, path: str, schema, key: str, keep: Column, expected_rows: int | None = None
) -> DataFrame:
    """Dimension file without its sentinel rows, key as integer; a wrong size is an error."""
    df = read_csv(spark, path, schema).filter(keep).withColumn(key, F.col(key).cast("int"))
    if expected_rows is not None:
        n = df.count()
        if n != expected_rows:
            raise ValueError(f"{path}: expected {expected_rows} rows, found {n}")
    return df


def parse_frames(df: DataFrame, entity: str = "entity", text: str = "text") -> DataFrame:
    """Whitespace matrix text, one line per coefficient -> one row per frame with its coefficients."""
    lines = df.select(entity, F.posexplode(F.split(F.trim(text), r"\n")).alias("coef", "line"))
    cells = lines.select(
        entity, "coef", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("frame", "cell")
    )
    return cells.groupBy(entity, "frame").agg(
        # one struct per coefficient line, so the list length is the fixed coefficient count
        F.transform(
            F.array_sort(F.collect_list(F.struct("coef", F.col("cell").cast("double").alias("x")))),
            lambda s: s["x"],
        ).alias("coefs")
    )


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """One matrix file per entity; the entity is the file name without its suffix."""
    raw = spark.read.option("wholetext", True).text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("entity"),
        F.col("value").alias("text"),
    )
    return parse_frames(raw)


def read_label_matrix(spark: SparkSession, path: str, id_col: str, labels: Sequence[str], extra: str) -> DataFrame:
    """Headerless id, 0/1 indicators, extra column -> long (id, label, y, extra)."""
    schema = f"{id_col} long, " + ", ".join(f"`{l}` int" for l in labels) + f", {extra} double"
    wide = read_csv(spark, path, schema, header=False)
    return wide.unpivot([id_col, extra], list(labels), "label", "y")


def align_external(
    df: DataFrame, rename: dict[str, str], columns: Sequence[str], id_col: str, order: Column
) -> DataFrame:
    """External table onto our column names: clean headers, rename alternates, negative ids."""
    clean = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    for old, new in rename.items():
        if old in clean.columns:
            clean = clean.withColumnRenamed(old, new)
    numbered = row_numbers(clean, [], [order], "__n")
    return numbered.select((-F.col("__n")).alias(id_col), *columns)
