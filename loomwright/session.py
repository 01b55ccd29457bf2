"""Session settings shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

GROUP_ROW_LIMIT = "spark.loomwright.groupRowLimit"
DEFAULT_GROUP_ROW_LIMIT = 2_000_000


def local_session(cpus: int | None = None, name: str = "loomwright", memory: str = "16g") -> SparkSession:
    """Local session for tests and bench; a cluster session is used as it is given."""
    cpus = cpus or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def group_row_limit(spark: SparkSession) -> int:
    """Largest group one task may sort or hold; beyond it the chunked forms take over."""
    return int(spark.conf.get(GROUP_ROW_LIMIT, str(DEFAULT_GROUP_ROW_LIMIT)))
