"""Sessions and the benchmark's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and NTZ timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Temporary views of a folder's Parquet tables."""
    out = {}
    for n in names:
        out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out


def engine_for(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> Engine:
    load_tables(spark, folder, names)
    return Engine(spark)
