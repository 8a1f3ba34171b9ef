"""Session factory and table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(app: str = "lexigrove", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings that the engine's semantics rest on.

    The time zone is UTC. Sizes (shuffle partitions, memory) are the
    cluster's to set; adaptive execution is on unless told otherwise.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema or corpus tables of a folder."""
    if name not in TABLES:
        raise KeyError(f"no table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
