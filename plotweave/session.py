"""Session and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "plotweave", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the oracle comparison needs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
