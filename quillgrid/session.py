"""Session helpers shared by the entry point, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "quillgrid") -> SparkSession:
    """A local session with the settings the engine is written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUILLGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; the scan stays lazy and prunable."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt anew over as many tasks as a shuffle has, however small their file: for work that is long for each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unsent(rows: DataFrame) -> DataFrame:
    """rows for a join that shuffles both sides: of rows made from a well packed file Spark may guess that they are few, and send all of them."""
    return rows.hint("merge")
