"""Session factory for local runs; a cluster's own settings always win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestone", cores: int | str = "*", memory: str = "8g", **more: str) -> SparkSession:
    conf = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else os.cpu_count() or 8), "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | more
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
