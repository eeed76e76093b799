"""Local session used by the tests, the comparison and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tracefold")
        .config("spark.driver.memory", os.environ.get("TRACEFOLD_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
