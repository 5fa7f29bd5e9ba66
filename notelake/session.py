"""Session defaults shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "notelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; a cluster's own settings win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; shuffle partitions follow the cores."""
    n = cpus or os.cpu_count() or 4
    settings = {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory} | conf
    return build_session(master=f"local[{n}]", **settings)
