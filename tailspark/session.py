"""Session builder with the few settings the library depends on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tailspark", master: str | None = None, **conf: str) -> SparkSession:
    """Day-grain dates need a UTC session; AQE sizes partitions and splits skewed joins at run time.

    `spark.sql.shuffle.partitions` is only an upper bound under AQE, so a cluster sets it
    to a few times its cores and small inputs coalesce by themselves.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
