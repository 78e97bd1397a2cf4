"""Session defaults for standalone use; jobs on a cluster bring their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "churnloom", master: str | None = None, **conf: str
) -> SparkSession:
    """Session with adaptive execution and a fixed time zone.

    Sizes (shuffle partitions, memory) are left to the cluster unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Capturing the call site of every expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
