"""The Spark session that the command line builds; on a cluster, the submitted settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lodeframe", **settings: str) -> SparkSession:
    """Strict types, one time zone, adaptive plans, no files by path in SQL; other sizes are left to the cluster."""
    fixed = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.runSQLOnFiles": "false",
        "spark.scheduler.mode": "FAIR", "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.appName(name).config(map=fixed | settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
