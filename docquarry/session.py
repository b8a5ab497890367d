"""Session factory with the settings that every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI casts raise, timestamps are UTC, Python exchange goes through Arrow, AQE re-plans joins.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "docquarry", master: str | None = None, **conf: object) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for dots (``spark__sql__shuffle__partitions=8``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
