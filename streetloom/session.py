"""Session with the settings the library expects; every one of them may be overridden by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("streetloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **{k.replace("__", "."): v for k, v in conf.items()}}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
