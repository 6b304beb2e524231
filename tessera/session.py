"""A session with the settings the catalog's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def session(master: str | None = None, name: str = "tessera") -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
