"""Session factory: adaptive execution, UTC, and shuffle sizes that follow the data."""

from pyspark.sql import SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
