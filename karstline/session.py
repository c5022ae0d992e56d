"""Session with the settings that the semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from karstline.errors import InvalidInput

REQUIRED = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}


def build_session(master: str | None = None, name: str = "karstline", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_ansi(spark: SparkSession) -> None:
    """Overflow is an error only under ANSI arithmetic, so sums refuse to be built without it."""
    if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise InvalidInput("spark.sql.ansi.enabled must be true: integer overflow is an error")
