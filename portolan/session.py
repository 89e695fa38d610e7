"""Session and settings."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "portolan", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; conf overrides."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map={**fixed, **conf}).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class UnsupportedFeature(NotImplementedError):
    pass


class Policy:
    """What happens when a feature has no equivalent: an error in strict mode, else one warning a message."""

    def __init__(self, strict: bool = False):
        self.strict, self.told = strict, set()

    def unsupported(self, message: str) -> None:
        if self.strict:
            raise UnsupportedFeature(message)
        if message not in self.told:
            self.told.add(message)
            warnings.warn(message, stacklevel=3)


policy = Policy()
