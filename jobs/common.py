"""What the jobs share: settings from a small YAML file, and output folders of the registered queries."""

from __future__ import annotations

import logging
import uuid
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from fastaxis.plans.cutting import shared_folder


class SettingsError(ValueError):
    """Settings that the job can't use."""


def settings(path: str | Path, defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what the file says in their place; unknown names and other kinds of values are errors."""
    given = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(given, dict):
        raise SettingsError(f"{path}: a mapping is needed")
    if unknown := sorted(set(given) - set(defaults)):
        raise SettingsError(f"{path}: unknown settings: {', '.join(map(str, unknown))}")
    for name, value in given.items():
        kinds = (int, float) if isinstance(defaults[name], float) else (type(defaults[name]),)
        if not isinstance(value, kinds) or isinstance(value, bool) and not isinstance(defaults[name], bool):
            raise SettingsError(f"{path}: {name} must be of the kind of {defaults[name]!r}")
    return defaults | given


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir for one call of a registered query."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def session(name: str) -> SparkSession:
    """The session of a command line; master and other settings are spark-submit's or the environment's."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def replace_partitions(df: DataFrame, path: str, *by: str, form: str = "parquet", **options: Any) -> None:
    """Writes the rows into their partitions in place of what those held; others stay.

    The rebalance hint lets Spark merge small partitions of the write and split one that a
    hot value makes too large.
    """
    writer = df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(*by).format(form).save(path)
