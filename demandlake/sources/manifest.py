"""Versions that appear all at once: write aside, then switch one manifest.

A version is written under its own folder first; an entry of the manifest, one small file that Spark
commits as a whole, then names it. Readers go by the manifest alone, so a version whose writing failed
stays unseen, and a reader that has resolved a version keeps it while newer ones appear.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "name string, version string, number long"


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, number) of everything published under ``root``; numbers grow."""
    try:
        return spark.read.schema(ENTRY).json(f"{root}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def version_path(root: str, version: str) -> str:
    return f"{root}/versions/{version}"


def publish(spark: SparkSession, root: str, name: str, write: Callable[[str], object]) -> str:
    """Let ``write(path)`` write a version aside, then make it the current one of ``name``."""
    version = f"{name}-{uuid.uuid4().hex[:12]}"
    write(version_path(root, version))
    number = (entries(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(name, version, number)], ENTRY).coalesce(1).write.json(f"{root}/manifest/{number:012d}-{version}")
    return version


def current(spark: SparkSession, root: str, name: str) -> str:
    """The newest published version of ``name``."""
    got = entries(spark, root).where(F.col("name") == name).agg(F.max_by("version", F.struct("number", "version"))).first()[0]
    if got is None:
        raise FileNotFoundError(f"nothing published as {name} under {root}")
    return got
