"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "demandlake") -> SparkSession:
    """Session for tests, bench and local runs.

    On a cluster the submitter owns master, memory and partition counts; the
    library only relies on UTC session time, AQE and Arrow being on.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is read from the session and never overridden. Only a ``local`` master
    with nothing configured (tests, local runs) gets a fresh temp folder; on
    any other master executors would not share it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        current = tempfile.mkdtemp(prefix="demandlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``demandlake`` importable on executors (for mapInPandas / applyInPandas code).

    Zips the installed package once per driver and adds it with
    ``addPyFile``, which distributes it to every executor of the cluster.
    Python workers compute with one thread each, unless told otherwise: Spark
    already runs one per core.
    """
    import os
    import shutil

    sc = spark.sparkContext
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        sc.environment.setdefault(name, "1")
    if id(sc) in _SHIPPED or "demandlake" in (spark.conf.get("spark.submit.pyFiles", "") or ""):
        return  # already shipped (e.g. spark-submit --py-files demandlake.zip)
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="demandlake-pkg-")
    base = os.path.join(out_dir, "demandlake")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="demandlake")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
