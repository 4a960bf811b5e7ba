"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow). ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return with_package(builder.getOrCreate())


def with_package(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers can import this package wherever they run.

    Workers get its folder in their search path; on a cluster, which may not share that folder, also a zip of the package.
    """
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    path = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) not in path:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, path)])
        if not context.master.startswith("local"):
            archive = os.path.join(tempfile.mkdtemp(prefix="keyloom-package-"), "keyloom.zip")
            with zipfile.ZipFile(archive, "w") as z:
                for p in sorted((root / "keyloom").rglob("*.py")):
                    z.write(p, p.relative_to(root))
            context.addPyFile(archive)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables; every table is a Parquet file or folder of its own name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see: the one ``spark.checkpoint.dir`` names.

    Only a local session, whose executor is this machine, may do without that setting and gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for repartitions that must be explicit."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
