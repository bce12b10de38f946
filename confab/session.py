"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and filters are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all tasks run in this very process (a local
    session, as in tests) is a temporary folder made; executors elsewhere could
    not read it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="confab-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` and forget what its plan knew of order, partitions and constraints.

    For loops: a checkpoint keeps that knowledge, and where each round joins the
    checkpoints of the one before, it doubles from round to round until the
    driver does nothing but plan.
    """
    kept = cut(df)
    spark = df.sparkSession
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def local_session(app: str = "confab", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session on one machine for tests and bench runs."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CONFAB_DRIVER_MEMORY", memory))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's code to the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="confab-code-"), "confab.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
            for folder, _, files in os.walk(root):
                for name in sorted(f for f in files if f.endswith(".py")):
                    full = os.path.join(folder, name)
                    package.write(full, os.path.join("confab", os.path.relpath(full, root)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
