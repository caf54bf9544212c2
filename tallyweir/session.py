"""Sessions for tests and local runs, and the shared folder that long plans cut their lineage in."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tallyweir.sources.files import Files


def local_session(cores: int = 8, shuffle_partitions: int = 8, name: str = "tallyweir", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The session's ``spark.checkpoint.dir`` holds; only where that is unset
    (local runs and tests) a temporary folder is made."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix=f"checkpoint-{os.getpid()}-")
        Files(spark).drop_at_exit(folder)
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder. It is removed when the session's JVM ends, as lazy results read it
    until then."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    Files(spark).drop_at_exit(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive the loss of any executor. The session's part of that
    folder is removed when its JVM ends."""
    Files(df.sparkSession).drop_at_exit(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once a session, unless PYTHONPATH brings it there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_tallyweir_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tallyweir-")
    archive = os.path.join(folder, "tallyweir.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path, folders, files in os.walk(os.path.join(root, "tallyweir")):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._tallyweir_shipped = True
