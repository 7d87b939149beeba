"""Sessions, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lotgrid", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where the session names none (tests, one machine) a temporary folder is set once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="lotgrid-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, executors may die.

    Unlike checkpoint() the rows are stored as compressed columns, so later reads prune columns, and,
    with ``by``, a filter on that column reads its part only. discard() removes the files again.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    order = [c for c in df.columns if c != by] + ([by] if by else [])
    held = spark.read.schema(df.select(*order).schema).parquet(path)
    held._lg_path = path
    return held


def discard(*held: DataFrame | None) -> None:
    """Remove the files of cut() tables that nothing reads any more; any other table is left alone."""
    for df in held:
        path = getattr(df, "_lg_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path, and as an archive where machines are remote."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if root in known.split(os.pathsep):
        return
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    if not context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="lotgrid-")  # on the driver, from where Spark serves it
        context.addPyFile(shutil.make_archive(os.path.join(folder, "lotgrid_package"), "zip", root, "lotgrid"))
