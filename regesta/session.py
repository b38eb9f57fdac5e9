"""Session helpers: a local session for tests, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("regesta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_regesta_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="regesta-package-")  # on the driver; Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "regesta-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._regesta_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or, on one machine only, a temporary one."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(known)
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="regesta-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def forget_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def state_dir(spark: SparkSession) -> str:
    """Where tables are kept from run to run: the session's spark.regesta.state.dir, or, for this session only, a folder in the shared one."""
    known = spark.conf.get("spark.regesta.state.dir", None)
    if known:
        return known.rstrip("/")
    path = f"{shared_dir(spark).rstrip('/')}/regesta/state-{spark.sparkContext.applicationId}"
    forget_at_exit(spark, path)
    return path


def folder_names(spark: SparkSession, path: str, whole: bool = False) -> list[str]:
    """The folders in a folder, by name; whole: those only that a job has written to the end."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return [n for n in names if not whole or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts lineage: a lost executor costs only the reading of a file. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/regesta/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """materialise, and aggregates of the rows that were written, taken on the way: they cost no job of their own."""
    seen = Observation()
    kept = materialise(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return kept, seen.get


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
