"""Session settings that every entry point shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "strandlake") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir, deleted when the JVM ends.

    Where that setting is empty a local master, whose executors are this machine, gets a folder of its own; a cluster
    must name one that all its machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="strandlake-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = _LOCAL[0]
    path = f"{root.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def forget(written: DataFrame) -> None:
    """Deletes the files of a result of ``materialized`` that nothing reads any more."""
    spark = written.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(written._strandlake_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialized(df: DataFrame, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The rows written once to the shared folder and read again, so that a loop's plan does not grow.

    instead_of: earlier results of this function that nothing reads any more; their files are deleted.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    for old in instead_of:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def once(df: DataFrame) -> DataFrame:
    """A result of ``materialized`` as it is, other rows written."""
    return df if hasattr(df, "_strandlake_path") else materialized(df)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, where their search path does not lead to it."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in known) or getattr(spark.sparkContext, "_strandlake", False):
        return
    folder = tempfile.mkdtemp(prefix="strandlake-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/strandlake.zip", "w") as out:
        for at, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    out.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    spark.sparkContext.addPyFile(f"{folder}/strandlake.zip")
    spark.sparkContext._strandlake = True
