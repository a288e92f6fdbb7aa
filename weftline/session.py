"""Session helpers shared by every operator: table access, checkpoints, sizes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


#: Stage folders of this process, deleted at exit.
_STAGED: set[str] = set()


def local_session(cores: int = 4, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEFTLINE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A session that names none is taken to be a local test session; it gets a
    temporary folder, which is then set on the session.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{_stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _stage_dir(spark: SparkSession) -> str:
    at = f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"
    if at not in _STAGED:
        _STAGED.add(at)
        atexit.register(release, spark)
    return at


def release(spark: SparkSession) -> None:
    """Delete what this application has staged; frames that were read from it are of no use then. Also done at exit."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: another one, or whoever owns the folder, clears it
        pass


def unchunked(rows: pd.DataFrame) -> pd.DataFrame:
    """rows with text columns as Python objects.

    Text columns backed by Arrow may come in several chunks once they are
    filtered or joined, which Spark does not take back.
    """
    return rows.astype({c: object for c, kind in rows.dtypes.items() if pd.api.types.is_string_dtype(kind) and kind != object})


def frame(**columns) -> pd.DataFrame:
    """A table of columns; lists become columns of Python objects, also when they are empty."""
    return pd.DataFrame({name: values if isinstance(values, pd.Series) else pd.Series(values, dtype=object) for name, values in columns.items()})


def parallelism(spark: SparkSession) -> int:
    """Partitions to use for a shuffle that AQE must not coalesce."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
