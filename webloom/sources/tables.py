"""Table access and lineage control shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table; projection and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def stamp(spark: SparkSession, root: str, name: str) -> tuple:
    """Names, sizes and times of a table's files, which differ once it has changed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


#: An input of more splits is never reshuffled for the sake of parallelism.
SMALL_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small scan that has fewer splits than the session has cores.

    Small files arrive as one split, as a row group cannot be split, and would leave one core with all Python
    work. Any larger input keeps its splits, whatever the size of the cluster, so no shuffle is added there.
    """
    want, have = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(want) if have < min(want, SMALL_SPLITS) else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. Only a local session may go without: it gets its own folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder, that all executors share, for files that outlive one query; ``clean_up`` deletes it."""
    ensure_checkpoint_dir(spark)
    _FOLDERS.append(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete the folders that ``shared_folder`` gave to this process; call it at the end of a session."""
    jvm, n = spark.sparkContext._jvm, len(_FOLDERS)
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
