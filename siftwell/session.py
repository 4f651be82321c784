"""Sessions, and the shared folder that holds intermediate tables.

Intermediate results that several plans read, or whose layout must not change
between two reads, are written as Parquet under the folder named by
``spark.checkpoint.dir``. Every executor sees that folder, so a lost executor
costs no more than a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def session(app: str = "siftwell", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent a local master gets a temporary folder; on a
    cluster a machine-local folder would lose data, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="siftwell-")
    return _local_dirs[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/siftwell/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session runs tasks at once.

    For work in Python on rows that lie in a few large files: only layouts of
    fewer partitions than that are shuffled, the rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used instead of a cache where the rows must stay the same for every reader
    and survive the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_all(**frames: DataFrame) -> list[DataFrame]:
    """:func:`materialise` of several frames at once, by label: independent jobs
    run side by side and fill the slots that small stages leave idle."""
    spark = next(iter(frames.values())).sparkSession
    with ThreadPoolExecutor(len(frames)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(materialise), df, label) for label, df in frames.items()]
        return [j.result() for j in jobs]
