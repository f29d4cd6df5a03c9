"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: From Spark 4.1 on; earlier ones don't know it and keep the files until the driver collects its garbage.
RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("msgtriage")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may go without it; it then gets one temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="msgtriage-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, a folder for each value of ``by``, and read it back.

    Used where several plans read one expensive result: the copy survives the
    loss of an executor, which a cached block does not, and cuts the lineage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is stored meanwhile leaves no shuffle files behind, so those of several steps don't add up."""
    before = spark.conf.get(RELEASE_KEY, None)
    spark.conf.set(RELEASE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE_KEY)
        else:
            spark.conf.set(RELEASE_KEY, before)
