"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster pass your own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local session without the setting (tests, notebooks) gets a temporary folder of this machine; on
    a cluster that would be another folder on each machine, so it is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return sc.getCheckpointDir()


def storage(spark: SparkSession, path: str):
    """The Hadoop file system that a path is on, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever storage the path names."""
    system, where = storage(spark, path)
    return system.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, written beside and put in place at once, over the one that is there, on whatever storage the path names."""
    system, where = storage(spark, path)
    where = system.makeQualified(where)
    beside = where.suffix(f".{uuid.uuid4().hex}.new")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, where, over)


def read_text(spark: SparkSession, path: str) -> str:
    """A small document from whatever storage the path names."""
    system, where = storage(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in checkpoint_dir()."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A table written as Parquet in checkpoint_dir(), for rows that a checkpoint would hold in several times the
    space; drop() removes it once nothing that is still to be computed reads it. The shuffle files of its
    computation go when it is written."""

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet")
        before = spark.conf.get(self._CLEAN, "false")
        spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(str(self._path))
        finally:
            spark.conf.set(self._CLEAN, before)
        self.df = spark.read.parquet(str(self._path))

    def drop(self) -> None:
        storage(self.df.sparkSession, str(self._path))[0].delete(self._path, True)
