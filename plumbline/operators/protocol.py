"""A protocol of runs: which state may follow which, and a lock that one run holds at a time."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import runtime

#: What may follow what in a pair of runs; a run starts out of nothing (null).
PAIR = [(None, "planned"), ("planned", "first_running"), ("first_running", "first_done"), ("first_done", "second_running"), ("second_running", "second_done"), ("second_done", "compared"), ("first_running", "failed"), ("second_running", "failed"), ("failed", "planned")]


def transitions(spark: SparkSession, pairs: list[tuple[str | None, str]]) -> DataFrame:
    """(before, state) of an allowed step; a null before is the start."""
    return spark.createDataFrame(pairs, "before string, state string")


def steps(log: DataFrame, run: str, order: str, state: str) -> DataFrame:
    """(run, order, before, state): each entry of an append-only log against the one before it, null at first.

    Entries of one run are read in one order and one at a time, so a long log of a run is no more than a sort that spills.
    """
    before = F.lag(state).over(Window.partitionBy(run).orderBy(order))
    return log.select(run, order, before.alias("before"), F.col(state).alias("state"))


def illegal_steps(log: DataFrame, allowed: DataFrame, run: str = "run_id", order: str = "seq", state: str = "state") -> DataFrame:
    """(run, order, before, state) of the entries that no allowed step leads to. A null state is never allowed."""
    ok = F.broadcast(allowed.select(F.col("before").alias("__b"), F.col("state").alias("__s")).distinct())  # states squared at most
    seen = steps(log, run, order, state)
    return seen.join(ok, F.col("before").eqNullSafe(F.col("__b")) & (F.col("state") == F.col("__s")), "left_anti")


def first_illegal(log: DataFrame, allowed: DataFrame, run: str = "run_id", order: str = "seq", state: str = "state") -> DataFrame:
    """illegal_steps(), the first of each run."""
    first = F.min_by(F.struct(order, "before", "state"), order).alias("f")
    return illegal_steps(log, allowed, run, order, state).groupBy(run).agg(first).select(run, "f.*")


class Locked(RuntimeError):
    """Somebody else holds the lock."""


class Lock:
    """A lock by a file that is created if it is not there, on whatever storage its path names: with Lock(spark, path, owner): ...

    Storage must create a file for one of two that want it, as HDFS does; that of most object stores does not.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str):
        self._spark, self.path, self.owner = spark, path, owner
        self._fs, self._where = runtime.storage(spark, path)

    def acquire(self) -> None:
        self._fs.mkdirs(self._where.getParent())
        try:
            out = self._fs.create(self._where, False)  # of two that create it one gets an error
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Locked(f"{self.path} is held by {self.holder() or 'somebody'}") from None
        out.write(bytearray(self.owner.encode()))
        out.close()

    def holder(self) -> str | None:
        return runtime.read_text(self._spark, self.path) if runtime.exists(self._spark, self.path) else None

    def release(self) -> None:
        """Takes the lock away if it is one's own."""
        if self.holder() == self.owner:
            self._fs.delete(self._where, False)

    def __enter__(self) -> Lock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
