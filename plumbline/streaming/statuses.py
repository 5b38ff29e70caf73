"""The last status of each run from a stream of statuses, in batches that may come twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.runtime import exists, storage

#: Batches after which the table is written anew as one.
COMPACT = 20


class StatusTable:
    """The last status of each run (run, order, ...) in a folder that all executors see.

    Each batch is a folder of its own by its number, with the last row of each of its runs: a batch that comes again after a lost
    driver overwrites its own folder and changes nothing. Batches up to a number are merged into one base now and
    then, of which the newest that is whole counts; a batch that a base holds is left alone.
    """

    def __init__(self, spark: SparkSession, root: str, run: str = "run_id", order: str = "seq"):
        self.spark, self.root, self.run, self.order = spark, root.rstrip("/"), run, order

    def _numbers(self, kind: str) -> list[int]:
        system, where = storage(self.spark, self.root)
        if not system.exists(where):
            return []
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and exists(self.spark, f"{self.root}/{n}/_SUCCESS"))

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row of the largest order of each run; of several the largest as a whole."""
        others = [c for c in rows.columns if c not in (self.run, self.order)]
        return rows.groupBy(self.run).agg(F.max(F.struct(self.order, *others)).alias("r")).select(self.run, "r.*")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """A batch's rows; the same batch again changes nothing. This is what foreachBatch calls."""
        base = self._numbers("base")
        if base and batch <= base[-1]:
            return
        self._last(rows).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        if batch - (base[-1] if base else -1) >= COMPACT:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """Merges the base and the batches up to a number into a new base, then drops them."""
        old = [("base", n) for n in self._numbers("base")] + [("batch", n) for n in self._numbers("batch") if n <= upto]
        self.read().write.mode("overwrite").parquet(f"{self.root}/base={upto}")
        for kind, n in old:
            if (kind, n) != ("base", upto):
                system, where = storage(self.spark, f"{self.root}/{kind}={n}")
                system.delete(where, True)

    def read(self) -> DataFrame:
        """The last status of each run over all batches that are whole."""
        base = self._numbers("base")[-1:]
        paths = [f"{self.root}/base={n}" for n in base] + [f"{self.root}/batch={n}" for n in self._numbers("batch") if not base or n > base[0]]
        if not paths:
            raise ValueError(f"{self.root} holds no batch")
        return self._last(self.spark.read.parquet(*paths))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Everything there is of a stream, batch by batch."""
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
