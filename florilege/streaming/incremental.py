"""Streams: orphan state and provider index kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from florilege.operators.orphans import INDEX_SCHEMA, PENDING_SCHEMA, OrphanState, advance, empty_state, event_points, slotted
from florilege.session import hadoop_path, staging

WAITING_SCHEMA = "ref_key string, at timestamp_ntz, row_id bigint"
_DONE = "_DONE"


class OrphanStream:
    """Feeds micro-batches of events (see reference_events and parent_events) to the orphan state.

    Events of one batch may come in any order; an event older than what an earlier batch held counts
    as of its own arrival. The state of each batch lies in ``folder``/batch=N (index, pending points,
    waiting references), finished when its marker is there. A batch starts from the last finished one
    before it, so a restart goes on where the checkpoint does, and a batch that is replayed gives the
    same rows again instead of counting twice. ``on_settled(batch_id, rows)`` gets ref_key, row_id and
    reason; it must take a batch_id that it has seen as a repetition. The states of the last two
    batches are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, on_settled: Callable[[int, DataFrame], None]):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.on_settled = on_settled

    def finished(self) -> list[int]:
        """Batches whose state is complete."""
        fs, root = hadoop_path(self.spark, self.folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        ids = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return sorted(i for i in ids if fs.exists(hadoop_path(self.spark, f"{self._at(i)}/{_DONE}")[1]))

    def _at(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id}"

    def state_of(self, batch_id: int) -> tuple[OrphanState, DataFrame]:
        """(state, references that wait) after a finished batch."""
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self._at(batch_id)}/{name}")
        return OrphanState(read("index", INDEX_SCHEMA), read("pending", PENDING_SCHEMA)), read("waiting", WAITING_SCHEMA)

    def batch(self, events: DataFrame, batch_id: int) -> None:
        done = self.finished()
        earlier = [i for i in done if i < batch_id]
        if not earlier and any(i > batch_id for i in done):
            raise RuntimeError(f"the state before batch {batch_id} is gone")
        state, waiting = self.state_of(earlier[-1]) if earlier else (empty_state(self.spark), self.spark.createDataFrame([], WAITING_SCHEMA))
        with staging(self.spark):
            self._play(state, waiting, events, batch_id)
        fs, marker = hadoop_path(self.spark, f"{self._at(batch_id)}/{_DONE}")
        fs.create(marker, True).close()
        for old in done:
            if old < batch_id and old != earlier[-1]:
                fs.delete(hadoop_path(self.spark, self._at(old))[1], True)

    def _play(self, state: OrphanState, waiting: DataFrame, events: DataFrame, batch_id: int) -> None:
        state, settled = advance(state, slotted(event_points(events), "orphan-stream"))
        rows = waiting.unionByName(events.filter("row_id is not null").select("ref_key", "at", "row_id"))
        self.on_settled(batch_id, rows.join(settled, ["ref_key", "at"]).select("ref_key", "row_id", "reason"))
        for name, df in (("index", state.index), ("pending", state.pending), ("waiting", rows.join(state.pending, ["ref_key", "at"], "left_semi").select("ref_key", "at", "row_id"))):
            df.write.mode("overwrite").parquet(f"{self._at(batch_id)}/{name}")

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(index_rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving index rows to the partitioned index (see write_index)."""
    rows = index_rows.withColumn("prefix", F.substring("key", 1, 2))
    return rows.writeStream.format("parquet").partitionBy("key_type", "prefix").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per time window and key; what comes later than the watermark is dropped by Spark's rule."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
