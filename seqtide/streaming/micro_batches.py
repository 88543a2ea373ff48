"""A micro-batch stream into an incremental miner: sequences are complete on arrival and only appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import Config, IncrementalMiner
from ..sources.sequences import ordered_ids


class StreamFeed:
    """foreachBatch target: numbers a batch's sequences by the order column and processes them once.

    A batch id that was processed already (a replay after a failure) is passed over.  With a
    state folder the miner is saved there after every batch, and resume() goes on from it: what
    a lost driver had processed but not saved is replayed by the stream's own checkpoint.
    """

    def __init__(self, miner: IncrementalMiner, order: str = "seq", after: Callable[[IncrementalMiner, int], None] | None = None, state: str | None = None, last: int = -1) -> None:
        self.miner, self.order, self.after, self.state, self.last = miner, order, after, state, last

    @classmethod
    def resume(cls, spark: SparkSession, config: Config, state: str, order: str = "seq", after: Callable[[IncrementalMiner, int], None] | None = None) -> StreamFeed:
        """A feed that goes on where the state folder ends; a new one if it is empty."""
        miner, last = IncrementalMiner.load(spark, config, state)
        return cls(miner, order, after, state, last)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        ids = ordered_ids(batch.select(self.order).distinct(), self.order)
        self.miner.process_batch(batch.join(ids, self.order).select("sid", "ev", "item", "util"))
        if self.state:
            self.miner.save(self.state, batch_id)
        self.last = batch_id
        if self.after:
            self.after(self.miner, batch_id)


def start(stream: DataFrame, feed: StreamFeed, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run a stream of rows (order column, ev, item, util) into the feed."""
    need = [feed.order, "ev", "item", "util"]
    rows = stream.select(*[F.col(c) for c in need])
    return rows.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
