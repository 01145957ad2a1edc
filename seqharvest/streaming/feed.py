"""Mining over a stream of batches.

The state of the search is a store of tables (operators/maintained.py): a micro-batch
adds its own positions, sums and list ends to it, reads those of the sequences that it touches,
and writes the patterns of all rows so far, one folder per batch.  The store's
manifest tells which batches are in it, so a query that is started again repeats nothing.  The
threshold is global, so mining stands in foreachBatch, not in keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintained import Maintained


def start(stream: DataFrame, xi: float, *, store: str, answers: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """stream(sid, tid, item, util): tid orders the itemsets of a key inside its batch; appended parts open new itemsets.  options: those of the store."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = Maintained(batch.sparkSession, store, xi, **options)
        # a batch that is stored already had its answer written, or has it written now: only the last one can be repeated
        if batch_id >= kept.version:
            kept.add(batch.select("sid", "tid", "item", "util"), batch_id).patterns().write.mode("overwrite").parquet(f"{answers}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
