"""The loops of the mail system as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from lettermill.operators import ingest
from lettermill.operators.queue import ENOUGH
from lettermill.operators.state import scratch

#: Pauses of the mailbox poller.
POLL = "30 seconds"


def first_copies(messages: DataFrame) -> DataFrame:
    """The first message of each (hash, account) of a stream; hashes are kept for good, as the tables keep them."""
    return messages.dropDuplicates(["hash", "account"])


def retry_counts(results: DataFrame, key: str = "id", enough: int = ENOUGH) -> DataFrame:
    """Columns key, seq, same_count, done for a stream of undecided results (columns key, seq, signature).

    Each key keeps its last signature and count. Once done, a key's later results are not counted: it has left the queue.
    """
    key_type = results.schema[key].dataType.simpleString()

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, done = state.get if state.exists else (None, 0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if done:
                break
            n = n + 1 if r.signature == last else 1
            last, done = r.signature, n >= enough
            out.append((k[0], r.seq, n, done))
        state.update((last, n, done))
        yield pd.DataFrame(out, columns=[key, "seq", "same_count", "done"])

    return results.select(key, "seq", "signature").groupBy(key).applyInPandasWithState(count, f"{key} {key_type}, seq long, same_count long, done boolean", "last string, n long, done boolean", "append", "NoTimeout")


def ingest_stream(messages: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> DataStreamWriter:
    """Writes new messages of a stream to a Parquet table, each (hash, account) once.

    A micro-batch is checked against the table as it was when the batch began, so a batch that runs again after a failure adds nothing twice.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = ingest.insert_absent(batch, spark.read.parquet(table)) if there else ingest.first_of_each(batch)
        rows.write.mode("append").parquet(table)

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": POLL}))


def act_on_queue(queue: DataFrame, act: Callable[[DataFrame, int], DataFrame], outcomes: str, checkpoint: str, trigger: dict | None = None) -> DataStreamWriter:
    """Acts on each micro-batch of due messages and appends the outcomes; a message is done only by an outcome that says so.

    The epoch is a column of the outcomes and a batch that runs again replaces its own, so effects are at least once and outcomes exactly once.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        act(batch, epoch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{outcomes.rstrip('/')}/epoch={epoch}")

    return queue.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def run_through(stream: DataFrame, name: str) -> DataFrame:
    """All rows of an append stream over what its source has now."""
    folder = scratch(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
