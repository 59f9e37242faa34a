"""The work queue: scan, outcomes, and the counter of repeated undecided results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal results in a row after which a message is done.
ENOUGH = 3


def scan(mail: DataFrame, payload: str) -> DataFrame:
    """id and payload of messages still to do."""
    return mail.where(~F.col("operated")).select("id", payload)


def mark_done(mail: DataFrame, outcomes: DataFrame) -> DataFrame:
    """`mail` with operated set for the ids whose outcome says so; done stays done."""
    done = outcomes.where(F.col("operated")).select("id").distinct().withColumn("_done", F.lit(True))
    return mail.join(done, "id", "left").withColumn("operated", F.col("operated") | F.coalesce("_done", F.lit(False))).select(*mail.columns)


def consecutive(results: DataFrame, key: str, signature: str, *order: str) -> DataFrame:
    """Adds same_count: how often in a row the key has had the signature up to this result."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce(F.lag(signature).over(by) != F.col(signature), F.lit(True)).cast("int")
    islands = results.withColumn("_island", F.sum(changed).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.withColumn("same_count", F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order))).drop("_island")


def finalised(counted: DataFrame, key: str, *order: str, enough: int = ENOUGH) -> DataFrame:
    """The result at which each key was done: its first with enough in a row; later ones never happen, since the message has left the queue."""
    return counted.where(F.col("same_count") >= enough).groupBy(key).agg(F.min(F.struct(*order)).alias("at")).select(key, "at.*")


def next_state(mail: DataFrame, results: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """`mail` after one undecided result each (columns id, signature): the count goes up if the signature is the last one, else starts at one."""
    joined = mail.join(results.select("id", F.col("signature").alias("_signature")), "id", "left")
    count = F.when(F.col("_signature").isNull(), F.col("same_result_count")).when(F.col("last_result_signature") == F.col("_signature"), F.col("same_result_count") + 1).otherwise(1)
    return (
        joined.withColumn("same_result_count", count.cast("int"))
        .withColumn("last_result_signature", F.coalesce("_signature", "last_result_signature"))
        .withColumn("operated", F.col("operated") | (F.col("_signature").isNotNull() & (F.col("same_result_count") >= enough)))
        .select(*mail.columns)
    )


def votes(segments: DataFrame, key: str, allowed: str, contacts: str = "n_contacts") -> DataFrame:
    """Disposition of each message from its segments' votes (true, false, null) and contacts: relevant with a contact; irrelevant if all segments say no, or all yes without a contact; else unknown."""
    counted = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.count_if(F.col(allowed)).alias("n_true"), F.count_if(~F.col(allowed)).alias("n_false"), F.coalesce(F.sum(contacts), F.lit(0)).alias("n_contacts"))
    return counted.withColumn("disposition", F.when(F.col("n_contacts") > 0, "relevant").when((F.col("n_segments") > 0) & ((F.col("n_false") == F.col("n_segments")) | (F.col("n_true") == F.col("n_segments"))), "irrelevant").otherwise("unknown"))


def failures(results: DataFrame, key: str, error: str, position: str) -> DataFrame:
    """Errors of each message's contacts, in order, joined by "; "."""
    held = F.array_sort(F.collect_list(F.when(F.col(error).isNotNull(), F.struct(position, error))))
    return results.groupBy(key).agg(F.concat_ws("; ", F.transform(held, lambda x: x[error])).alias("errors"))


def sent_outcome(rows: DataFrame) -> DataFrame:
    """Adds operated to sent rows with columns subject, number, found, status, error: without a subject, a number or a file there is nothing to do; a missing destination (404) ends it; any other error is tried again."""
    final = F.col("subject").isNull() | F.col("number").isNull() | ~F.coalesce("found", F.lit(True)) | ((F.col("status") == 404) & (F.col("error") == "destination_not_found")) | (F.col("status").between(200, 299))
    return rows.withColumn("operated", F.coalesce(final, F.lit(False)))
