"""What the corpus operators share: reading, Arrow batches, checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a Python stage hands back.
OUT_ROWS = 500


#: Most bytes and rows of an Arrow batch on its way to Python. A batch is held on both sides, rounded up to powers of two, and its memory kept.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to ours; lower ones stay."""
    for key, most, default in (("maxBytesPerBatch", BATCH_BYTES, 64 << 20), ("maxRecordsPerBatch", BATCH_ROWS, 10_000)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name, str(default))).lower()
        size = int("".join(c for c in now if c.isdigit()) or 0) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
        if size <= 0 or size > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, by whatever file system Spark knows; its texts go to Python in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id (long) and body (UTF-8 bytes, a null text is empty); every other column is left behind."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, in slices so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own one. Where neither is set, a folder of ours if all runs in one process, else an error."""
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not set_dir:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        set_dir = os.path.join(tempfile.gettempdir(), "lettermill-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(set_dir)
    return set_dir


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Folder:
    """A folder of our own below the shared one, whose tables are written as Parquet, read again, and removed once they are of no more use."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table, which cuts its lineage, and reads it again."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")


def release(spark: SparkSession) -> None:
    """Lets the context's cleaner find shuffles that nothing refers to any more, so that their files go before the next ones come."""
    gc.collect()
    spark._jvm.System.gc()


#: Most bits of a sieve, and bits for each value as long as that is enough.
SIEVE_BITS, SIEVE_SPACE = 1 << 27, 32
_WORD = 15  # a row of a sieve has 2 ** 15 bits, as Spark's bitmaps have


def sift(df: DataFrame, column: str, among: DataFrame) -> DataFrame:
    """The rows of `df` whose `column` may be among that of `among`: all that are, and a few that are not, which a join then finds. It saves their shuffle.

    One bit stands for each hash; all bits, 16 MB at most however many values there are, go to every task.
    """
    values = among.select(column).distinct()
    bits = min(SIEVE_BITS, max(1 << _WORD, 1 << (SIEVE_SPACE * values.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = values.select(F.shiftright(place, _WORD).alias("sieve_row"), F.pmod(place, F.lit(1 << _WORD)).alias("bit"))
    sieve = settle(rows.repartition("sieve_row").groupBy("sieve_row").agg(F.bitmap_construct_agg("bit").alias("sieve_bits")))
    at = F.pmod(place, F.lit(1 << _WORD))
    byte = F.conv(F.hex(F.substring("sieve_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    kept = df.withColumn("sieve_row", F.shiftright(place, _WORD)).join(F.broadcast(sieve), "sieve_row")
    return kept.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*df.columns)
