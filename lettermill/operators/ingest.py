"""Incremental ingest of message folders: de-duplication by content hash, prefix until the first known message, first-run limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import columns as C

#: Newest messages that the first run of an account reads.
FIRST_RUN = 10


def with_hash(messages: DataFrame, body: str = "body", account: str = "account_key") -> DataFrame:
    """Adds hash (of the body) and account (hash of the account's key)."""
    return messages.withColumn("hash", C.content_hash(F.col(body))).withColumn("account", C.content_hash(F.col(account)))


def body_of(html: Column, text: Column) -> Column:
    """HTML, else text, else nothing; an empty HTML body counts."""
    return F.coalesce(html, text, F.lit(""))


def first_of_each(messages: DataFrame, order: str = "uid") -> DataFrame:
    """The earliest message of each (hash, account); aggregated before the shuffle, so copies cost nothing."""
    rest = [c for c in messages.columns if c not in ("hash", "account")]
    return messages.groupBy("hash", "account").agg(F.min_by(F.struct(*rest), order).alias("row")).select("hash", "account", "row.*").select(*messages.columns)


def insert_absent(new: DataFrame, old: DataFrame, order: str = "uid") -> DataFrame:
    """Rows of `new` to append: first of each (hash, account), and not in `old`."""
    return first_of_each(new, order).join(old.select("hash", "account").distinct(), ["hash", "account"], "left_anti")


def known_flag(messages: DataFrame, old: DataFrame) -> DataFrame:
    """Adds known: whether (hash, account) is in `old`."""
    seen = old.select("hash", "account").distinct().withColumn("known", F.lit(True))
    return messages.join(seen, ["hash", "account"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def has_rows(accounts: DataFrame, old: DataFrame) -> DataFrame:
    """Accounts that have a row in `old`."""
    return accounts.join(old.select("account").distinct(), "account", "left_semi")


def until_known(flagged: DataFrame, by: str = "account", order: str = "uid") -> DataFrame:
    """Messages newer than the newest known one of each account.

    The newest known uid of an account is an aggregate, joined back, so no account's messages are sorted in one task.
    """
    newest = flagged.groupBy(by).agg(F.max(F.when(F.col("known"), F.col(order))).alias("_newest"))
    return flagged.join(newest, by).where(F.col("_newest").isNull() | (F.col(order) > F.col("_newest"))).drop("_newest")


def first_run(messages: DataFrame, n: int = FIRST_RUN, by: str = "account", order: str = "uid") -> DataFrame:
    """The n newest messages of each account; limits of nought or less mean the default. Each task keeps n of an account before the shuffle."""
    n = n if n > 0 else FIRST_RUN
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def pending(messages: DataFrame, old: DataFrame, n: int = FIRST_RUN) -> DataFrame:
    """What a pass over the folders ingests: of new accounts the newest n, of others everything newer than the newest known one; oldest first by uid."""
    accounts = old.select("account").distinct()
    fresh = first_run(messages.join(accounts, "account", "left_anti"), n)
    known = known_flag(messages.join(accounts, "account", "left_semi"), old)
    return first_of_each(until_known(known).drop("known").select(*messages.columns).union(fresh.select(*messages.columns)))


def uids(messages: DataFrame) -> DataFrame:
    """All uids of a folder in order."""
    return messages.select("uid").orderBy("uid")


def newest_uid(messages: DataFrame) -> DataFrame:
    """One row: the newest uid, null for an empty folder."""
    return messages.agg(F.max("uid").alias("uid"))


def latest(messages: DataFrame, by: str = "folder") -> DataFrame:
    """The newest message of each folder."""
    return messages.groupBy(by).agg(F.max("uid").alias("uid"), F.coalesce(F.max_by("subject", "uid"), F.lit("")).alias("subject"), F.coalesce(F.max_by("body", "uid"), F.lit("")).alias("body"))


def message(messages: DataFrame, uid: int) -> DataFrame:
    """The message of a uid; an error when the result is read and there is none."""
    found = messages.where(F.col("uid") == uid)
    checked = found.agg(F.count("*").alias("n"), F.first(F.struct(*messages.columns)).alias("row"))
    return checked.where(F.assert_true(F.col("n") > 0, F.lit(f"no message {uid}")).isNull()).select("row.*")


def sent_folder(folders: DataFrame, name: str = "Gesendete Elemente", separator: str = "/") -> DataFrame:
    """The first folder of the name, the full name, or a path that ends in it; columns name, full_name, pos."""
    hit = (F.col("name") == name) | (F.col("full_name") == name) | F.col("full_name").endswith(separator + name) | F.col("full_name").endswith("." + name)
    found = folders.where(hit).agg(F.min_by("full_name", "pos").alias("full_name"))
    return found.where(F.assert_true(F.col("full_name").isNotNull(), F.lit(f"no folder {name}")).isNull())
