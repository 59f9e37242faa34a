"""Filing of sent mail: where a project's folder is, and what the target file is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import columns as C


def resolve(numbers: DataFrame, folders: DataFrame, second: str, third: str, number: str = "number", width: int = 6) -> DataFrame:
    """Columns number and path: for each project number its target folder, or null.

    `folders` has path, parent, depth and name of every folder below the share. The first folder of depth 1 that begins with the
    number and has, somewhere below, a folder whose name contains `second` and below that first one whose letters and digits
    contain those of `third`; firsts are by path. Numbers meet depth-1 names by their first `width` characters, an equi-join.
    """
    wanted = numbers.select(number).distinct()
    top = folders.where("depth = 1").select(F.col("path").alias("d1"), F.col("name").alias("top_name"), F.substring("name", 1, width).alias("_k"))
    level1 = wanted.withColumn("_k", F.substring(number, 1, width)).join(top, "_k").where(F.startswith("top_name", number)).select(number, "d1")
    root = lambda path: F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))
    below = folders.where("depth > 1").select("path", "name", root(F.col("path")).alias("d1"))
    level2 = below.where(F.contains("name", F.lit(second))).groupBy("d1").agg(F.min("path").alias("d2"))
    target = below.where(C.folder_key(F.col("name")).contains(C.folder_key(F.lit(third)))).select("d1", "path")
    level3 = target.join(level2, "d1").where(F.startswith("path", F.concat("d2", F.lit("/")))).groupBy("d1").agg(F.min("path").alias("d3"))
    found = level1.join(level3, "d1").groupBy(number).agg(F.min_by("d3", "d1").alias("path"))
    return wanted.join(found, number, "left")


def destination(folder: Column, name: Column) -> Column:
    """Path of the file in the folder, or null if the name is not a plain file name."""
    return F.concat(folder, F.lit("/"), C.safe_file_name(name), F.lit(".eml"))


def store_status(mounted: Column, source: Column, folder: Column, name: Column, copied: Column) -> Column:
    """State of a store request; the first that applies."""
    return (
        F.when(~mounted, F.lit("ShareUnavailable"))
        .when(~source, F.lit("SourceNotFound"))
        .when(folder.isNull(), F.lit("DestinationNotFound"))
        .when(C.safe_file_name(name).isNull(), F.lit("InvalidTargetFileName"))
        .when(~copied, F.lit("CopyFailed"))
        .otherwise(F.lit("Success"))
    )


def file_name(response: Column, shortened: Column | None = None, most: int = 60) -> Column:
    """target_file_name of a classifier's JSON; if longer than `most` the shortened one, else cut; `unknown` without one."""
    name = C.blank_to_null(F.get_json_object(F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)\{.*\}", 0), "$.target_file_name"))
    short = C.blank_to_null(shortened) if shortened is not None else F.lit(None).cast("string")
    long = F.when((F.length(short) <= most), short).otherwise(F.rtrim(F.left(name, F.lit(most))))
    return F.when(name.isNull(), F.lit("unknown")).when(F.length(name) <= most, name).otherwise(long)
