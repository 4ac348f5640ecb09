"""Changes of files between two snapshots of a folder: added, changed, touched, removed and same ones.

A snapshot is a table of path, size, time and content hash. A file whose size and time are as before is the same without
a look inside; only the others are read, and one whose content is as before is merely touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "source_path string, package string, model string, kind string, size bigint, modified timestamp, hash string"
#: What `compared` says of a file.
STATUSES = ("added", "changed", "touched", "removed", "same")


def listed(files: DataFrame) -> DataFrame:
    """The files that are read at all: objects, labels and descriptors; adaptor packages and models are left out."""
    adaptor = F.lower("package").endswith("formadaptor") | F.lower("model").endswith("formadaptor")
    return files.filter(((F.col("kind").startswith("Ax")) & ~adaptor) | (F.col("kind") == "Descriptor")).withColumnRenamed("length", "size")


def compared(now: DataFrame, before: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """STATE and status of all files of both snapshots.

    now: a listing (STATE without hash); before: a snapshot (STATE). contents: source_path and hash of all files now, of
    which only those of files that look new are asked for; without it `now` has hashes itself.
    """
    old = before.select(F.col("source_path").alias("old_path"), *[F.col(c).alias(f"old_{c}") for c in ("package", "model", "kind", "size", "modified", "hash")])
    both = now.join(old, F.col("source_path") == F.col("old_path"), "full")
    alike = F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified")) & F.col("old_path").isNotNull()
    both = both.withColumn("alike", F.coalesce(alike, F.lit(False)))
    if contents is not None:
        both = both.join(contents.select(F.col("source_path").alias("hashed_path"), "hash"), (F.col("source_path") == F.col("hashed_path")) & ~F.col("alike"), "left")
    status = (
        F.when(F.col("source_path").isNull(), "removed").when(F.col("old_path").isNull(), "added").when(F.col("alike"), "same")
        .when(F.col("hash").eqNullSafe(F.col("old_hash")), "touched").otherwise("changed")
    )
    shown = [F.coalesce(c, f"old_{c}").alias(c) for c in ("package", "model", "kind", "size", "modified")]
    own_hash = F.when(F.col("alike") | F.col("source_path").isNull(), F.col("old_hash")).otherwise(F.col("hash")).alias("hash")
    return both.select(F.coalesce("source_path", "old_path").alias("source_path"), *shown, own_hash, status.alias("status"))


def file_changes(spark: SparkSession, root: str, before: DataFrame, read_files) -> DataFrame:
    """STATE and status of the files below a root against a stored snapshot.

    read_files(spark, root, glob) lists files and reads their content where it is asked for. Contents are read of files
    no older than the oldest that looks new, a filter that reaches the listing.
    """
    files = listed(read_files(spark, root).unionByName(read_files(spark, root, "*.label.txt")))
    now = files.drop("content")
    known = before.select("source_path", "size", "modified")
    first = now.join(known, ["source_path", "size", "modified"], "left_anti").agg(F.min("modified").alias("first")).first()["first"]
    if first is None:
        return compared(now.withColumn("hash", F.lit(None).cast("string")), before)
    contents = files.filter(F.col("modified") >= F.lit(first)).select("source_path", F.sha2("content", 256).alias("hash"))
    return compared(now, before, contents)
