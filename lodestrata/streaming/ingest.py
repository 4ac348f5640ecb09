"""Streaming ingest: label files as they arrive, and source trees whose files are added, edited, emptied and removed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestrata.plans.snapshots import Snapshots
from lodestrata.session import checkpoint
from lodestrata.sources.changes import STATE, file_changes
from lodestrata.sources.labels import label_rows
from lodestrata.sources.tree import PARSED, parse_files, read_files


def label_stream(spark: SparkSession, root: str) -> DataFrame:
    """model, label_file, language, key, value of new `.label.txt` files below a root."""
    text = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.label.txt").text(root)
    return label_rows(text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")))


def ingest_available(spark: SparkSession, root: str, target: str, checkpoint: str) -> None:
    """Take in all files not seen yet and stop; files of a batch replace their model's label file and language."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "label_file", "language").parquet(target)

    label_stream(spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---------------------------------------------------------------- a tree whose files change

#: What the log of a tree holds: a file's state, what became of it, the number of the look that saw it, its content.
LOG = f"{STATE}, status string, seq bigint, content binary"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
LABELS = "label_file string, language string, key string, value string, source_path string, model string"


def log_changes(spark: SparkSession, root: str, log: str) -> int:
    """Append what changed below a root since the last look, with the contents of new and changed files; the look's number, or 0.

    A file source never gives a path twice, so edits and removals reach a stream as rows of this log.
    """
    try:
        seen = spark.read.schema(LOG).parquet(log)
        last = seen.agg(F.max("seq")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen, last = spark.createDataFrame([], LOG), 0
    newest = seen.groupBy("source_path").agg(F.max_by(F.struct(*[F.col(c) for c in COLUMNS if c not in ("source_path", "content", "seq")]), "seq").alias("s")).select("source_path", "s.*")
    before = newest.filter("status <> 'removed'").drop("status")
    changes = checkpoint(file_changes(spark, root, before, read_files).filter("status <> 'same' AND kind <> 'Descriptor'"))
    first = changes.filter(F.col("status").isin("added", "changed")).agg(F.min("modified").alias("first")).first()["first"]
    if changes.isEmpty():
        return 0
    found = read_files(spark, root).unionByName(read_files(spark, root, "*.label.txt")).filter(F.col("modified") >= F.lit(first)).select("source_path", "content")
    held = F.when(F.col("status").isin("added", "changed"), F.col("content"))
    rows = changes.join(found, "source_path", "left").withColumn("seq", F.lit(last + 1).cast("bigint")).withColumn("content", held)
    rows.select(*COLUMNS).write.mode("append").parquet(log)
    return last + 1


def latest_versions(stream: DataFrame) -> DataFrame:
    """Of a stream of log rows, those that are newer than all rows of their path before; the state holds a number and a hash a path."""

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, held = state.get if state.exists else (0, None)
        best = None
        for b in batches:
            row = b.loc[[b["seq"].idxmax()]]
            if int(row["seq"].iloc[0]) > seq:
                best, seq = row, int(row["seq"].iloc[0])
        if best is None:
            return
        now = None if best["status"].iloc[0] == "removed" else best["hash"].iloc[0]
        state.update((seq, now))
        if now != held or best["status"].iloc[0] != "touched":
            yield best[COLUMNS]

    return stream.groupBy("source_path").applyInPandasWithState(newest, LOG, "seq bigint, hash string", "append", GroupStateTimeout.NoTimeout)


def put_versions(spark: SparkSession, target: str, batch: DataFrame, batch_id: int) -> None:
    """One version of the store in which the batch's files replace what it held of their paths; a batch that is given again does nothing."""
    store = Snapshots(spark, target)
    have = store.manifest()
    if int(have.notes.get("batch", -1)) >= batch_id:
        return
    rows = checkpoint(batch)
    models = sorted(r["model"] for r in rows.select("model").distinct().collect())
    if not models:
        return
    lines = rows.filter("content IS NOT NULL AND source_path LIKE '%.label.txt'").select(F.col("source_path").alias("path"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    new = {"parsed": parse_files(rows.filter("content IS NOT NULL AND source_path LIKE '%.xml'")), "labels": label_rows(lines, keep_path=True)}
    version, write = have.following(), store.new_write()
    for name, df in new.items():
        schema = StructType.fromDDL({"parsed": PARSED, "labels": LABELS}[name])
        kept = store.rows(have, name, schema, "objects").filter(F.col("model").isin(models)).join(rows.select("source_path"), "source_path", "left_anti")
        store.put(name, kept.select(*schema.names).unionByName(df.select(*schema.names)), write)
    version.replaced("objects", models, write)
    version.notes = {"batch": str(batch_id)}
    store.commit(version)


def ingest_tree(spark: SparkSession, root: str, target: str, log: str, checkpoint_dir: str) -> int:
    """Take in what changed below a root and stop: the tables `parsed` and `labels` of the store follow its files; the look's number, or 0.

    Each look is a batch of its own or part of one, and what breaks off is done by the next call: the log keeps the rows,
    the stream its place and state, the store the number of its last batch.
    """
    number = log_changes(spark, root, log)
    try:
        rows = spark.readStream.schema(LOG).parquet(log)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    query = latest_versions(rows).writeStream.foreachBatch(lambda b, i: put_versions(spark, target, b, i)).outputMode("append")
    query.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
    return number


def tree_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """`parsed` or `labels` as the current version has it."""
    store = Snapshots(spark, target)
    return store.rows(store.manifest(), name, StructType.fromDDL({"parsed": PARSED, "labels": LABELS}[name]), "objects")
