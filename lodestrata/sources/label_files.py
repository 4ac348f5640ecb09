"""Label files as a sink: keyed changes of many files at once, with comments, blank lines and their order kept.

A change names a file (path below a root) and a key. With a value it sets it, with a new key it renames the key, and with
neither it deletes it. All changes are judged against the files as they were. Files are rewritten as a whole by tasks,
each beside the one it replaces, and the driver's commit renames them into place (the file before stays as `.bak`). A
write that is aborted leaves all files as they were; readers see a file before or after a change, never a part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestrata.session import checkpoint

#: What becomes of a change.
OUTCOMES = ("Created", "Updated", "Renamed", "Deleted", "NoChange", "KeyExists", "KeyMissing", "FileMissing", "Superseded", "Invalid")
DONE = ("Created", "Updated", "Renamed", "Deleted")
#: What a label file begins with.
MARK = b"\xef\xbb\xbf"


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written, each with the path it is for."""

    files: list[tuple[str, str]]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class LabelFileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[Row]) -> Staged:
        """One file at a time, as rows of a path follow each other; a null line only asks for its file."""
        fs, base = file_system(self.root)
        files, out, at = [], None, None
        try:
            for path, line in iterator:
                if path != at:
                    if out is not None:
                        out.close()
                    at, final = path, f"{base}/{path}"
                    folder, _, name = final.rpartition("/")
                    fs.create_dir(folder, recursive=True)
                    files.append((f"{folder}/.{name}.{uuid.uuid4().hex}.tmp", final))
                    out = fs.open_output_stream(files[-1][0])
                    out.write(MARK)
                if line is not None:
                    out.write(f"{line}\n".encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            self.remove(files)
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileType

        fs, _ = file_system(self.root)
        for staged, final in [f for m in messages if m for f in m.files]:
            if fs.get_file_info(final).type == FileType.File:
                fs.copy_file(final, f"{final}.bak")
            fs.move(staged, final)

    def abort(self, messages: list[Staged | None]) -> None:
        self.remove([f for m in messages if m for f in m.files])

    def remove(self, files: list[tuple[str, str]]) -> None:
        from pyarrow.fs import FileType

        fs, _ = file_system(self.root)
        for staged, _ in files:
            if fs.get_file_info(staged).type == FileType.File:
                fs.delete_file(staged)


class LabelFiles(DataSource):
    """Rows (path, line), those of a path together and in order; the option `path` names the root."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "path string, line string"

    def writer(self, schema, overwrite: bool) -> LabelFileWriter:
        return LabelFileWriter(self.options["path"])


def write_lines(lines: DataFrame, root: str) -> None:
    """Write label files from their lines (path, n, line), ordered by n; a null line only asks for its file."""
    lines.sparkSession.dataSource.register(LabelFiles)
    own = lines.repartition("path").sortWithinPartitions("path", "n").select("path", "line")
    own.write.format("label_files").mode("append").option("path", root).save()


def file_lines(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), n, line, and the key and value of lines that have one, of all label files."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.label.txt").load(root)
    path = F.expr("substring(path, instr(path, top) + length(top) + 1)")
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""), "\r\n|\r", "\n")
    rows = files.withColumn("top", F.lit(top)).select(path.alias("path"), F.regexp_replace(text, "\n$", "").alias("text"))
    lines = rows.select("path", F.posexplode(F.when(F.col("text") == "", F.array(F.lit(None).cast("string"))).otherwise(F.split("text", "\n"))).alias("n", "line"))
    line = F.ltrim("line")
    held = ~line.startswith(";") & (F.instr(line, "=") > 1)
    at = F.instr(line, "=")
    return lines.select("path", F.col("n").cast("bigint").alias("n"), "line", F.when(held, F.rtrim(F.substring(line, F.lit(1), at - 1))).alias("key"), F.when(held, F.substring(line, at + 1, F.length(line))).alias("value"))


def judged(lines: DataFrame, changes: DataFrame, overwrite: bool) -> DataFrame:
    """The changes (change_id, path, key, value, new_key) with old_value and outcome, and the last key each would give."""
    first = lines.filter("key IS NOT NULL").groupBy("path", "key").agg(F.min_by("value", "n").alias("old_value"))
    known = lines.select("path").distinct().withColumn("is_file", F.lit(True))
    target = first.select("path", F.col("key").alias("new_key"), F.lit(True).alias("is_target"))
    last = F.row_number().over(Window.partitionBy("path", "key").orderBy(F.desc("change_id"))) == 1
    c = changes.select("change_id", "path", "key", "value", "new_key", last.alias("is_last"))
    c = c.join(first.withColumn("is_key", F.lit(True)), ["path", "key"], "left").join(target, ["path", "new_key"], "left").join(known, "path", "left")
    bad = lambda x: (F.trim(x) == "") | F.contains(F.col(x), F.lit("=")) | F.rlike(F.col(x), F.lit(r"[\r\n]|^\s*;|^\s|\s$"))
    invalid = F.col("path").isNull() | F.col("key").isNull() | ((F.col("value").isNotNull() | F.col("new_key").isNotNull()) & bad("key") & ~F.coalesce("is_key", F.lit(False))) | F.coalesce(bad("new_key"), F.lit(False))
    no_file, no_key = F.when(F.col("is_file").isNull(), "FileMissing"), F.col("is_key").isNull()
    renamed = no_file.when(no_key, "KeyMissing").when(F.col("key") == F.col("new_key"), "NoChange").when(F.col("is_target") & ~F.lit(overwrite), "KeyExists").otherwise("Renamed")
    put = F.when(no_key, "Created").otherwise("Updated" if overwrite else "KeyExists")
    outcome = (
        F.when(invalid, "Invalid").when(~F.col("is_last"), "Superseded").when(F.col("new_key").isNotNull(), renamed)
        .when(F.col("value").isNotNull(), put).otherwise(no_file.when(no_key, "KeyMissing").otherwise("Deleted"))
    )
    df = c.withColumn("outcome", outcome).withColumn("gives", F.when(F.col("outcome").isin("Created", "Updated", "Renamed"), F.coalesce("new_key", "key")))
    one = F.row_number().over(Window.partitionBy("path", "gives").orderBy("change_id")) == 1
    return df.withColumn("outcome", F.when(F.col("gives").isNull() | one, F.col("outcome")).otherwise("KeyExists")).select("change_id", "path", "key", "new_key", "value", "old_value", "outcome")


def changed_lines(lines: DataFrame, results: DataFrame) -> DataFrame:
    """path, n and line of the files that done changes touch, as they become."""
    done = results.filter(F.col("outcome").isin(*DONE))
    touched = done.select("path").distinct()
    # a null line and a key in a file: the first line of the key is the one that a change means
    is_first = F.col("key").isNotNull() & (F.row_number().over(Window.partitionBy("path", "key").orderBy("n")) == 1)
    own = lines.join(touched, "path", "left_semi").withColumn("at", F.when(is_first, F.col("key")))
    by_key = done.filter("outcome <> 'Created'").select("path", F.col("key").alias("at"), F.col("new_key").alias("to"), F.regexp_replace("value", "\r\n|\r|\n", r"\\n").alias("text"), "outcome")
    replaced = done.filter("outcome = 'Renamed'").select("path", F.col("new_key").alias("at"), F.lit(True).alias("is_replaced")).distinct()
    own = own.join(by_key, ["path", "at"], "left").join(replaced, ["path", "at"], "left")
    own = own.filter(F.coalesce(F.col("outcome") != "Deleted", F.col("is_replaced").isNull()))
    line = F.when(F.col("outcome") == "Updated", F.concat("at", F.lit("="), "text")).when(F.col("outcome") == "Renamed", F.concat("to", F.lit("="), "value")).otherwise(F.col("line"))
    kept = own.select("path", "n", line.alias("line"))
    after = done.filter("outcome = 'Created'").select("path", (F.lit(1 << 40) + F.row_number().over(Window.partitionBy("path").orderBy("change_id"))).cast("bigint").alias("n"), F.concat("key", F.lit("="), F.regexp_replace("value", "\r\n|\r|\n", r"\\n")).alias("line"))
    asked = touched.select("path", F.lit(-1).cast("bigint").alias("n"), F.lit(None).cast("string").alias("line"))
    return asked.unionByName(kept).unionByName(after)


def change_label_files(spark: SparkSession, root: str, changes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Apply changes (change_id, path, key, value, new_key) to the label files below a root; each change with its outcome.

    Of changes of one key of a file the last by change_id counts (`Superseded`), and of those that would give one key the
    first (`KeyExists`). Without `overwrite` keys that exist are left (`KeyExists`); with it a renamed key takes the place
    of one that exists. Of a key that a file holds twice its first line is meant. Line ends in a value become `\\n`.
    Null or blank keys, and new ones with `=`, are `Invalid`. A file that isn't there is created by the first key set in
    it. Files that no change touches are not written; no changes give no rows.
    """
    lines = file_lines(spark, root)
    results = checkpoint(judged(lines, changes, overwrite))
    if not results.filter(F.col("outcome").isin(*DONE)).isEmpty():
        write_lines(changed_lines(lines, results), root)
    return results
