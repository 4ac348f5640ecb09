"""Label files: <File>.<language>.label.txt with key=value lines, and labels inside XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import key_value

DEFAULT_LANGUAGE = "en-us"


def label_rows(text: DataFrame, keep_path: bool = False) -> DataFrame:
    """model, label_file, language, key, value (and source_path) of lines (`line`, `path`); blank and `;` lines are skipped, a value may hold `=`, a mark at the start is dropped."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.label\.txt$", "")
    line = F.regexp_replace(F.ltrim(F.regexp_replace("line", "^\ufeff", "")), "\r$", "")
    key, value = key_value(F.col("line"))
    df = text.select(F.regexp_extract("path", r"/([^/]+)/AxLabelFile/", 1).alias("model"), F.regexp_extract(name, r"^(.*?)\.[^.]*$", 1).alias("label_file"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("language"), line.alias("line"), F.col("path").alias("source_path"))
    own = ["model", "label_file", "language", *(["source_path"] if keep_path else [])]
    return df.filter((F.col("line") != "") & ~F.col("line").startswith(";")).select(*own, F.trim(key).alias("key"), value.alias("value")).filter("key <> ''")


def read_label_files(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """The labels of all label files below a root, or those in some languages."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.label.txt").text(root).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    df = label_rows(text)
    return df if not languages else df.filter(F.lower("language").isin(*[x.lower() for x in languages]))


def inline_labels(parsed: DataFrame) -> DataFrame:
    """Labels held by label objects of a parsed tree."""
    own = parsed.filter(F.col("root").startswith("AxLabel") & F.col("props").getItem("Key").isNotNull())
    p = lambda k: F.col("props").getItem(k)
    return own.select("model", F.coalesce(p("LabelFile"), p("Name")).alias("label_file"), F.coalesce(p("Language"), F.lit(DEFAULT_LANGUAGE)).alias("language"), p("Key").alias("key"), F.coalesce(p("Value"), p("Text")).alias("value"))
