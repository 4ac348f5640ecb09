"""What the operators of this subpackage share: tables, shared storage and small vector helpers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestrata.session import checkpoint, shared_dir

__all__ = ["checkpoint", "shared_dir"]
#: Rows of an Arrow batch. Texts may be megabytes long, so batches are short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: long texts come in short Arrow batches.

    Spark reads the setting when a plan runs, so it stays in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: compressed, and safe from lost executors; it goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def id_ranks(docs: DataFrame, id_col: str) -> DataFrame | None:
    """`_id` and `_rank`: an integer for each id that isn't one, in the same order; None where ids are integers."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return None
    ids = docs.select(F.col(f"`{id_col}`").alias("_id")).filter("_id IS NOT NULL").distinct().orderBy("_id")
    return materialise(ids.withColumn("_rank", F.monotonically_increasing_id()))  # partitions are in order, and so are rows in them


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column has them (names are compared without case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def with_number(docs: DataFrame, id_col: str, ranks: DataFrame | None, into: str, last: int) -> DataFrame:
    """The rows with an integer that orders their ids as `into`; null ids get `last`."""
    own = F.col(f"`{id_col}`")
    if ranks is None:
        return docs.withColumn(into, F.coalesce(own.cast("bigint"), F.lit(last)))
    key = free_names(docs, "_ranked_id")[0]
    joined = docs.join(ranks.select(F.col("_id").alias(key), F.col("_rank").alias(into)), own == F.col(key), "left").drop(key)
    return joined.withColumn(into, F.coalesce(into, F.lit(last)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(docs: DataFrame, run, columns: str, id_col: str, text_col: str) -> DataFrame:
    """run over pandas batches of the id and the text `t` (null: empty); it returns the id and `columns`.

    Ids travel as text, so that null and large ones come back as they were.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias(id_col), F.coalesce(text_col, F.lit("")).alias("t"))
    out = rows.mapInPandas(run, f"`{id_col}` string, {columns}")
    return out.select(F.col(id_col).cast(kind).alias(id_col), *out.columns[1:])


def map_rows(docs: DataFrame, text_col: str, change) -> DataFrame:
    """Whole rows, as Arrow batches: change(batch, texts with null as empty) gives the batch that goes on."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield change(b, [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])

    return docs.mapInArrow(run, docs.schema)


def crc_mod(col: str, n: int):
    """crc32 of an id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def groups_of(lengths, most: int):
    """Slices of consecutive rows holding about `most` units each; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit keys (fixed multipliers of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that stand in words: all but the six blanks; and letters, digits and what lies beyond ASCII.
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
ODD = np.uint64(0x9E3779B97F4A7C15)


#: 1 / ODD modulo 2^64, bytes and 1, and the powers that are multiplied to others.
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
STEP = 4096


def powers(n: int, base: np.uint64, at: np.ndarray | None = None) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64, or those at some places, from two short rows of powers."""
    low = np.r_[np.uint64(1), np.multiply.accumulate(np.full(STEP - 1, base, dtype=np.uint64))]
    high = np.r_[np.uint64(1), np.multiply.accumulate(np.full(n // STEP, pow(int(base), STEP, 1 << 64), dtype=np.uint64))]
    return (high[:, None] * low).ravel()[:n] if at is None else high[at // STEP] * low[at % STEP]


def word_hashes(texts: list[bytes], in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words of all texts, in order; a word is a run of bytes for which `in_word` holds."""
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    own = in_word[b]
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1  # words begin and end by turns, the last before the blank at the end
    if own[0]:
        edge = np.r_[0, edge]
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # a word's hash is the sum of its bytes times powers of ODD: a difference of running sums, moved back to the word's start
    sums = powers(len(b), ODD)
    sums *= PLUS_ONE[b]
    np.cumsum(sums, out=sums)
    h = sums[last - 1] - np.where(first > 0, sums[first - 1], np.uint64(0))
    h = mix64(h * powers(len(b), INVERSE, first) * ODD)
    upto = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0)), h
