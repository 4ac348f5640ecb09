"""Counts over the catalogue, rankings by children, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_all(tables: dict[str, DataFrame]) -> DataFrame:
    """The number of rows of each table, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def counts_per_owner(owners: DataFrame, key: str, label: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Owners with the count of each child table; children are counted before the join."""
    df = owners.select(key, label)
    for name, (child, child_key) in children.items():
        n = child.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
        df = df.join(n, df[key] == n["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
    return df.select(label, *children)


def top_by_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, counted: str, limit: int = 10, name: str = "k", within: list[str] | None = None) -> DataFrame:
    """Parents with most children; a parent without any counts 0. `within`: columns of both that belong to the key."""
    also = within or []
    n = children.groupBy(F.col(child_key).alias(key), *also).agg(F.count(counted).alias(name))
    return parents.select(key, *also).join(n, [key, *also], "left").select(key, *also, F.coalesce(name, F.lit(0)).alias(name)).orderBy(F.desc(name), key, *also).limit(limit)


def top_groups(df: DataFrame, key: str, limit: int = 10, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(limit)


def history(runs: DataFrame, filters: dict | None = None, newest: str = "started_utc", limit: int = 200, columns: list[str] | None = None) -> DataFrame:
    for c, v in (filters or {}).items():
        runs = runs.filter(F.col(c) == v)
    shown = columns or runs.columns
    return runs.orderBy(F.desc(newest), *[c for c in shown if c != newest]).select(*shown).limit(limit)


def fingerprints(files: DataFrame, key: str, stamp: str, name: str = "fp") -> DataFrame:
    """Number and newest stamp of each group's files, as `count:stamp`."""
    return files.groupBy(key).agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.max(stamp).cast("string")).alias(name))


def dedupe_ci(df: DataFrame, col: str) -> DataFrame:
    """Distinct values without regard to case: the folded value, the least spelling, the number of rows."""
    return df.groupBy(F.lower(col).alias(col)).agg(F.min(F.col(col)).alias("keep"), F.count("*").alias("n"))
