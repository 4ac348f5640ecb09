"""Searches over object kinds: optional filters, total orders under limits, bulk forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci
from lodestrata.session import materialise


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """A negative or missing limit keeps all rows."""
    return df if limit is None or limit < 0 else df.limit(limit)


def search(objects: DataFrame, query: str, on: list[str], owner: DataFrame | None = None, owner_key: str | None = None, own_key: str | None = None,
           model_col: str = "model", model: str | None = None, limit: int | None = 50, order: list[str] | None = None) -> DataFrame:
    """Objects with the query in any of the `on` columns, joined to their owner, in a total order."""
    hit = reduce(Column.__or__, [contains_ci(F.col(c), query) for c in on])
    df = objects.filter(hit)
    if owner is not None:
        df = df.join(owner, df[own_key or owner_key] == owner[owner_key])
    if model is not None:
        df = df.filter(F.col(model_col) == model)
    return limited(df.orderBy(*(order or on)), limit)


def search_kind(catalogue, kind: str, query: str, model: str | None = None, limit: int = 50) -> DataFrame:
    """Search one kind of the catalogue by its names; entities and workflow types have more than one."""
    names = {"data_entities": ["name", "public_entity_name", "public_collection_name"], "workflow_types": ["name", "document_class"]}.get(kind, ["name"])
    return search(catalogue.table(kind), query, names, model=model, limit=limit, order=["name", "model"])


def search_labels(labels: DataFrame, query: str, languages: list[str] | None = None, on: tuple[str, ...] = ("value", "key"), lang_col: str = "language",
                  order: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Labels with the query in a value or key, in any of the languages."""
    df = labels.filter(reduce(Column.__or__, [contains_ci(F.col(c), query) for c in on]))
    if languages:
        df = df.filter(F.lower(lang_col).isin(*[x.lower() for x in languages]))
    first = order or [*on, lang_col]
    return limited(df.orderBy(*first, *[c for c in df.columns if c not in first]), limit)


def usages(branches: list[tuple[str, DataFrame, Column, Column, list[Column]]], needle: str, limit: int | None = 100) -> DataFrame:
    """All kinds in one list. A branch: kind, table, name, model, columns to search."""
    parts = [df.filter(reduce(Column.__or__, [contains_ci(c, needle) for c in on])).select(F.lit(kind).alias("kind"), name.alias("name"), model.alias("model")) for kind, df, name, model, on in branches]
    return limited(reduce(DataFrame.unionByName, parts).orderBy("name", "kind", "model"), limit)


def find_usages(objects: DataFrame, needle: str, limit: int | None = 100) -> DataFrame:
    """Usages over the catalogue's object view (kind, name, model, alternatives)."""
    hit = contains_ci(F.col("name"), needle) | F.coalesce(F.exists("alternatives", lambda a: contains_ci(a, needle)), F.lit(False))
    return limited(objects.filter(hit).select("kind", "name", "model").orderBy("name", "kind", "model"), limit)


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


#: Needles that are checked against each name where it is read, and those that are sent whole to tasks; more of them are shuffled.
FEW_NEEDLES, SENT_NEEDLES = 200, 100_000


def batch_search(objects: DataFrame, needles: DataFrame, name_col: str = "name", few: int = FEW_NEEDLES, sent: int = SENT_NEEDLES) -> DataFrame:
    """Hits of each needle by plain containment without regard to case; needles without a hit have 0.

    A few needles are tested in one pass over the objects. More (a table of them) meet the distinct names by their first
    three characters: a name is listed under each string of up to three characters that it holds. Lists are many times the
    names, which Spark's estimate does not know, so the join is named here: they are never the side that is sent whole.
    """
    needles = needles.select(F.col(needles.columns[0]).alias("needle")).distinct()
    rows = [r[0] for r in needles.limit(few + 1).collect()]  # bounded by `few`
    name = F.lower(name_col)
    if len(rows) <= few:
        hit = F.array_compact(F.array(*[F.when(F.contains(name, F.lower(F.lit(n))), F.lit(n)) for n in rows]))
        counts = objects.select(F.explode(hit).alias("needle")).groupBy("needle").agg(F.count("*").alias("hits"))
    else:
        needles = materialise(needles)
        names = objects.groupBy(name.alias("_name")).agg(F.count("*").alias("_times")).filter("_name IS NOT NULL")
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_name") - (n - 1), F.lit(1))), lambda i: F.substr("_name", i, F.lit(n)))
        listed = names.select("_name", "_times", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[cut(n) for n in (1, 2, 3)]))).alias("_start"))
        wanted = needles.withColumn("_low", F.lower("needle")).withColumn("_start", F.substring("_low", 1, 3))
        wanted = wanted.hint("broadcast" if needles.count() <= sent else "merge")
        found = listed.join(wanted, "_start").filter(F.contains("_name", "_low"))
        counts = found.groupBy("needle").agg(F.sum("_times").alias("hits"))
    return needles.join(counts, "needle", "left").select("needle", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def source_paths(objects: DataFrame, model: str | None = None) -> DataFrame:
    df = objects.filter((F.coalesce("source_path", F.lit("")) != ""))
    return (df if model is None else df.filter(F.col("model") == model)).select("kind", "name", "model", "source_path")


def resolve_token(labels: DataFrame, tokens: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Labels for tokens like @SYS123: the file is the letters and the key the token or its digits, or the key is the token."""
    pre, suf = F.regexp_extract("token", r"^@?([A-Za-z]*)", 1), F.regexp_extract("token", r"^@?[A-Za-z]*(.*)$", 1)
    t = tokens.select("token", F.regexp_replace("token", "^@", "").alias("raw"), pre.alias("pre"), suf.alias("suf"))
    if languages:
        labels = labels.filter(F.lower("language").isin(*[x.lower() for x in languages]))
    by_key = t.join(labels, t["raw"] == labels["key"])
    by_file = t.join(labels, (t["pre"] == labels["label_file"]) & (t["suf"] == labels["key"]))
    return by_key.unionByName(by_file).select("token", *labels.columns).distinct().orderBy("token", "label_file", "language", "key")
