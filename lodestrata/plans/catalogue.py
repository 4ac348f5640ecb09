"""The catalogue: entity tables by model, refreshed from the files that changed, in versions that readers see whole."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.functions.text import glob_match
from lodestrata.operators import fulltext
from lodestrata.operators.relations import security_map
from lodestrata.operators.search import limited
from lodestrata.operators.stats import count_all
from lodestrata.plans.snapshots import Manifest, Snapshots
from lodestrata.session import checkpoint
from lodestrata.sources.changes import STATE, file_changes
from lodestrata.sources.entities import extract
from lodestrata.sources.labels import inline_labels, read_label_files
from lodestrata.sources.tree import PARSED, descriptors, parse_tree, read_files

SCHEMA_VERSION = 2
RUNS = "run_id string, started_utc timestamp, model string, elapsed_ms bigint, n_objects bigint, is_custom boolean"

#: Kinds in the object view: table, columns with other names, column with a source path.
OBJECT_KINDS = {
    "Table": ("tables", []), "Class": ("classes", []), "Edt": ("edts", []), "Enum": ("enums", []), "MenuItem": ("menu_items", ["object"]), "Form": ("forms", []),
    "Query": ("queries", []), "View": ("views", []), "DataEntity": ("data_entities", ["public_entity_name", "public_collection_name"]), "Report": ("reports", []),
    "Service": ("services", ["class"]), "WorkflowType": ("workflow_types", ["document_class"]), "Role": ("security_roles", []), "Duty": ("security_duties", []), "Privilege": ("security_privileges", []),
}


#: Tables that don't come from objects alone.
OTHER_SCHEMAS = {
    "models": "name string, publisher string, layer string, is_custom boolean, model string",
    "model_dependencies": "target string, model string",
    "labels": "label_file string, language string, key string, value string, model string",
    "unreadable": "source_path string, error string, model string",
    "label_postings": "id string, col string, token string, tf bigint, positions array<int>, model string",
    "label_lengths": "id string, n_words bigint, model string",
}


#: Tables that are replaced whole: they come from descriptors, and a row a model is little.
WHOLE = ("models", "model_dependencies", "descriptor_files")
#: Groups of tables in a version: what models hold, and the files they were read from.
OBJECTS, FILES = "objects", "files"


def schemas(spark: SparkSession) -> dict[str, StructType]:
    """The schema of each table, as the definitions give it for no files."""
    given = OTHER_SCHEMAS | {"files": STATE, "descriptor_files": STATE}
    return {k: v.schema for k, v in extract(spark.createDataFrame([], PARSED)).items()} | {k: StructType.fromDDL(v) for k, v in given.items()}


class Catalogue:
    """Entity tables by name, from one version of a folder (the current one by default) or given as DataFrames."""

    def __init__(self, spark: SparkSession, path: str | None = None, tables: dict[str, DataFrame] | None = None, version: int | None = None):
        self.spark, self.path, self.tables = spark, path, dict(tables or {})
        self.store = None if path is None else Snapshots(spark, path)
        self.version = None if path is None else self.store.manifest(version)

    def table(self, name: str) -> DataFrame:
        """A table that no model fills yet is empty, so the schema comes from the definitions and not from files."""
        if name not in self.tables:
            schema = schemas(self.spark)[name]
            self.tables[name] = self.store.whole(self.version, name, schema) if name in WHOLE else self.store.rows(self.version, name, schema, FILES if name == "files" else OBJECTS)
        return self.tables[name]

    def objects(self) -> DataFrame:
        """kind, name, model, alternatives, source_path of all objects."""
        parts = []
        for kind, (table, others) in OBJECT_KINDS.items():
            df = self.table(table)
            path = F.col("source_path") if "source_path" in df.columns else F.lit(None).cast("string")
            other = F.array_compact(F.array(*[F.col(c) for c in others])) if others else F.array().cast("array<string>")
            parts.append(df.select(F.lit(kind).alias("kind"), "name", "model", other.alias("alternatives"), path.alias("source_path")))
        return reduce(DataFrame.unionByName, parts)

    def security(self) -> DataFrame:
        """A view, so it can't be stale."""
        return security_map(*[self.table(t) for t in ("security_roles", "role_duties", "duty_privileges", "role_privileges", "privilege_entry_points")])

    def dependency_edges(self) -> DataFrame:
        return self.table("model_dependencies").select(F.col("model").alias("src"), F.col("target").alias("dst"))

    def labels(self) -> DataFrame:
        """The labels with their id in the full-text index."""
        return with_label_id(self.table("labels"))

    def label_index(self) -> tuple[DataFrame, DataFrame] | None:
        """Postings and lengths that refresh has written; None for a catalogue given as DataFrames without them."""
        if self.path is None and "label_postings" not in self.tables:
            return None
        return self.table("label_postings").drop("model"), self.table("label_lengths").drop("model")

    def search_label_texts(self, query: str, limit: int | None = 100, languages: list[str] | None = None) -> DataFrame:
        """Labels in these languages, best first, with their columns and score; ranks count all languages' texts."""
        labels, found = self.labels(), fulltext.match(self.labels(), "id", ["value", "key"], query, None, self.label_index())
        if languages:
            labels = labels.filter(F.lower("language").isin(*[x.lower() for x in languages]))
        return limited(labels.join(found, "id").select("id", "label_file", "language", "key", "value", "model", "score").orderBy(F.desc("score"), "id"), limit)

    def counts(self) -> DataFrame:
        return count_all({t: self.table(t) for t in sorted({t for t, _ in OBJECT_KINDS.values()})})


def with_label_id(labels: DataFrame) -> DataFrame:
    return labels.withColumn("id", F.concat_ws("/", "model", "label_file", "language", "key"))


def label_index(labels: DataFrame) -> dict[str, DataFrame]:
    """The full-text tables of labels, by model; a file's words are in order, so a look-up skips most of it."""
    postings, lengths = fulltext.index(with_label_id(labels), "id", ["value", "key"], ["model"])
    columns = [x.split()[0] for x in OTHER_SCHEMAS["label_postings"].split(", ")]
    return {"label_postings": postings.select(*columns).repartition("model").sortWithinPartitions("model", "token"), "label_lengths": lengths.select("id", "n_words", "model")}


def replace_by(existing: DataFrame, new: DataFrame, key: str, values: Column | list) -> DataFrame:
    """The rows of other key values, and the new rows."""
    gone = F.col(key).isin(values) if isinstance(values, list) else values
    return existing.filter(~gone | F.col(key).isNull()).unionByName(new)


def read_tree(spark: SparkSession, root: str, models: list[str] | None = None, languages: list[str] | None = None, custom: list[str] | None = None) -> dict[str, DataFrame]:
    """All entity tables of a source tree, with models joined to their descriptors; custom ones match the globs in `custom`."""
    parsed = checkpoint(parse_tree(spark, root, models))  # all tables come from one pass over the files
    tables = extract(parsed)
    tables["models"], tables["model_dependencies"] = described(parsed.select(F.col("model").alias("name")), *descriptors(spark, root), custom)
    tables["labels"] = read_label_files(spark, root, languages).unionByName(inline_labels(parsed))
    tables["unreadable"] = parsed.filter("error IS NOT NULL").select("model", "source_path", "error")
    return tables


def changed_models(now: DataFrame, stored: DataFrame, since: datetime.datetime | None = None, force: bool = False) -> DataFrame:
    """Models to read again: another fingerprint than the stored one, and nothing older than `since`."""
    df = now if force else now.join(stored.select("model", "fingerprint"), ["model", "fingerprint"], "left_anti")
    return df if since is None or force else df.filter(F.col("newest") >= F.lit(since))


def merge_fingerprints(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New fingerprints over stored ones; a null one keeps what is stored."""
    a, b = stored.select("model", F.col("fingerprint").alias("_old")), new.select("model", F.col("fingerprint").alias("_new"))
    return a.join(b, "model", "full").select("model", F.coalesce("_new", "_old").alias("fingerprint"))


def adopt_tables(spark: SparkSession, path: str) -> None:
    """Step to version 2: tables that lay side by side become the first version of the store; columns they lack are null."""
    store, write = Snapshots(spark, path), Snapshots.new_write()
    if store.manifest().number:
        return
    first, held = Manifest(1), set()
    for name, schema in schemas(spark).items():
        if store.exists(name):
            df = spark.read.schema(schema).parquet(f"{path}/{name}")
            held |= set() if name in WHOLE else set(_names(df))
            store.put(name, df, write, by_model=name not in WHOLE)
            if name in WHOLE:
                first.whole[name] = write
    if held:
        first.replaced(OBJECTS, held, write)
        store.commit(first)


#: What brings a store to a version; steps run in order, once.
STEPS = {2: adopt_tables}


def ensure_schema(spark: SparkSession, path: str) -> bool:
    """Bring a store to the present schema version, step by step; True if it was older or new."""
    try:
        have = spark.read.parquet(f"{path}/schema_version").agg(F.max("version")).first()[0]
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    if have is not None and have >= SCHEMA_VERSION:
        return False
    for version in range(SCHEMA_VERSION if have is None else have + 1, SCHEMA_VERSION + 1):
        if have is not None and version in STEPS:
            STEPS[version](spark, path)
        spark.sql(f"SELECT {version} AS version, current_timestamp() AS applied_utc").write.mode("append").parquet(f"{path}/schema_version")
    return True


def record_run(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, RUNS).write.mode("append").parquet(f"{path}/extraction_runs")


def described(models: DataFrame, found: DataFrame, deps: DataFrame, custom: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The tables models and model_dependencies of these models (name), joined to descriptors without regard to case."""
    info = found.groupBy(F.lower("name").alias("_n")).agg(F.min_by("publisher", F.struct("name", "publisher", "layer")).alias("publisher"), F.min_by("layer", F.struct("name", "publisher", "layer")).alias("layer"))
    own = models.select("name").distinct()
    rows = own.join(info, F.lower("name") == F.col("_n"), "left").select("name", "publisher", "layer", glob_match(F.col("name"), custom or []).alias("is_custom"), F.col("name").alias("model"))
    links = deps.withColumn("_n", F.lower("model")).drop("model").join(own.select(F.lower("name").alias("_n"), F.col("name").alias("model")), "_n")
    return rows, links.groupBy("model", F.lower("target").alias("_t")).agg(F.min("target").alias("target")).select("target", "model")


def _names(df: DataFrame) -> list[str]:
    """The models in a table; one name a model goes to the driver."""
    return sorted(r["model"] for r in df.select("model").distinct().collect())


def described_otherwise(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> list[str]:
    """The models whose row or dependencies differ."""
    both = [a.select(sorted(a.columns)).exceptAll(b.select(sorted(b.columns))) for x, y in zip(old, new, strict=True) for a, b in ((x, y), (y, x))]
    return _names(reduce(lambda a, b: a.unionByName(b.select("model")), [x.select("model") for x in both]))


def refresh(spark: SparkSession, root: str, path: str, force: bool = False, since: datetime.datetime | None = None, languages: list[str] | None = None, custom: list[str] | None = None) -> list[str]:
    """Read the models whose files changed, drop those without files, follow the descriptors; the names of all these models.

    Changes are those of files, by content (`sources.changes`); with `since` a model counts whose changed files are not
    all older, and with `force` all do. A changed descriptor touches the models that it names, and does not read their
    objects again. Models that match the globs in `custom` are marked as custom. All rows of a refresh become visible
    together, with the version that it commits; one that breaks off leaves the version before, and the next does its work.
    """
    started = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    ensure_schema(spark, path)
    have = Catalogue(spark, path)
    store, version = have.store, have.version.following()
    changes = checkpoint(file_changes(spark, root, have.table("files").unionByName(have.table("descriptor_files")), read_files))
    own = changes.filter("kind <> 'Descriptor'")
    seen = _names(own.filter("status <> 'removed'"))
    new = own.filter(F.col("status").isin("added", "changed", "removed"))
    touched = new.groupBy("model").agg(F.max("modified").alias("newest"))
    if since is not None:
        touched = touched.filter(F.col("newest") >= F.lit(since))
    todo = sorted(set(seen) if force else set(_names(touched)) & set(seen))
    gone = sorted(set(have.version.models(OBJECTS)) - set(seen))
    live = sorted((set(have.version.models(OBJECTS)) | set(todo)) - set(gone))
    info = described(spark.createDataFrame([(m,) for m in live], "name string"), *descriptors(spark, root), custom)
    info = tuple(checkpoint(x) for x in info)
    redescribed = sorted(set(described_otherwise((have.table("models"), have.table("model_dependencies")), info)) - set(gone))
    looked_at = not changes.filter("status <> 'same'").isEmpty()  # a touched file's new time is kept too
    names = sorted({*todo, *gone, *redescribed})
    if not names and not looked_at:
        return []
    write = store.new_write()
    counts: dict[str, int] = {}
    if todo:
        tables = {k: v.filter(F.col("model").isin(todo)) for k, v in read_tree(spark, root, todo, languages, custom).items() if k not in WHOLE}
        if "labels" in tables:
            tables |= label_index(tables["labels"])
        for name, df in tables.items():
            store.put(name, df, write)
    state = [c.split()[0] for c in STATE.split(", ")]
    kept = changes.filter("status <> 'removed'").select(*state, "status")
    read = [*todo, *(m for m in _names(own.filter("status = 'touched'")) if m in live and m not in todo and m not in _names(new))]
    store.put("files", kept.filter(F.col("kind") != "Descriptor").filter(F.col("model").isin(read)).drop("status"), write)
    for name, df in (("models", info[0]), ("model_dependencies", info[1]), ("descriptor_files", kept.filter("kind = 'Descriptor'").drop("status"))):
        store.put(name, df, write, by_model=False)
    version.replaced(OBJECTS, todo, write, gone)
    version.replaced(FILES, read, write, gone)
    version.whole |= dict.fromkeys(WHOLE, write)
    version.notes = {"committed": datetime.datetime.now(datetime.UTC).isoformat()}
    store.commit(version)
    ms = int((datetime.datetime.now(datetime.UTC).replace(tzinfo=None) - started).total_seconds() * 1000)
    counts = {r["model"]: r["count"] for r in own.filter(F.col("status") != "removed").filter(F.col("model").isin(todo)).groupBy("model").count().collect()}
    marked = {r["name"]: r["is_custom"] for r in info[0].select("name", "is_custom").collect()}
    if names:
        record_run(spark, path, [(f"{m}-{started.isoformat()}", started, m, ms, counts.get(m, 0), bool(marked.get(m))) for m in names])
    return names


def update_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels after keyed changes (label_file, language, key, value, new_key): a null value and new_key deletes.

    Keys are compared exactly; a change of an unknown key with a value adds it.
    """
    on = ["label_file", "language", "key"]
    c = changes.select(*on, F.col("value").alias("_value"), F.col("new_key").alias("_key"), F.lit(True).alias("_hit"))
    df = labels.join(c, on, "full").filter(F.col("_hit").isNull() | F.col("_value").isNotNull() | F.col("_key").isNotNull())
    keep = [x for x in labels.columns if x not in (*on, "value")]
    df = df.select("label_file", "language", F.coalesce("_key", "key").alias("key"), F.coalesce("_value", "value").alias("value"), *keep)
    return df.filter(F.col("value").isNotNull()).select(*labels.columns)
