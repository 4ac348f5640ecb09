"""Extensions, handlers, form patterns, the security closure, cross references and source scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from lodestrata.operators.details import first_child
from lodestrata.operators.search import limited

# Kinds of cross references by number.
XREF_KINDS = {0: "Declaration", 1: "Set", 2: "Read", 3: "Call", 4: "Reference", 5: "Type", 6: "Extends", 7: "Implements"}


def coc_extensions(coc: DataFrame, target: str, method: str | None = None) -> DataFrame:
    df = coc.filter(F.col("target_class") == target)
    return (df if method is None else df.filter(F.col("target_method") == method)).orderBy("target_method", "extension_class", "model")


def object_extensions(extensions: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    df = extensions.filter(F.col("target_name") == target)
    return (df if kind is None else df.filter(F.col("kind") == kind)).orderBy("kind", "extension_name", "model")


def event_subscribers(subscribers: DataFrame, source: str, kind: str | None = None) -> DataFrame:
    df = subscribers.filter(F.col("source_object") == source)
    return (df if kind is None else df.filter(F.col("source_kind") == kind)).orderBy("subscriber_class", "subscriber_method", "model", "source_kind", "source_member", "event_type")


def with_first_child(parents: DataFrame, children: DataFrame, key: str | list[str], child_key: str | list[str], order: list[str], value: str, name: str, count: str) -> DataFrame:
    """Parents with a value of their first child and the number of children (0 without any); a key may have several columns."""
    keys, own = ([k] if isinstance(k, str) else k for k in (key, child_key))
    one = first_child(children, own, order).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(own)], F.col(value).alias(name), F.col("child_count"))
    on = [parents[k] == F.col(f"_k{i}") for i, k in enumerate(keys)]
    found = parents.join(one, on, "left").withColumn(count, F.coalesce("child_count", F.lit(0)).cast("bigint"))
    return found.drop("child_count", *[f"_k{i}" for i in range(len(keys))])


def having_child(parents: DataFrame, children: DataFrame, key: str | list[str], child_key: str | list[str]) -> DataFrame:
    keys, own = ([k] if isinstance(k, str) else k for k in (key, child_key))
    return parents.join(children.select(*[F.col(c).alias(k) for c, k in zip(own, keys, strict=True)]), keys, "left_semi")


def form_patterns(forms: DataFrame, data_sources: DataFrame, pattern: str | None = None, table: str | None = None, model: str | None = None, limit: int | None = 50) -> DataFrame:
    """Forms by pattern prefix, a table among their data sources and model; with first table and number of sources."""
    df = forms
    if pattern is not None:
        df = df.filter(F.col("pattern").startswith(pattern))
    if model is not None:
        df = df.filter(F.col("model") == model)
    if table is not None:
        df = having_child(df, data_sources.filter(F.col("table_name") == table), ["name", "model"], ["form", "model"])
    df = with_first_child(df, data_sources, ["name", "model"], ["form", "model"], ["order_index", "name"], "table_name", "primary_table", "data_source_count")
    return limited(df.orderBy("name", "model"), limit)


def histogram(df: DataFrame, col: str, none: str = "(none)", blank: str = "", name: str = "pattern", count: str = "cnt") -> DataFrame:
    """Counts by value; null and blank share one row."""
    return df.groupBy(F.coalesce(F.nullif(F.col(col), F.lit(blank)), F.lit(none)).alias(name)).agg(F.count("*").alias(count))


def similar_forms(forms: DataFrame, reference: str | None = None, key: str = "name", on: tuple[str, ...] = ("pattern", "primary_table"), limit: int | None = None) -> DataFrame:
    """Pairs (ref, peer) that agree in all `on` columns; never an object with itself, and that before any limit."""
    a = forms.filter(F.col(key) == reference) if reference is not None else forms
    a, b = a.select(F.col(key).alias("ref"), *on), forms.select(F.col(key).alias("peer"), *on)
    return limited(a.join(b, list(on)).filter("ref <> peer").select("ref", "peer").orderBy("ref", "peer") if limit is not None else a.join(b, list(on)).filter("ref <> peer").select("ref", "peer"), limit)


def security_map(roles: DataFrame, role_duties: DataFrame, duty_privileges: DataFrame, role_privileges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Roles flattened to entry points, through duties and directly (no duty); privileges without entry point stay."""
    r, e = roles.select(F.col("name").alias("role")), entry_points.select("privilege", "object_name", "object_type", "access_level")
    by_duty = r.join(role_duties, "role").join(duty_privileges, "duty").select("role", "duty", "privilege")
    direct = r.join(role_privileges, "role").select("role", F.lit(None).cast("string").alias("duty"), "privilege")
    return by_duty.unionByName(direct).join(e, "privilege", "left").select("role", "duty", "privilege", "object_name", "object_type", "access_level")


def security_coverage(closure: DataFrame, name: str, kind: str) -> DataFrame:
    hit = (F.lower("object_name") == name.lower()) & (F.lower("object_type") == kind.lower())
    return closure.filter(hit).orderBy("role", "duty", "privilege")


def cross_references(references: DataFrame, names: DataFrame, modules: DataFrame, symbol: str, kind: str | None = None, limit: int = 200) -> DataFrame:
    """References to a symbol's path, below it, or with it as a later part; the kind counts before the limit."""
    s = symbol.strip("/")
    tgt = names.select(F.col("id").alias("target_id"), F.col("path").alias("target"))
    tgt = tgt.filter((F.col("target") == f"/{s}") | F.col("target").startswith(f"/{s}/") | F.col("target").contains(f"/{s}"))
    src = names.select(F.col("id").alias("source_id"), F.col("path").alias("source"), "module_id")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in XREF_KINDS.items() for x in kv]), F.col("kind").cast("int")), F.concat(F.lit("Kind"), F.col("kind").cast("string")))
    df = references.join(tgt, "target_id").join(src, "source_id").join(modules.select(F.col("id").alias("module_id"), "module"), "module_id", "left").withColumn("kind_label", label)
    if kind:
        df = df.filter(F.lower("kind_label") == kind.lower())
    df = df.select("source", "target", F.col("kind_label").alias("kind"), F.col("kind").alias("kind_id"), "line", "column", F.coalesce("module", F.lit("")).alias("module"))
    return df.orderBy("source", "target", "line", "column", "kind_id").limit(min(limit if limit > 0 else 200, 1000))


def source_references(methods: DataFrame, name: str, body: str = "source", samples: int = 3, regex: bool = False) -> DataFrame:
    """Method bodies that hold a word, without regard to case, with the first lines where it stands."""
    import re

    pattern = "(?i)" + (name if regex else rf"\b{re.escape(name)}\b")
    rows = F.filter(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: x.rlike(pattern))
    return methods.filter(F.col(body).rlike(pattern)).withColumn("sample_lines", F.transform(F.slice(rows, 1, samples), lambda x: F.trim(x))).drop(body)


def identifier_postings(methods: DataFrame, body: str = "source", samples: int = 3) -> DataFrame:
    """token, the columns of `methods` but the body, sample_lines: a row for each distinct word of each body, lower-cased.

    Written once and sorted by token, it answers any number of `source_references` by an equi-join.
    """
    own = [c for c in methods.columns if c != body]
    lines = methods.select(*own, F.xxhash64(F.col(body)).alias("_body"), F.posexplode(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n")).alias("_n", "_line"))
    words = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_line"), F.lit(r"\w+"), F.lit(0)))).alias("token"))
    first = F.slice(F.array_sort(F.collect_set(F.struct("_n", "_line"))), 1, samples)
    found = words.groupBy("token", *own, "_body").agg(first.alias("_lines"))
    return found.select("token", *own, F.transform("_lines", lambda x: F.trim(x["_line"])).alias("sample_lines"))


def references_of(postings: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """The bodies that hold each of many names as a word, without regard to case: the name as `searched`, and the posting's columns."""
    asked = names.select(F.col(name_col).alias("searched")).dropna().distinct().withColumn("token", F.lower("searched"))
    return asked.join(postings, "token").drop("token")


# The strategy for the first kind of extension that is there, in this order.
STRATEGIES = (("coc", "coc"), ("handlers", "handler"), ("extensions", "extension"))


def strategy(counts: dict[str, Column]) -> Column:
    out: Column = F.lit("none")
    for key, name in reversed(STRATEGIES):
        out = F.when(counts[key] > 0, name).otherwise(out)
    return out


def extension_points(targets: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """Targets with the number of rows that each table (one column: the target's key) has for them, and the strategy."""
    df = targets
    for name, rows in counts.items():
        n = rows.toDF("_k").groupBy("_k").agg(F.count("*").alias(name))
        df = df.join(n, df[key] == n["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return df.withColumn("strategy", strategy({k: F.col(k) for k in counts}))


TOKEN = r"@[A-Za-z]+\d+"


def label_texts(labels: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(token, text) of labels; of several languages the first of the list wins."""
    rank = F.lit(0)
    if languages:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(x.lower()) for x in languages]), F.lower("language")), F.lit(0))
        labels = labels.filter(F.lower("language").isin(*[x.lower() for x in languages]))
    best = F.min(F.struct(rank.alias("r"), F.col("language"), F.col("label_file"), F.col("value")))
    return labels.groupBy(F.concat(F.lit("@"), F.regexp_replace("key", "^@", "")).alias("token")).agg(best.alias("v")).select("token", F.col("v.value").alias("text"))


def inlined(text: Column, known: Column) -> Column:
    """A text whose tokens that the map `known` has are followed by nothing else: `label [[@SYS1]]`; null stays null."""
    parts = F.arrays_zip(F.split(text, TOKEN, -1).alias("a"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("b"))
    shown = F.transform(parts, lambda x: F.concat(F.coalesce(x["a"], F.lit("")), F.when(x["b"].isNull(), "").otherwise(
        F.coalesce(F.concat(F.element_at(known, x["b"]), F.lit(" [["), x["b"], F.lit("]]")), x["b"]))))
    return F.when(text.isNotNull(), F.array_join(shown, ""))


def with_known(rows: DataFrame, tokens: Column, labels: DataFrame, key: str, languages: list[str] | None = None) -> DataFrame:
    """Rows with the map `_known` from those of their tokens that are labels to the labels' texts; all are looked up at once."""
    found = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token")).distinct().join(label_texts(labels, languages), "token")
    packed = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "text"))).alias("_known"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.join(packed, key, "left").withColumn("_known", F.coalesce("_known", none))


def rewritten(value: Column, kind: DataType, change) -> Column:
    """A value of any nesting with change(string) in place of every string; keys of maps stay."""
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, change)) if holds_text(kind.elementType) else value
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, change)) if holds_text(kind.valueType) else value
    if isinstance(kind, StructType) and holds_text(kind):
        return F.when(value.isNotNull(), F.struct(*[rewritten(value[f.name], f.dataType, change).alias(f.name) for f in kind.fields]))
    return value


def holds_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_text(f.dataType) for f in kind.fields)
    return isinstance(kind, StringType) or (isinstance(kind, ArrayType) and holds_text(kind.elementType)) or (isinstance(kind, MapType) and holds_text(kind.valueType))


def inline_nested(rows: DataFrame, labels: DataFrame, key: str, columns: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Rows whose tokens are shown with their labels in every string of these columns, however deep it lies; the key stays."""
    columns = columns or [c for c in rows.columns if c != key]
    tokens = F.regexp_extract_all(F.to_json(F.struct(*columns)), F.lit(TOKEN), F.lit(0))
    found = with_known(rows, tokens, labels, key, languages)
    shown = {c: rewritten(F.col(c), rows.schema[c].dataType, lambda s: inlined(s, F.col("_known"))) for c in columns}
    return found.withColumns(shown).drop("_known")


def inline_labels(rows: DataFrame, labels: DataFrame, text: str, key: str, languages: list[str] | None = None) -> DataFrame:
    """The same for one column of text."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return with_known(rows, tokens, labels, key, languages).withColumn(text, inlined(F.col(text), F.col("_known"))).drop("_known")
