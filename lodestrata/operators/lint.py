"""Lint checks, naming rules and review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_children(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def of_custom_models(catalogue, rows: DataFrame, only_custom: bool) -> DataFrame:
    """The rows of models that are marked as custom, or all."""
    return rows.join(catalogue.table("models").filter("is_custom").select(F.col("name").alias("model")), "model", "left_semi") if only_custom else rows


def tables_without_index(catalogue, only_custom: bool = True) -> DataFrame:
    t = of_custom_models(catalogue, catalogue.table("tables"), only_custom)
    idx = catalogue.table("table_indexes").select(F.col("table").alias("name"), "model")
    return t.join(idx, ["name", "model"], "left_anti").select("name", "model").orderBy("name", "model")


def unmarked_extensions(catalogue, only_custom: bool = True) -> DataFrame:
    """Classes named `..._Extension` (the underscore is literal) without an ExtensionOf attribute."""
    marked = catalogue.table("class_attributes").filter("attribute_name = 'ExtensionOf'").select(F.col("class").alias("name"), "model")
    own = of_custom_models(catalogue, catalogue.table("classes"), only_custom)
    return own.filter(F.lower("name").endswith("_extension")).join(marked, ["name", "model"], "left_anti").select("name", "model").orderBy("name", "model")


def string_fields_without_type(catalogue, only_custom: bool = True) -> DataFrame:
    f = of_custom_models(catalogue, catalogue.table("table_fields"), only_custom).filter((F.col("type") == "String") & (F.coalesce("edt_name", F.lit("")) == ""))
    return f.select(F.concat_ws(".", "table", "name").alias("target"), "model", F.col("type").alias("detail")).orderBy("target", "model")


def violations(df: DataFrame, rules: dict[str, Column], keep: list[str], name: str = "code") -> DataFrame:
    """A row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    return df.select(*keep, F.explode(found).alias(name))


# Literal strings, the soft limit of names, and the kinds of objects with their own endings.
LITERAL = r'@?"[^"\n]{3,}"'
NAME_LIMIT = 80
EXTENSION_KINDS, COC_KINDS = ("TableExtension", "FormExtension", "EdtExtension", "EnumExtension"), ("Coc", "CocClass")
SEVERITY = {
    "EMPTY_NAME": "error", "NAME_TOO_LONG": "warn", "INVALID_CHARS": "error", "LEADS_WITH_DIGIT": "error", "NOT_PASCAL_CASE": "warn",
    "EXTENSION_SUFFIX": "warn", "COC_SUFFIX": "warn", "TABLE_SUFFIX": "info", "ENUM_PREFIX_REDUNDANT": "info", "MISSING_PUBLISHER_PREFIX": "warn",
}


def naming_rules(name: Column, kind: Column, prefix: str | None = None) -> dict[str, Column]:
    """Which naming rules a name of a kind breaks; an empty name breaks that rule only."""
    n = F.coalesce(name, F.lit(""))
    blank, extension = F.trim(n) == "", n.endswith("_Extension")
    rules = {
        "NAME_TOO_LONG": F.length(n) > NAME_LIMIT,
        "INVALID_CHARS": n.rlike(r"[^\p{L}\p{Nd}_]"),
        "LEADS_WITH_DIGIT": n.rlike(r"^\p{Nd}"),
        "NOT_PASCAL_CASE": ~n.rlike(r"^[\p{Lu}_]"),
        "EXTENSION_SUFFIX": kind.isin(*EXTENSION_KINDS) & ~n.contains(".") & ~extension,
        "COC_SUFFIX": kind.isin(*COC_KINDS) & ~extension,
        "TABLE_SUFFIX": (kind == "Table") & n.rlike(r"\p{Ll}Table$"),
        "ENUM_PREFIX_REDUNDANT": (kind == "Enum") & n.startswith("Enum"),
        "MISSING_PUBLISHER_PREFIX": ~n.startswith(prefix) if prefix else F.lit(False),
    }
    return {"EMPTY_NAME": blank} | {code: ~blank & broken for code, broken in rules.items()}


def validate_names(objects: DataFrame, prefix: str | None = None) -> DataFrame:
    """kind, name, code and severity of all broken rules; objects have kind and name."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return violations(objects, naming_rules(F.col("name"), F.col("kind"), prefix), ["kind", "name"]).withColumn("severity", F.element_at(severity, F.col("code")))


def review_fields(fields: DataFrame) -> DataFrame:
    """Review rules on the fields of changed tables."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return violations(fields, {"FIELD_WITHOUT_EDT": none(F.col("edt_name")), "FIELD_WITHOUT_LABEL": none(F.col("label"))}, ["source_path", "table", "name"], "rule")


def review_sources(sources: DataFrame, body: str = "content") -> DataFrame:
    """Literal strings of three characters or more in either form, and queries built from strings."""
    found = sources.select("source_path", F.explode(F.regexp_extract_all(body, F.lit(LITERAL), F.lit(0))).alias("snippet")).select("source_path", F.lit("HARDCODED_STRING").alias("rule"), "snippet")
    built = sources.filter(F.col(body).contains("str2Con(") & F.col(body).contains("new Query")).select("source_path", F.lit("DYNAMIC_QUERY").alias("rule"), F.lit(None).cast("string").alias("snippet"))
    return found.unionByName(built)


def review_unreadable(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("source_path", F.lit("XML_PARSE").alias("rule"), F.col("error").alias("snippet"))
