"""Detail views: a header row with its children nested, and look-ups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import eq_ci


def nest(header: DataFrame, children: DataFrame, header_key: str, child_key: str, fields: list[str], order: list[str], into: str, inner: bool = False, within: str | None = None) -> DataFrame:
    """The header with an array of its children's fields; children are grouped before the join, so lists don't multiply.

    within: a column that both have and that must agree too, as names are unique within a model only.
    """
    keys = [F.col(child_key).alias("_parent"), *([F.col(within).alias("_within")] if within else [])]
    packed = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_all"))
    shaped = F.transform("_all", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    same = (F.col(header_key) == F.col("_parent")) & (F.col(within) == F.col("_within") if within else F.lit(True))
    df = header.join(packed, same, "inner" if inner else "left")
    kind = children.select(F.array(F.struct(*fields)).alias("x")).schema["x"].dataType
    return df.withColumn(into, shaped if inner else F.coalesce(shaped, F.array().cast(kind))).drop("_parent", "_within", "_all")


def csv_of(children: DataFrame, key: str, value: str, order: list[str], name: str = "csv") -> DataFrame:
    """Children's values joined by commas, in order."""
    fields = list(dict.fromkeys([*order, value]))
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return children.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x[value].cast("string")), ",").alias(name))


def first_child(children: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first child in order of each parent, with the number of children as `child_count`."""
    own = Window.partitionBy(key)
    return children.withColumn("_n", F.row_number().over(own.orderBy(*order))).withColumn("child_count", F.count("*").over(own)).filter("_n = 1").drop("_n")


#: Children of each kind of the catalogue: table, key to the parent's name, fields, order, name of the list.
CHILDREN = {
    "tables": [
        ("table_fields", "table", ["name", "type", "edt_name", "label", "mandatory"], ["name"], "fields"),
        ("table_methods", "table", ["name", "signature", "return_type", "is_static"], ["name"], "methods"),
        ("table_indexes", "table", ["name", "allow_duplicates", "alternate_key", "fields"], ["name"], "indexes"),
        ("table_delete_actions", "table", ["name", "related_table", "delete_action"], ["name"], "delete_actions"),
        ("relations", "_of", ["from_table", "to_table", "cardinality", "relation_name"], ["from_table", "to_table", "relation_name"], "relations"),
    ],
    "classes": [("methods", "class", ["name", "signature", "return_type", "is_static"], ["name"], "methods")],
    "enums": [("enum_values", "enum", ["name", "value", "label", "value_order"], ["value_order", "name"], "values")],
    "forms": [("form_data_sources", "form", ["name", "table_name", "order_index", "join_source"], ["order_index"], "data_sources")],
    "queries": [("query_data_sources", "query", ["name", "table_name", "join_mode", "parent_ds", "depth", "path", "place"], ["name", "place"], "data_sources")],
    "views": [("view_fields", "view", ["name", "data_source", "data_field"], ["name"], "fields")],
    "data_entities": [("data_entity_fields", "entity", ["name", "data_source", "data_field", "is_mandatory", "is_read_only"], ["name"], "fields")],
    "reports": [("report_data_sets", "report", ["name", "kind", "query_or_class"], ["name"], "data_sets")],
    "services": [("service_operations", "service", ["operation_name", "method_name"], ["operation_name"], "operations")],
    "service_groups": [("service_group_members", "service_group", ["service_name"], ["service_name"], "members")],
    "security_roles": [("role_duties", "role", ["duty"], ["duty"], "duties"), ("role_privileges", "role", ["privilege"], ["privilege"], "privileges")],
    "security_duties": [("duty_privileges", "duty", ["privilege"], ["privilege"], "privileges")],
    "security_privileges": [("privilege_entry_points", "privilege", ["object_name", "object_type", "object_child", "access_level"], ["object_name"], "entry_points")],
    "edts": [],
    "menu_items": [],
}
#: Kinds that are also found by another name.
OTHER_NAMES = {"data_entities": ["public_entity_name"]}


def get(catalogue, kind: str, name: str, include: list[str] | None = None) -> DataFrame:
    """At most one object of a kind by exact name, the first by model, with its own child lists (or those in `include`).

    Children are those of that name and model; relations are named by tables alone and count in both directions.
    """
    hit: Column = F.col("name") == name
    for other in OTHER_NAMES.get(kind, []):
        hit = hit | (F.col(other) == name)
    head = catalogue.table(kind).filter(hit).orderBy("name", "model", *(["source_path"] if "source_path" in catalogue.table(kind).columns else [])).limit(1)
    for table, key, fields, order, into in CHILDREN[kind]:
        if include is None or into in include:
            child = catalogue.table(table)
            if table == "enum_values":
                child = child.withColumn("value_order", F.coalesce("value", "position"))
            if table == "relations":
                head = nest(head, both_directions(child, name).withColumn(key, F.lit(name)), "name", key, fields, order, into)
            else:
                own = child.filter(F.col(key) == name) if kind not in OTHER_NAMES else child
                head = nest(head, own, "name", key, fields, order, into, within="model")
    return head


def get_label(labels: DataFrame, label_file: str, language: str, key: str) -> DataFrame:
    return labels.filter(eq_ci(F.col("label_file"), label_file) & eq_ci(F.col("language"), language) & eq_ci(F.col("key"), key)).orderBy("label_file", "language", "key").limit(1)


def get_label_by_key(labels: DataFrame, key: str) -> DataFrame:
    return labels.filter(eq_ci(F.col("key"), F.regexp_replace(F.lit(key), "^@", ""))).orderBy("label_file", "language")


def both_directions(relations: DataFrame, value, left: str = "from_table", right: str = "to_table") -> DataFrame:
    """Relations that start or end at a value."""
    return relations.filter((F.col(left) == value) | (F.col(right) == value))


def related_of_many(relations: DataFrame, names: DataFrame, left: str = "from_table", right: str = "to_table") -> DataFrame:
    """Bulk form: two equi-joins in place of an OR; a relation of a name to itself counts once."""
    out = names.join(relations, names["name"] == relations[left])
    back = names.join(relations, (names["name"] == relations[right]) & (relations[left] != relations[right]))
    return out.unionByName(back)


def children_of(catalogue, table: str, parent: str, key: str = "table") -> DataFrame:
    """Children of the objects of a name, with the model of each."""
    return catalogue.table(table).filter(F.col(key) == parent).orderBy("name", "model")
