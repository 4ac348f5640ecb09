"""Entity tables selected from a parsed tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import attributes, extended_class, handlers, is_static, return_type, signature_line
from lodestrata.sources.tree import parse_files


def prop(name: str, of: str = "props") -> Column:
    return F.col(of).getItem(name)


def yes(name: str, of: str = "props") -> Column:
    return F.coalesce(F.lower(prop(name, of)) == "yes", F.lit(False))


def own_name() -> Column:
    return F.coalesce(prop("Name"), F.regexp_extract("source_path", r"([^/]+)\.xml$", 1))


def objects_of(parsed: DataFrame, folder: str) -> DataFrame:
    """All rows of the objects of a kind, several for those of many children."""
    return parsed.filter(F.col("error").isNull() & F.col("kind").rlike(folder)).withColumn("name", own_name())


def heads(objects: DataFrame) -> DataFrame:
    """One row an object, with its own values; rows of stores from before there were parts have none."""
    return objects.filter(F.coalesce("part", F.lit(0)) == 0)


def children_of(objects: DataFrame, lists: str, parent: str, tag: str = "", top: bool = True) -> DataFrame:
    """Objects in a list of each object, `parent` naming the object; those without a name are left out."""
    c = objects.select(F.col("name").alias(parent), "model", F.explode("children").alias("c")).select(parent, "model", "c.*").filter(F.col("list") == lists)
    c = c.filter(F.col("tag").startswith(tag)) if tag else c
    return c.filter(F.col("parent").isNull()) if top else c


def indexes(tables: DataFrame) -> DataFrame:
    """Indexes with the fields in them; both are among a table's objects, so they meet in one grouping."""
    p = prop
    c = tables.select(F.col("name").alias("table"), "model", F.explode("children").alias("c")).select("table", "model", "c.*")
    own = (F.col("list") == "Indexes") & F.col("parent").isNull() & F.col("tag").startswith("AxTableIndex") & (F.coalesce(p("Name"), F.lit("")) != "")
    part = (F.col("list") == "Fields") & F.col("parent").isNotNull() & F.col("tag").startswith("AxTableIndex")
    flags = F.struct((~F.coalesce(F.lower(p("AllowDuplicates")) == "no", F.lit(False))).alias("allow_duplicates"), yes("AlternateKey").alias("alternate_key"))
    rows = c.filter(own | part).select("table", "model", F.when(own, p("Name")).otherwise(F.col("parent")).alias("name"), F.when(own, flags).alias("own"), F.when(part, F.struct("position", p("DataField").alias("f"))).alias("part"))
    by_name = rows.groupBy("table", "model", "name").agg(F.collect_list("own").alias("own"), F.sort_array(F.collect_list("part")).alias("parts"))
    return by_name.select("table", "model", "name", F.explode("own").alias("own"), F.transform("parts", lambda x: x["f"]).alias("fields")).select("table", "model", "name", "own.*", "fields")


#: By entity table: the lists whose objects it is selected from; all others take heads or methods only.
FROM_LISTS = {
    "table_fields": ("Fields",), "relations": ("Relations",), "table_indexes": ("Indexes", "Fields"), "table_delete_actions": ("DeleteActions",), "enum_values": ("EnumValues",),
    "form_data_sources": ("DataSources",), "role_duties": ("Duties",), "role_privileges": ("Privileges",), "duty_privileges": ("Privileges",), "privilege_entry_points": ("EntryPoints",),
    "query_data_sources": ("DataSources",), "view_fields": ("Fields",), "data_entity_fields": ("Fields",), "report_data_sets": ("DataSets",), "service_operations": ("Operations",), "service_group_members": ("Services",),
}
#: Folders by the entity tables that are selected from their files.
FROM_KINDS = {
    "^AxTable$": ("tables", "table_fields", "relations", "table_indexes", "table_delete_actions", "table_methods"), "^AxClass$": ("classes", "methods", "class_attributes", "coc", "event_subscribers"),
    "^AxEdt$": ("edts",), "^AxEnum$": ("enums", "enum_values"), "^AxMenuItem": ("menu_items",), "^AxForm$": ("forms", "form_data_sources"), "^Ax(Table|Form|Edt|Enum)Extension$": ("object_extensions",),
    "^AxSecurityRole$": ("security_roles", "role_duties", "role_privileges"), "^AxSecurityDuty$": ("security_duties", "duty_privileges"), "^AxSecurityPrivilege$": ("security_privileges", "privilege_entry_points"),
    "^AxQuery$": ("queries", "query_data_sources"), "^AxView$": ("views", "view_fields"), "^AxDataEntity": ("data_entities", "data_entity_fields"), "^Ax(Report|SsrsReport)": ("reports", "report_data_sets"),
    "^AxService$": ("services", "service_operations"), "^AxServiceGroup$": ("service_groups", "service_group_members"), "^AxWorkflow": ("workflow_types",),
}
FROM_METHODS = {"methods", "table_methods", "class_attributes", "coc", "event_subscribers"}


def extract_only(files: DataFrame, tables: list[str], kept=lambda parsed: parsed) -> dict[str, DataFrame]:
    """Some entity tables of files; only files of the kinds that they come from are parsed, for the lists and methods that they come from. `kept` may store what was parsed."""
    kinds = [folder for folder, of in FROM_KINDS.items() if not set(of).isdisjoint(tables)]
    files = files.filter(F.col("kind").rlike("|".join(kinds)))
    lists = {x for name in tables for x in FROM_LISTS.get(name, ())}
    t = extract(kept(parse_files(files, lists=lists, methods=not FROM_METHODS.isdisjoint(tables))))
    return {name: t[name] for name in tables}


def extract(parsed: DataFrame) -> dict[str, DataFrame]:
    """All entity tables. Each has the model it came from."""
    t: dict[str, DataFrame] = {}
    p = prop
    named = lambda df, c="Name": df.filter(F.coalesce(p(c), F.lit("")) != "")

    tables = objects_of(parsed, "^AxTable$")
    t["tables"] = heads(tables).select("name", "model", p("Label").alias("label"), "source_path")
    f = named(children_of(tables, "Fields", "table", "AxTableField"))
    edt = p("ExtendedDataType")
    t["table_fields"] = f.select("table", "model", p("Name").alias("name"), F.coalesce(p("Type"), F.when(edt.isNotNull(), "ExtendedDataType")).alias("type"), edt.alias("edt_name"), p("Label").alias("label"), yes("Mandatory").alias("mandatory"))
    r = named(children_of(tables, "Relations", "from_table", "AxTableRelation"), "RelatedTable")
    t["relations"] = r.select("from_table", "model", p("RelatedTable").alias("to_table"), p("Cardinality").alias("cardinality"), p("Name").alias("relation_name"))
    t["table_indexes"] = indexes(tables)
    d = named(children_of(tables, "DeleteActions", "table", "AxTableDeleteAction"), "RelatedTable")
    t["table_delete_actions"] = d.select("table", "model", p("Name").alias("name"), p("RelatedTable").alias("related_table"), p("DeleteAction").alias("delete_action"))

    classes = objects_of(parsed, "^AxClass$")
    word = lambda w: F.coalesce(F.col("declaration"), F.lit("")).rlike(rf"\b{w}\b")
    t["classes"] = heads(classes).select("name", "model", p("Extends").alias("extends_name"), word("abstract").alias("is_abstract"), word("final").alias("is_final"), "source_path", "declaration")

    def methods(objects: DataFrame, parent: str) -> DataFrame:
        m = objects.select(F.col("name").alias(parent), "model", "source_path", F.explode("methods").alias("m")).select(parent, "model", "source_path", "m.*").filter("NOT nested").drop("nested")
        m = m.withColumn("signature", F.coalesce(signature_line(F.col("source")), F.lit("")))
        return m.select(parent, "model", "name", "signature", return_type(F.col("signature")).alias("return_type"), is_static(F.col("signature")).alias("is_static"), "source", "source_path")

    t["methods"], t["table_methods"] = methods(classes, "class"), methods(tables, "table")
    marks = t["methods"].select("class", "model", F.col("name").alias("method_name"), F.explode(attributes(F.col("source"))).alias("a"))
    top = heads(classes).select(F.col("name").alias("class"), "model", F.lit(None).cast("string").alias("method_name"), F.explode(attributes(F.coalesce("declaration", F.lit("")))).alias("a"))
    t["class_attributes"] = top.unionByName(marks).select("class", "model", "method_name", F.col("a.name").alias("attribute_name"), F.col("a.args").alias("raw_args"))
    target = extended_class(F.coalesce("declaration", F.lit("")), F.col("name"), F.col("extends_name"))
    owners = t["classes"].select(F.col("name").alias("class"), "model", target.alias("target_class")).filter("target_class <> ''")
    t["coc"] = owners.join(t["methods"].select("class", "model", F.col("name").alias("target_method")), ["class", "model"]).select("target_class", "target_method", F.col("class").alias("extension_class"), "model")
    h = t["methods"].select(F.col("class").alias("subscriber_class"), F.col("name").alias("subscriber_method"), "model", F.explode(handlers(F.coalesce("source", F.lit("")))).alias("h"))
    t["event_subscribers"] = h.select("subscriber_class", "subscriber_method", "model", "h.*")

    edts = objects_of(parsed, "^AxEdt$")
    t["edts"] = heads(edts).select("name", "model", p("Extends").alias("extends_name"), F.nullif(F.regexp_extract("root", "^AxEdt(.*)$", 1), F.lit("")).alias("base_type"), p("Label").alias("label"), p("StringSize").try_cast("int").alias("string_size"))
    enums = objects_of(parsed, "^AxEnum$")
    t["enums"] = heads(enums).select("name", "model", p("Label").alias("label"))
    t["enum_values"] = named(children_of(enums, "EnumValues", "enum", "AxEnumValue")).select("enum", "model", p("Name").alias("name"), p("Value").try_cast("int").alias("value"), p("Label").alias("label"), "position")
    t["menu_items"] = heads(objects_of(parsed, "^AxMenuItem")).select("name", "model", F.regexp_replace("kind", "^AxMenuItem", "").alias("kind"), p("Object").alias("object"), p("ObjectType").alias("object_type"), p("Label").alias("label"))

    forms = objects_of(parsed, "^AxForm$")
    look = lambda c: prop(c, "design")
    t["forms"] = heads(forms).select("name", "model", look("Pattern").alias("pattern"), look("PatternVersion").alias("pattern_version"), look("Style").alias("style"), look("TitleDataSource").alias("title_data_source"), "source_path")
    t["form_data_sources"] = named(children_of(forms, "DataSources", "form", "AxFormDataSource")).select("form", "model", p("Name").alias("name"), p("Table").alias("table_name"), F.col("position").alias("order_index"), p("JoinSource").alias("join_source"))
    ext = objects_of(parsed, "^Ax(Table|Form|Edt|Enum)Extension$")
    t["object_extensions"] = heads(ext).select(F.regexp_extract("kind", "^Ax(.*)Extension$", 1).alias("kind"), F.substring_index("name", ".", 1).alias("target_name"), F.col("name").alias("extension_name"), "model", "source_path")

    roles, duties, privileges = (objects_of(parsed, f"^AxSecurity{k}$") for k in ("Role", "Duty", "Privilege"))
    t["security_roles"], t["security_duties"], t["security_privileges"] = (heads(x).select("name", "model", p("Label").alias("label")) for x in (roles, duties, privileges))
    link = lambda df, box, a, b: named(children_of(df, box, a)).select(a, p("Name").alias(b), "model")
    t["role_duties"], t["role_privileges"], t["duty_privileges"] = link(roles, "Duties", "role", "duty"), link(roles, "Privileges", "role", "privilege"), link(duties, "Privileges", "duty", "privilege")
    t["privilege_entry_points"] = named(children_of(privileges, "EntryPoints", "privilege"), "ObjectName").select("privilege", "model", p("ObjectName").alias("object_name"), p("ObjectType").alias("object_type"), p("ObjectChildName").alias("object_child"), p("AccessLevel").alias("access_level"))

    queries = objects_of(parsed, "^AxQuery$")
    t["queries"] = heads(queries).select("name", "model", "source_path")
    ds = named(children_of(queries, "DataSources", "query", "AxQuery", top=False))
    t["query_data_sources"] = ds.select("query", "model", p("Name").alias("name"), p("Table").alias("table_name"), p("JoinMode").alias("join_mode"), F.col("parent").alias("parent_ds"), "depth", "path", "place")
    views = objects_of(parsed, "^AxView$")
    t["views"] = heads(views).select("name", "model", p("Label").alias("label"), p("Query").alias("query_name"), "source_path")
    t["view_fields"] = named(children_of(views, "Fields", "view")).select("view", "model", p("Name").alias("name"), p("DataSource").alias("data_source"), p("DataField").alias("data_field"))
    ent = objects_of(parsed, "^AxDataEntity")
    t["data_entities"] = heads(ent).select("name", "model", p("PublicEntityName").alias("public_entity_name"), p("PublicCollectionName").alias("public_collection_name"), p("DataManagementStagingTable").alias("staging_table"), p("Query").alias("query_name"), p("Label").alias("label"), "source_path")
    t["data_entity_fields"] = named(children_of(ent, "Fields", "entity")).select("entity", "model", p("Name").alias("name"), p("DataSource").alias("data_source"), p("DataField").alias("data_field"), (yes("IsMandatory") | yes("Mandatory")).alias("is_mandatory"), (F.coalesce(F.lower(p("AllowEdit")) == "no", F.lit(False)) | yes("IsReadOnly")).alias("is_read_only"))
    reports = objects_of(parsed, "^Ax(Report|SsrsReport)")
    t["reports"] = heads(reports).select("name", "model", F.regexp_replace("kind", "^Ax", "").alias("kind"), "source_path")
    source = F.coalesce(p("DataSetType"), F.when(p("Query").isNotNull(), "Query").when(p("Class").isNotNull(), "ReportDataProvider"))
    t["report_data_sets"] = named(children_of(reports, "DataSets", "report")).select("report", "model", p("Name").alias("name"), source.alias("kind"), F.coalesce(p("Query"), p("Class")).alias("query_or_class"))
    services, groups = objects_of(parsed, "^AxService$"), objects_of(parsed, "^AxServiceGroup$")
    t["services"] = heads(services).select("name", "model", p("Class").alias("class"), "source_path")
    t["service_operations"] = named(children_of(services, "Operations", "service")).select("service", "model", p("Name").alias("operation_name"), F.coalesce(p("Method"), p("MethodName")).alias("method_name"))
    t["service_groups"] = heads(groups).select("name", "model", "source_path")
    t["service_group_members"] = children_of(groups, "Services", "service_group").select("service_group", "model", F.coalesce(p("Service"), p("Name")).alias("service_name")).filter("service_name <> ''")
    t["workflow_types"] = heads(objects_of(parsed, "^AxWorkflow")).select("name", "model", p("Category").alias("category"), F.coalesce(p("DocumentClass"), p("Document")).alias("document_class"), "source_path")
    return t
