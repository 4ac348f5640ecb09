"""Registered queries over a source tree: XML files rendered from the test tables, parsed and extracted like any other.

Each query renders the kinds of file that it needs, one object a row, runs the operator on what was extracted and has
SQL that gives its rows from the tables that the files came from. Models are nations, packages regions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import details, graph, lint, relations, search, stats
from lodestrata.plans.catalogue import Catalogue
from lodestrata.plans.tables import Tables
from lodestrata.session import checkpoint
from lodestrata.sources.entities import extract_only
from lodestrata.sources.labels import inline_labels, label_rows
from lodestrata.sources.tree import parse_descriptors, parse_files, source_blocks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of the tables under its name, with the SQL that gives its rows."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- rendering


def tag(name: str, *inner: Column | str) -> Column:
    """An element; null parts leave nothing."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) if isinstance(x, Column) else F.lit(x) for x in inner]
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))


def gathered(rows: DataFrame, key: str, xml: Column, order: list[str], into: str) -> DataFrame:
    """The elements of each key, joined in order."""
    made = rows.select(key, *order, xml.alias("_x")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "_x"))).alias("_all"))
    return made.select(key, F.array_join(F.transform("_all", lambda x: x["_x"]), "").alias(into))


def files(rows: DataFrame, kind: Column | str, name: Column, xml: Column, model: Column | str = "n_name", package: Column | str = "r_name") -> DataFrame:
    """One object file a row, at <package>/<model>/<kind>/<name>.xml."""
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    path = F.concat_ws("/", F.lit("root"), col(package), col(model), kind, F.concat(name, F.lit(".xml")))
    return rows.select(col(package).alias("package"), col(model).alias("model"), kind.alias("kind"), path.alias("source_path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), xml.cast("binary").alias("content"))


def places(t) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def customers(t) -> DataFrame:
    return t.customer.join(places(t), F.col("c_nationkey") == F.col("n_nationkey"))


def suppliers(t) -> DataFrame:
    return t.supplier.join(places(t), F.col("s_nationkey") == F.col("n_nationkey"))


def dealt(*made: DataFrame) -> DataFrame:
    """The files, dealt out by path: joins leave what they render in as few tasks as their tables have parts."""
    return reduce(DataFrame.unionByName, made).repartition("source_path")


def extracted(made: DataFrame | list[DataFrame], *tables: str) -> dict[str, DataFrame]:
    """These tables of the files."""
    return extract_only(dealt(*([made] if isinstance(made, DataFrame) else made)), list(tables))


def extracted_once(made: DataFrame | list[DataFrame], kind: str) -> dict[str, DataFrame]:
    """The table of a kind and those of its children; the files are parsed once for all of them."""
    return extract_only(dealt(*([made] if isinstance(made, DataFrame) else made)), [kind, *(c[0] for c in details.CHILDREN[kind])], kept=checkpoint)


def listed(column: str, *fields: str) -> Column:
    """A list of children as text: fields joined by a colon, children by a comma; null fields are empty."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields])), ",")


# ---------------------------------------------------------------- tables


#: Orders as fields of their customer's table; every seventh order with lines as an index with its parts as fields.
def table_files(t) -> DataFrame:
    text = F.col("o_orderkey") % 3 == 0
    kind = F.when(text, tag("Type", "String")).otherwise(tag("ExtendedDataType", F.col("o_orderpriority")))
    must = tag("Mandatory", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No"))
    field = tag("AxTableField", tag("Name", F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))), kind, tag("Label", F.col("o_orderstatus")), must)
    fields = gathered(t.orders, "o_custkey", field, ["o_orderkey"], "fields")
    part = tag("AxTableIndexField", tag("DataField", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))))
    parts = gathered(t.lineitem.filter("l_orderkey % 7 = 0"), "l_orderkey", part, ["l_linenumber", "l_partkey", "l_suppkey"], "parts").join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    index = tag("AxTableIndex", tag("Name", F.concat(F.lit("I"), F.col("o_orderkey").cast("string"))), F.when(F.col("o_orderstatus") == "F", tag("AllowDuplicates", "No")), tag("AlternateKey", F.when(F.col("o_orderstatus") == "O", "yes").otherwise("No")), tag("Fields", F.col("parts")))
    indexes = gathered(parts, "o_custkey", index, ["o_orderkey"], "indexes").withColumnRenamed("o_custkey", "_i")
    rows = customers(t).join(fields, F.col("c_custkey") == F.col("o_custkey"), "left").join(indexes, F.col("c_custkey") == F.col("_i"), "left")
    link = tag("AxTableRelation", tag("Name", "Segment"), tag("RelatedTable", F.col("c_mktsegment")), F.when(F.col("c_acctbal") > 0, tag("Cardinality", "ZeroMore")))
    gone = tag("AxTableDeleteAction", tag("Name", "D"), tag("RelatedTable", F.col("c_mktsegment")), tag("DeleteAction", "Cascade"))
    body = [tag("Name", F.col("c_name")), tag("Label", F.col("c_mktsegment")), tag("Fields", F.col("fields")), tag("Relations", link), tag("Indexes", F.col("indexes")), tag("DeleteActions", gone)]
    return files(rows, "AxTable", F.col("c_name"), tag("AxTable", *body))


OWNED = "customer join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey"


@query(f"""select c_name as name, n_name as model, c_mktsegment as label from {OWNED} where r_name<>'ASIA' and c_custkey%10<>0""")
def tree_guards(t):
    """Packages that end in FormAdaptor and folders that hold no objects are left out."""
    rows = customers(t).withColumn("r_name", F.when(F.col("r_name") == "ASIA", "Asia_FORMADAPTOR").otherwise(F.col("r_name")))
    kind = F.when(F.col("c_custkey") % 10 == 0, "Resources").otherwise("AxTable")
    return extracted(files(rows, kind, F.col("c_name"), tag("AxTable", tag("Name", F.col("c_name")), tag("Label", F.col("c_mktsegment")))), "tables")["tables"].select("name", "model", "label")


@query(f"""select c_name as "table", n_name as model, 'O'||o_orderkey as name, case when o_orderkey%3=0 then 'String' else 'ExtendedDataType' end as type, case when o_orderkey%3<>0 then o_orderpriority end as edt_name, o_orderstatus as label, o_orderstatus='F' as mandatory
 from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey""")
def tree_table_fields(t):
    return extracted(table_files(t), "table_fields")["table_fields"]


@query("""select c_name as "table", n_name as model, 'I'||o_orderkey as name, o_orderstatus<>'F' as allow_duplicates, o_orderstatus='O' as alternate_key, string_agg('P'||l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) as fields
 from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey where o_orderkey%7=0 group by all""")
def tree_table_indexes(t):
    return extracted(table_files(t), "table_indexes")["table_indexes"].withColumn("fields", F.array_join("fields", ","))


@query("""select c_name as name, n_name as model, c_mktsegment as label, (select string_agg('O'||o_orderkey, ',' order by 'O'||o_orderkey) from orders where o_custkey=c_custkey) as fields,
 (select string_agg('I'||o_orderkey, ',' order by 'I'||o_orderkey) from orders where o_custkey=c_custkey and o_orderkey%7=0 and o_orderkey in (select l_orderkey from lineitem)) as indexes, c_mktsegment||':Cascade' as delete_actions, c_name||':'||c_mktsegment||':'||case when c_acctbal>0 then 'ZeroMore' else '' end as relations
 from customer join nation on n_nationkey=c_nationkey where c_name='Customer#000000007'""")
def get_table(t):
    own = table_files(t).filter(F.col("source_path").endswith("/Customer#000000007.xml"))  # a file bears its object's name
    got = details.get(Catalogue(t.spark, tables=extracted_once(own, "tables")), "tables", "Customer#000000007")
    return got.select("name", "model", "label", listed("fields", "name").alias("fields"), listed("indexes", "name").alias("indexes"), listed("delete_actions", "related_table", "delete_action").alias("delete_actions"), listed("relations", "from_table", "to_table", "cardinality").alias("relations"))


@query("""select name, model, string_agg(x, ',' order by x) as indexes from (select c_name as name, n_name as model, 'I'||o_orderkey as x from customer join nation on n_nationkey=c_nationkey join orders on o_custkey=c_custkey where c_name='Customer#000000017' and o_orderkey%7=0 and o_orderkey in (select l_orderkey from lineitem)) group by all""")
def get_table_indexes(t):
    rows = details.children_of(Catalogue(t.spark, tables=extracted(table_files(t), "table_indexes")), "table_indexes", "Customer#000000017")
    return rows.groupBy(F.col("table").alias("name"), "model").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("indexes"))


def marked_models(t, custom: str) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("model"), F.expr(custom).alias("is_custom"))


@query("select c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where n_nationkey%2=0 and not exists (select 1 from orders join lineitem on l_orderkey=o_orderkey where o_custkey=c_custkey and o_orderkey%7=0)")
def lint_tables_without_index(t):
    tables = extracted(table_files(t), "tables", "table_indexes") | {"models": marked_models(t, "n_nationkey % 2 = 0")}
    return lint.tables_without_index(Catalogue(t.spark, tables=tables))


@query("select c_name||'.O'||o_orderkey as target, n_name as model, 'String' as detail from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey where o_orderkey%3=0 and n_nationkey%2=0")
def lint_string_fields(t):
    tables = extracted(table_files(t), "table_fields") | {"models": marked_models(t, "n_nationkey % 2 = 0")}
    return lint.string_fields_without_type(Catalogue(t.spark, tables=tables))


@query("select c_name as name, n_name as model, count(o_orderkey) as k from customer join nation on n_nationkey=c_nationkey left join orders on o_custkey=c_custkey group by all order by k desc, name, model limit 10")
def stats_top_tables(t):
    e = extracted(table_files(t), "tables", "table_fields")
    return stats.top_by_children(e["tables"], e["table_fields"], "name", "table", "name", within=["model"])


# ---------------------------------------------------------------- classes


#: A class a supplier: an extension of a customer where its key is even, marked by attribute or by name; a method a line.
MARKED = "s_suppkey % 4 = 0"
CLASS_NAME = "case when s_suppkey%2=0 then s_name||'_Extension' else s_name end"
LINES = "(select * from lineitem where l_quantity>=48)"


def class_files(t) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("_Extension"))).otherwise(F.col("s_name"))
    n = F.col("l_orderkey").cast("string")
    handler = F.concat(
        F.lit("[Note(classStr(Wrong))]\n[DataEventHandler(tableStr(T"), F.col("l_partkey").cast("string"), F.lit("), DataEventType::Inserted)]\n"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("[SubscribesTo(classStr(C), delegateStr(C, on"), n, F.lit("))]\n"))).otherwise(""))
    source = F.concat(F.when(F.col("l_linenumber") == 1, handler).otherwise(""), F.lit("public static "), F.col("l_linestatus"), F.lit(" m"), n, F.lit("()\n{ x = classStr(Body); see Widget; }"))
    method = tag("Method", tag("Name", F.concat(F.lit("m"), n, F.lit("_"), F.col("l_linenumber").cast("string"))), tag("Source", cdata(source)))
    methods = gathered(t.lineitem.filter("l_quantity >= 48"), "l_suppkey", method, ["l_orderkey", "l_linenumber", "l_partkey"], "methods")
    rows = suppliers(t).join(methods, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    top = F.concat(F.when(F.expr(MARKED), F.concat(F.lit("[ExtensionOf(tableStr(T"), F.col("s_nationkey").cast("string"), F.lit("))]\n"))).otherwise(""), F.lit("public "), F.when(F.col("s_suppkey") % 3 == 0, "final").otherwise("abstract"), F.lit(" class"))
    body = tag("SourceCode", tag("Declaration", cdata(top)), tag("Methods", F.col("methods")))
    return files(rows, "AxClass", name, tag("AxClass", tag("Name", name), body))


@query(f"select {CLASS_NAME} as name, n_name as model, s_suppkey%3<>0 as is_abstract, s_suppkey%3=0 as is_final from supplier join nation on n_nationkey=s_nationkey")
def tree_classes(t):
    return extracted(class_files(t), "classes")["classes"].select("name", "model", "is_abstract", "is_final")


METHOD = f"""select {CLASS_NAME} as class, n_name as model, 'm'||l_orderkey||'_'||l_linenumber as name, l.* from {LINES} l join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey"""


@query(f"select class, model, name, 'public static '||l_linestatus||' m'||l_orderkey||'()' as signature, l_linestatus as return_type, true as is_static from ({METHOD})")
def tree_methods(t):
    return extracted(class_files(t), "methods")["methods"].select("class", "model", "name", "signature", "return_type", "is_static")


@query(f"""select class, model, name as method_name, 'Note' as attribute_name, 'classStr(Wrong)' as raw_args from ({METHOD}) where l_linenumber=1 union all select class, model, name, 'DataEventHandler', 'tableStr(T'||l_partkey||'), DataEventType::Inserted' from ({METHOD}) where l_linenumber=1
 union all select class, model, name, 'SubscribesTo', 'classStr(C), delegateStr(C, on'||l_orderkey||')' from ({METHOD}) where l_linenumber=1 and l_returnflag='R'
 union all select {CLASS_NAME}, n_name, null, 'ExtensionOf', 'tableStr(T'||s_nationkey||')' from supplier join nation on n_nationkey=s_nationkey where s_suppkey%4=0""")
def tree_attributes(t):
    return extracted(class_files(t), "class_attributes")["class_attributes"]


@query(f"""select case when s_suppkey%4=0 then 'T'||s_nationkey else s_name end as target_class, 'm'||l_orderkey||'_'||l_linenumber as target_method, {CLASS_NAME} as extension_class, n_name as model from {LINES} l join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey where s_suppkey%2=0""")
def tree_coc(t):
    return extracted(class_files(t), "coc")["coc"]


SUBSCRIBERS = f"""select class as subscriber_class, name as subscriber_method, model, 'Table' as source_kind, 'T'||l_partkey as source_object, null as source_member, 'Inserted' as event_type from ({METHOD}) where l_linenumber=1
 union all select class, name, model, 'Delegate', 'C', 'on'||l_orderkey, null from ({METHOD}) where l_linenumber=1 and l_returnflag='R'"""


@query(SUBSCRIBERS)
def tree_event_subscribers(t):
    return extracted(class_files(t), "event_subscribers")["event_subscribers"]


@query(f"select * from ({SUBSCRIBERS}) where source_object='C' and source_kind='Delegate'")
def find_event_subscribers(t):
    return relations.event_subscribers(extracted(class_files(t), "event_subscribers")["event_subscribers"], "C", "Delegate")


@query(f"""select 'T3' as target_class, 'm'||l_orderkey||'_'||l_linenumber as target_method, {CLASS_NAME} as extension_class, n_name as model from {LINES} l join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey where s_suppkey%4=0 and s_nationkey=3""")
def find_coc_extensions(t):
    return relations.coc_extensions(extracted(class_files(t), "coc")["coc"], "T3")


@query(f"select name, model, string_agg(m, ',' order by m) as methods from (select class as name, model, name as m from ({METHOD}) where class='Supplier#000000004_Extension') group by all")
def get_class(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(class_files(t), "classes")), "classes", "Supplier#000000004_Extension")
    return got.select("name", "model", listed("methods", "name").alias("methods"))


@query(f"select {CLASS_NAME} as name, n_name as model from supplier join nation on n_nationkey=s_nationkey where s_suppkey%2=0 and s_suppkey%4<>0 and n_nationkey%2=0")
def lint_unmarked_extensions(t):
    tables = extracted(class_files(t), "classes", "class_attributes") | {"models": marked_models(t, "n_nationkey % 2 = 0")}
    return lint.unmarked_extensions(Catalogue(t.spark, tables=tables))


@query(f"select class, model, name, '{{ x = classStr(Body); see Widget; }}' as lines from ({METHOD})")
def find_references(t):
    found = relations.source_references(extracted(class_files(t), "methods")["methods"], "WIDGET")
    return found.select("class", "model", "name", F.array_join("sample_lines", "\n").alias("lines"))


@query(f"""select 'Method' as kind, name, string_split(case when l_linenumber=1 then '[Note(classStr(Wrong))]' else 'public static '||l_linestatus||' m'||l_orderkey||'()' end, chr(10))[1] as line from ({METHOD})
 union all select 'Declaration', null, case when s_suppkey%4=0 then '[ExtensionOf(tableStr(T'||s_nationkey||'))]' else 'public '||case when s_suppkey%3=0 then 'final' else 'abstract' end||' class' end from supplier""")
def read_sources(t):
    from lodestrata.plans.api import source_text

    return source_text(source_blocks(parse_files(dealt(class_files(t)))), first=1, last=1).select("kind", "name", F.col("body").alias("line"))


# ---------------------------------------------------------------- types, enums, menu items, forms


def enum_files(t) -> DataFrame:
    """Nations as enums, their suppliers as values; every third has no number and keeps its place."""
    value = tag("AxEnumValue", tag("Name", F.col("s_name")), F.when(F.col("s_suppkey") % 3 != 0, tag("Value", (1000 - F.col("s_suppkey")).cast("string"))), tag("Label", "L"))
    values = gathered(t.supplier, "s_nationkey", value, ["s_suppkey"], "values")
    rows = places(t).join(values, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return files(rows, "AxEnum", F.col("n_name"), tag("AxEnum", tag("Name", F.col("n_name")), tag("EnumValues", F.col("values"))), model="r_name", package="r_name")


ENUM_VALUE = """select n_name as "enum", r_name as model, s_name as name, case when s_suppkey%3<>0 then (1000-s_suppkey)::int end as value, 'L' as label, (row_number() over (partition by n_nationkey order by s_suppkey)-1)::int as position from supplier join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey"""


@query(ENUM_VALUE)
def tree_enum_values(t):
    return extracted(enum_files(t), "enum_values")["enum_values"]


@query(f"""select "enum" as name, model, string_agg(name||':'||coalesce(value::varchar,''), ',' order by coalesce(value,position), name) as vals from ({ENUM_VALUE}) where "enum"='NATION_15' group by all""")
def get_enum(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(enum_files(t), "enums")), "enums", "NATION_15")
    return got.select("name", "model", listed("values", "name", "value").alias("vals"))


def edt_files(t) -> DataFrame:
    rows = t.part.crossJoin(F.broadcast(t.region.filter("r_regionkey = 0").select("r_name")))  # one row
    name = F.concat(F.lit("E"), F.col("p_partkey").cast("string"))
    xml = F.when(F.col("p_partkey") % 2 == 0, tag("AxEdtString", tag("Name", name), tag("StringSize", F.col("p_size").cast("string")), tag("Extends", F.col("p_type")))).otherwise(tag("AxEdt", tag("Name", name), tag("StringSize", "many"), tag("Label", F.col("p_name"))))
    return files(rows, "AxEdt", name, xml, model=F.col("p_brand"))


EDT = """select 'E'||p_partkey as name, p_brand as model, case when p_partkey%2=0 then p_type end as extends_name, case when p_partkey%2=0 then 'String' end as base_type, case when p_partkey%2<>0 then p_name end as label, case when p_partkey%2=0 then p_size end as string_size from part"""


@query(EDT)
def tree_edts(t):
    return extracted(edt_files(t), "edts")["edts"]


@query(f"select * from ({EDT}) where name='E12'")
def get_edt(t):
    return details.get(Catalogue(t.spark, tables=extracted_once(edt_files(t), "edts")), "edts", "E12")


def menu_files(t) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "AxMenuItemDisplay").otherwise("AxMenuItemAction")
    return files(customers(t), kind, F.col("c_name"), tag("AxMenuItem", tag("Name", F.col("c_name")), tag("Object", F.col("c_mktsegment")), tag("ObjectType", "Form")))


MENU = "select c_name as name, n_name as model, case when c_custkey%2=0 then 'Display' else 'Action' end as kind, c_mktsegment as object, 'Form' as object_type, null as label from customer join nation on n_nationkey=c_nationkey"


@query(MENU)
def tree_menu_items(t):
    return extracted(menu_files(t), "menu_items")["menu_items"]


@query(f"select * from ({MENU}) where name='Customer#000000005'")
def get_menu_item(t):
    return details.get(Catalogue(t.spark, tables=extracted_once(menu_files(t), "menu_items")), "menu_items", "Customer#000000005")


def form_files(t) -> DataFrame:
    """Orders as forms, their lines as data sources."""
    one = tag("AxFormDataSource", tag("Name", F.concat(F.lit("D"), F.col("l_linenumber").cast("string"))), tag("Table", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))), F.when(F.col("l_linenumber") > 1, tag("JoinSource", "D1")))
    lines = gathered(t.lineitem, "l_orderkey", one, ["l_linenumber", "l_partkey", "l_suppkey"], "sources")
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("r_name", F.lit("R"))
    design = F.when(F.col("o_orderstatus") != "P", tag("Design", tag("Pattern", F.col("o_orderpriority")), tag("PatternVersion", "1.1"), tag("Style", F.col("o_orderstatus")), tag("TitleDataSource", "D1")))
    name = F.concat(F.lit("F"), F.col("o_orderkey").cast("string"))
    return files(rows, "AxForm", name, tag("AxForm", tag("Name", name), tag("DataSources", F.col("sources")), design), model=F.col("o_orderstatus"))


FORM = """select 'F'||o_orderkey as name, o_orderstatus as model, case when o_orderstatus<>'P' then o_orderpriority end as pattern, case when o_orderstatus<>'P' then '1.1' end as pattern_version, case when o_orderstatus<>'P' then o_orderstatus end as style, case when o_orderstatus<>'P' then 'D1' end as title_data_source from orders"""
SOURCE = """select 'F'||l_orderkey as form, o_orderstatus as model, 'D'||l_linenumber as name, 'P'||l_partkey as table_name, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)-1)::int as order_index, case when l_linenumber>1 then 'D1' end as join_source from lineitem join orders on o_orderkey=l_orderkey"""


@query(FORM)
def tree_forms(t):
    return extracted(form_files(t), "forms")["forms"].drop("source_path")


@query(SOURCE)
def tree_form_data_sources(t):
    return extracted(form_files(t), "form_data_sources")["form_data_sources"]


@query(f"select f.name, f.model, f.pattern, string_agg(s.name||':'||s.table_name||':'||coalesce(s.join_source,''), ',' order by s.order_index) as sources from ({FORM}) f join ({SOURCE}) s on s.form=f.name where f.name='F201' group by all")
def get_form(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(form_files(t), "forms")), "forms", "F201")
    return got.select("name", "model", "pattern", listed("data_sources", "name", "table_name", "join_source").alias("sources"))


def extension_files(t) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "AxTableExtension").otherwise("AxFormExtension")
    name = F.concat(F.lit("T"), F.col("c_nationkey").cast("string"), F.lit("."), F.col("c_name"))
    return files(customers(t), kind, name, tag("AxExtension", tag("Name", name)))


EXTENSION = "select case when c_custkey%2=0 then 'Table' else 'Form' end as kind, 'T'||c_nationkey as target_name, 'T'||c_nationkey||'.'||c_name as extension_name, n_name as model from customer join nation on n_nationkey=c_nationkey"


@query(EXTENSION)
def tree_object_extensions(t):
    return extracted(extension_files(t), "object_extensions")["object_extensions"].drop("source_path")


@query(f"select * from ({EXTENSION}) where target_name='T4' and kind='Form'")
def find_extensions(t):
    return relations.object_extensions(extracted(extension_files(t), "object_extensions")["object_extensions"], "T4", "Form").drop("source_path")


# ---------------------------------------------------------------- security, queries, views, reports, services


def security_files(t) -> list[DataFrame]:
    """Regions as roles, nations as duties, customers as privileges, large orders as entry points; suppliers are privileges of the roles themselves."""
    ref = lambda name: tag("Reference", tag("Name", name))
    duties = gathered(t.nation, "n_regionkey", ref(F.col("n_name")), ["n_nationkey"], "duties")
    own = gathered(suppliers(t), "r_name", ref(F.col("s_name")), ["s_suppkey"], "own").withColumnRenamed("r_name", "_r")
    roles = t.region.join(duties, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(own, F.col("_r") == F.col("r_name"), "left")
    privileges = gathered(t.customer, "c_nationkey", ref(F.col("c_name")), ["c_custkey"], "privileges")
    nations = places(t).join(privileges, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    point = tag("Point", tag("ObjectName", F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))), tag("ObjectType", "MenuItem"), tag("AccessLevel", F.col("o_orderstatus")))
    points = gathered(t.orders.filter("o_totalprice > 300000"), "o_custkey", point, ["o_orderkey"], "points")
    people = customers(t).join(points, F.col("o_custkey") == F.col("c_custkey"), "left")
    return [
        files(roles, "AxSecurityRole", F.col("r_name"), tag("AxSecurityRole", tag("Name", F.col("r_name")), tag("Duties", F.col("duties")), tag("Privileges", F.col("own"))), model="r_name"),
        files(nations, "AxSecurityDuty", F.col("n_name"), tag("AxSecurityDuty", tag("Name", F.col("n_name")), tag("Privileges", F.col("privileges")))),
        files(people, "AxSecurityPrivilege", F.col("c_name"), tag("AxSecurityPrivilege", tag("Name", F.col("c_name")), tag("EntryPoints", F.col("points")))),
    ]


SECURITY = ["security_roles", "security_duties", "security_privileges", "role_duties", "role_privileges", "duty_privileges", "privilege_entry_points"]


@query("""select r_name as role, n_name as duty, c_name as privilege, 'O'||o_orderkey as object_name, case when o_orderkey is not null then 'MenuItem' end as object_type, o_orderstatus as access_level from region join nation on n_regionkey=r_regionkey join customer on c_nationkey=n_nationkey left join orders on o_custkey=c_custkey and o_totalprice>300000
 union all select r_name, null, s_name, null, null, null from region join nation on n_regionkey=r_regionkey join supplier on s_nationkey=n_nationkey""")
def tree_security(t):
    return Catalogue(t.spark, tables=extracted(security_files(t), *SECURITY)).security()


@query("""select r_name as name, r_name as model, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey=r_regionkey) as duties, (select string_agg(s_name, ',' order by s_name) from supplier join nation on n_nationkey=s_nationkey where n_regionkey=r_regionkey) as privileges from region where r_name='ASIA'""")
def get_security_role(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(security_files(t), "security_roles")), "security_roles", "ASIA")
    return got.select("name", "model", listed("duties", "duty").alias("duties"), listed("privileges", "privilege").alias("privileges"))


@query("select n_name as name, (select string_agg(c_name, ',' order by c_name) from customer where c_nationkey=n_nationkey) as privileges from nation where n_name='NATION_3'")
def get_security_duty(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(security_files(t), "security_duties")), "security_duties", "NATION_3")
    return got.select("name", listed("privileges", "privilege").alias("privileges"))


@query("select c_name as name, n_name as model, coalesce((select string_agg('O'||o_orderkey||':'||o_orderstatus, ',' order by 'O'||o_orderkey) from orders where o_custkey=c_custkey and o_totalprice>300000),'') as points from customer join nation on n_nationkey=c_nationkey where c_name='Customer#000000085'")
def get_security_privilege(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(security_files(t), "security_privileges")), "security_privileges", "Customer#000000085")
    return got.select("name", "model", listed("entry_points", "object_name", "access_level").alias("points"))


def query_files(t) -> DataFrame:
    """Regions as queries: a data source, its nations in it, the suppliers in them."""
    leaf = tag("AxQuerySimpleEmbeddedDataSource", tag("Name", F.col("s_name")), tag("JoinMode", "InnerJoin"))
    leaves = gathered(t.supplier, "s_nationkey", leaf, ["s_suppkey"], "leaves")
    node = tag("AxQuerySimpleEmbeddedDataSource", tag("Name", F.col("n_name")), tag("Table", "Nation"), tag("DataSources", F.col("leaves")))
    nodes = gathered(t.nation.join(leaves, F.col("s_nationkey") == F.col("n_nationkey"), "left"), "n_regionkey", node, ["n_nationkey"], "nodes")
    rows = t.region.join(nodes, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    top = tag("AxQuerySimpleRootDataSource", tag("Name", "Root"), tag("Table", "Region"), tag("DataSources", F.col("nodes")))
    return files(rows, "AxQuery", F.col("r_name"), tag("AxQuery", tag("Name", F.col("r_name")), tag("DataSources", top)), model="r_name")


NESTED = """select r_name as query, r_name as model, 'Root' as name, 'Region' as table_name, null as join_mode, null as parent_ds from region union all select r_name, r_name, n_name, 'Nation', null, 'Root' from nation join region on r_regionkey=n_regionkey
 union all select r_name, r_name, s_name, null, 'InnerJoin', n_name from supplier join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey"""


@query(NESTED)
def tree_query_data_sources(t):
    return extracted(query_files(t), "query_data_sources")["query_data_sources"].drop("depth", "path", "place")


@query("""with recursive up(id, above, name, place) as (select 'r'||r_regionkey, null, 'Root', 0 from region union all select 'n'||n_nationkey, 'r'||n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey)-1 from nation
 union all select 's'||s_suppkey, 'n'||s_nationkey, s_name, row_number() over (partition by s_nationkey order by s_suppkey)-1 from supplier),
 walk(id, query, name, depth, path, place) as (select id, r_name, name, 1, name, '0' from up join region on id='r'||r_regionkey union all
 select u.id, w.query, u.name, w.depth+1, w.path||'/'||u.name, w.place||'/'||u.place from walk w join up u on u.above=w.id) select query, name, depth::int as depth, path, place from walk""")
def query_source_paths(t):
    """Depth, names and positions from the outermost data source on."""
    return extracted(query_files(t), "query_data_sources")["query_data_sources"].select("query", "name", "depth", "path", "place")


@query(f"select query as name, string_agg(name||':'||coalesce(parent_ds,''), ',' order by name) as sources from ({NESTED}) where query='AFRICA' group by all")
def get_query(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(query_files(t), "queries")), "queries", "AFRICA")
    return got.select("name", listed("data_sources", "name", "parent_ds").alias("sources"))


def parts_of(t, kind: str, root: str, box: str, item: str, *inner: Column, more: tuple = (), name: str = "p_brand") -> DataFrame:
    """Brands as objects, their parts as items in a list."""
    items = gathered(t.part, "p_brand", tag(item, *inner), ["p_partkey"], "items").withColumn("r_name", F.lit("R"))
    return files(items, kind, F.col(name), tag(root, tag("Name", F.col(name)), *more, tag(box, F.col("items"))), model=F.col("p_brand"))


def item() -> Column:
    return F.concat(F.lit("V"), F.col("p_partkey").cast("string"))


def view_files(t) -> DataFrame:
    return parts_of(t, "AxView", "AxView", "Fields", "AxViewField", tag("Name", item()), tag("DataSource", F.col("p_type")), tag("DataField", F.col("p_name")), more=(tag("Query", "Q"),))


@query("""select p_brand as view, p_brand as model, 'V'||p_partkey as name, p_type as data_source, p_name as data_field from part""")
def tree_view_fields(t):
    return extracted(view_files(t), "view_fields")["view_fields"]


@query("select p_brand as name, 'Q' as query_name, string_agg('V'||p_partkey||':'||p_name, ',' order by 'V'||p_partkey) as fields from part where p_brand='Brand#13' group by all")
def get_view(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(view_files(t), "views")), "views", "Brand#13")
    return got.select("name", "query_name", listed("fields", "name", "data_field").alias("fields"))


def entity_files(t) -> DataFrame:
    must = F.when(F.col("p_partkey") % 3 == 0, tag("IsMandatory", "Yes")).when(F.col("p_partkey") % 3 == 1, tag("Mandatory", "Yes"))
    fixed = F.when(F.col("p_size") > 40, tag("AllowEdit", "No")).when(F.col("p_size") > 20, tag("IsReadOnly", "Yes"))
    return parts_of(t, "AxDataEntityView", "AxDataEntityView", "Fields", "AxDataEntityViewMappedField", tag("Name", item()), must, fixed, more=(tag("PublicEntityName", F.concat(F.lit("Public"), F.substring("p_brand", 7, 9))), tag("PublicCollectionName", "All")))


@query("""select p_brand as entity, p_brand as model, 'V'||p_partkey as name, null as data_source, null as data_field, p_partkey%3<>2 as is_mandatory, p_size>20 as is_read_only from part""")
def tree_data_entity_fields(t):
    return extracted(entity_files(t), "data_entity_fields")["data_entity_fields"]


@query("select p_brand as name, 'Public5' as public_entity_name, string_agg('V'||p_partkey||':'||(p_size>20), ',' order by 'V'||p_partkey) as fields from part where p_brand='Brand#5' group by all")
def get_data_entity(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(entity_files(t), "data_entities")), "data_entities", "Public5")
    return got.select("name", "public_entity_name", listed("fields", "name", "is_read_only").alias("fields"))


def report_files(t) -> DataFrame:
    source = F.when(F.col("p_partkey") % 2 == 0, tag("Query", F.col("p_type"))).otherwise(tag("Class", F.col("p_type")))
    return parts_of(t, "AxReport", "AxReport", "DataSets", "AxReportDataSet", tag("Name", item()), source)


@query("""select p_brand as report, p_brand as model, 'V'||p_partkey as name, case when p_partkey%2=0 then 'Query' else 'ReportDataProvider' end as kind, p_type as query_or_class from part""")
def tree_report_data_sets(t):
    return extracted(report_files(t), "report_data_sets")["report_data_sets"]


@query("select p_brand as name, 'Report' as kind, string_agg('V'||p_partkey||':'||p_type, ',' order by 'V'||p_partkey) as sets from part where p_brand='Brand#7' group by all")
def get_report(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(report_files(t), "reports")), "reports", "Brand#7")
    return got.select("name", "kind", listed("data_sets", "name", "query_or_class").alias("sets"))


def service_files(t) -> list[DataFrame]:
    method = F.when(F.col("p_partkey") % 2 == 0, tag("Method", F.col("p_type"))).otherwise(tag("MethodName", F.col("p_name")))
    return [
        parts_of(t, "AxService", "AxService", "Operations", "AxServiceOperation", tag("Name", item()), method, more=(tag("Class", "C"),)),
        parts_of(t, "AxServiceGroup", "AxServiceGroup", "Services", "AxServiceGroupService", tag("Name", "x"), tag("Service", item())),
    ]


@query("""select p_brand as service, p_brand as model, 'V'||p_partkey as operation_name, case when p_partkey%2=0 then p_type else p_name end as method_name from part""")
def tree_service_operations(t):
    return extracted(service_files(t), "service_operations")["service_operations"]


@query("select p_brand as name, 'C' as class, string_agg('V'||p_partkey, ',' order by 'V'||p_partkey) as operations from part where p_brand='Brand#2' group by all")
def get_service(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(service_files(t), "services")), "services", "Brand#2")
    return got.select("name", "class", listed("operations", "operation_name").alias("operations"))


@query("select p_brand as name, string_agg('V'||p_partkey, ',' order by 'V'||p_partkey) as members from part where p_brand='Brand#2' group by all")
def get_service_group(t):
    got = details.get(Catalogue(t.spark, tables=extracted_once(service_files(t), "service_groups")), "service_groups", "Brand#2")
    return got.select("name", listed("members", "service_name").alias("members"))


def workflow_files(t) -> DataFrame:
    document = F.when(F.col("c_custkey") % 2 == 0, tag("DocumentClass", F.col("c_mktsegment"))).otherwise(tag("Document", "Doc"))
    return files(customers(t), "AxWorkflowType", F.col("c_name"), tag("AxWorkflowType", tag("Name", F.col("c_name")), document))


@query("select c_name as name, n_name as model, case when c_custkey%2=0 then c_mktsegment else 'Doc' end as document_class from customer join nation on n_nationkey=c_nationkey")
def tree_workflow_types(t):
    return extracted(workflow_files(t), "workflow_types")["workflow_types"].select("name", "model", "document_class")


# ---------------------------------------------------------------- descriptors, labels, files that can't be read


@query("""select r_name as model, min('M'||s_nationkey) as target, count(distinct s_nationkey) as n from region join nation on n_regionkey=r_regionkey join supplier on s_nationkey=n_nationkey group by r_name""")
def tree_descriptors(t):
    """References that differ in case only are one."""
    low = tag("string", F.concat(F.lit("m"), F.col("s_nationkey").cast("string")))
    both = gathered(suppliers(t), "r_name", F.concat(tag("string", F.concat(F.lit("M"), F.col("s_nationkey").cast("string"))), low), ["s_suppkey"], "refs")
    xml = tag("AxModelInfo", tag("Name", F.col("r_name")), tag("Publisher", "P"), tag("ModuleReferences", F.col("refs")))
    _, deps = parse_descriptors(both.select(F.concat(F.lit("root/p/Descriptor/"), "r_name", F.lit(".xml")).alias("path"), xml.cast("binary").alias("content")))
    return deps.groupBy("model").agg(F.min("target").alias("target"), F.count("*").alias("n"))


@query("""select n_name as model, 'L' as label_file, 'en' as language, 'K'||s_suppkey as key, s_name||'=x' as value from supplier join nation on n_nationkey=s_nationkey where s_suppkey%5<>0""")
def tree_label_lines(t):
    line = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("; "), "s_name")).otherwise(F.concat(F.lit("\ufeff K"), F.col("s_suppkey").cast("string"), F.lit(" ="), F.col("s_name"), F.lit("=x\r")))
    return label_rows(suppliers(t).select(line.alias("line"), F.concat(F.lit("root/p/"), F.col("n_name"), F.lit("/AxLabelFile/L.en.label.txt")).alias("path")))


@query("""select n_name as model, 'F' as label_file, case when c_custkey%2=0 then 'cs' else 'en-us' end as language, c_name as key, c_mktsegment as value from customer join nation on n_nationkey=c_nationkey""")
def tree_inline_labels(t):
    value = F.when(F.col("c_custkey") % 3 == 0, tag("Text", F.col("c_mktsegment"))).otherwise(tag("Value", F.col("c_mktsegment")))
    xml = tag("AxLabel", tag("LabelFile", "F"), tag("Key", F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, tag("Language", "cs")), value)
    return inline_labels(parse_files(dealt(files(customers(t), "AxLabelFile", F.col("c_name"), xml))))


@query("select 'root/'||r_name||'/'||n_name||'/AxTable/'||s_name||'.xml' as source_path, 'XML_PARSE' as rule from supplier join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey where s_suppkey%3=0")
def tree_unreadable(t):
    xml = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<AxTable><Name>"), "s_name")).otherwise(tag("AxTable", tag("Name", F.col("s_name"))))
    return lint.review_unreadable(parse_files(dealt(files(suppliers(t), "AxTable", F.col("s_name"), xml)))).select("source_path", "rule")


@query("""select 'root/'||r_name||'/'||n_name||'/AxTable/'||s_name||'.xml' as source_path, rule from (select *, unnest(list_filter([case when s_suppkey%2=0 then 'FIELD_WITHOUT_EDT' end, case when s_suppkey%3=0 then 'FIELD_WITHOUT_LABEL' end], lambda x: x is not null)) as rule from supplier) join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey""")
def review_fields(t):
    f = tag("AxTableField", tag("Name", "F"), F.when(F.col("s_suppkey") % 2 != 0, tag("ExtendedDataType", "E")), F.when(F.col("s_suppkey") % 3 != 0, tag("Label", "L")))
    e = extracted(files(suppliers(t), "AxTable", F.col("s_name"), tag("AxTable", tag("Name", F.col("s_name")), tag("Fields", f))), "tables", "table_fields")
    paths = e["tables"].select(F.col("name").alias("table"), "model", "source_path")
    return lint.review_fields(e["table_fields"].join(paths, ["table", "model"])).select("source_path", "rule")


# ---------------------------------------------------------------- searches by kind, labels, usages


def searchable(t) -> Catalogue:
    """A catalogue given as tables: parts of each type are another kind."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    plain = c.select(F.col("c_name").alias("name"), F.col("n_name").alias("model"), "c_custkey", "c_mktsegment")
    kinds = ["tables", "classes", "edts", "enums", "queries", "views", "reports", "services"]
    own = {k: plain.filter(F.col("c_custkey") % len(kinds) == i).select("name", "model") for i, k in enumerate(kinds)}
    own["data_entities"] = plain.select("name", "model", F.concat(F.lit("Pub"), "c_mktsegment").alias("public_entity_name"), F.concat(F.lit("All"), "model").alias("public_collection_name"))
    own["workflow_types"] = plain.select("name", "model", F.col("c_mktsegment").alias("document_class"))
    return Catalogue(t.spark, tables=own)


def _search(kind: str, i: int) -> None:
    sql = f"select c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where c_custkey%8={i} and c_name ilike '%000{i}%' order by name, model limit 50"
    f = lambda t: search.search_kind(searchable(t), kind, f"000{i}").select("name", "model")
    f.__name__ = f"search_{kind}"
    query(sql)(f)


for _i, _kind in enumerate(["tables", "classes", "edts", "enums", "queries", "views", "reports", "services"]):
    _search(_kind, _i)


@query("select c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where (c_name ilike '%nation_1%' or 'Pub'||c_mktsegment ilike '%nation_1%' or 'All'||n_name ilike '%nation_1%') and n_name='NATION_12' order by name, model limit 50")
def search_data_entities(t):
    return search.search_kind(searchable(t), "data_entities", "nation_1", model="NATION_12").select("name", "model")


@query("select c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where c_name ilike '%build%' or c_mktsegment ilike '%build%' order by name, model limit 50")
def search_workflow_types(t):
    return search.search_kind(searchable(t), "workflow_types", "build").select("name", "model")


def labels_of(t) -> DataFrame:
    return t.customer.select(F.upper("c_mktsegment").alias("label_file"), F.when(F.col("c_custkey") % 2 == 0, "en-us").otherwise("cs").alias("language"), F.concat(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(""), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"))


LABELS = "select upper(c_mktsegment) as label_file, case when c_custkey%2=0 then 'en-us' else 'cs' end as language, case when c_custkey%3=0 then c_mktsegment else '' end||c_custkey as key, c_name as value from customer"


@query(f"select * from ({LABELS}) where lower(label_file)='building' and language='en-us' and lower(key) in (select lower(key) from ({LABELS}) where label_file='BUILDING' and language='en-us' order by value limit 1)")
def get_label(t):
    labels = labels_of(t)
    first = labels.filter("label_file = 'BUILDING' AND language = 'en-us'").orderBy("value").first()
    return details.get_label(labels, "Building", "EN-US", first["key"].lower())


@query(f"select * from ({LABELS}) where lower(key)=lower('7')")
def get_label_by_key(t):
    return details.get_label_by_key(labels_of(t), "@7")


@query(f"""with l as ({LABELS}), tok as (select '@'||key as token, key as raw, regexp_extract(key,'^([A-Za-z]*)',1) as pre, regexp_extract(key,'^[A-Za-z]*(.*)$',1) as suf from l where language='en-us'), m as (select * from l where language='en-us')
 select distinct token, m.* from tok join m on m.key=tok.raw or (m.label_file=tok.pre and m.key=tok.suf)""")
def resolve_labels(t):
    labels = labels_of(t)
    tokens = labels.filter("language = 'en-us'").select(F.concat(F.lit("@"), "key").alias("token"))
    return search.resolve_token(labels, tokens, ["EN-US"])


@query("select needle, count(c_custkey) as hits from (select distinct substr(p_name, 1, 1+(p_partkey%4)::int)||(p_partkey%10) as needle from part) left join customer on contains(lower(c_name), lower(needle)) group by needle")
def batch_search_many(t):
    """A table of needles: joined, not tested one by one."""
    needles = t.part.select(F.concat(F.expr("substr(p_name, 1, 1 + p_partkey % 4)"), (F.col("p_partkey") % 10).cast("string")).alias("needle"))
    return search.batch_search(t.customer, needles, "c_name", few=0)


@query("""select n_name as name, coalesce(a.k,0) as tables, coalesce(b.k,0) as classes from nation left join (select c_nationkey, count(*) k from customer group by 1) a on a.c_nationkey=n_nationkey left join (select s_nationkey, count(*) k from supplier group by 1) b on b.s_nationkey=n_nationkey""")
def stats_of_models(t):
    rows = lambda df, kind, name: files(df, kind, F.col(name), tag(kind, tag("Name", F.col(name))))
    e = extracted([rows(customers(t), "AxTable", "c_name"), rows(suppliers(t), "AxClass", "s_name")], "tables", "classes")
    models = t.nation.select(F.col("n_name").alias("name"))
    return stats.counts_per_owner(models, "name", "name", {k: (e[k], "model") for k in ("tables", "classes")})


# ---------------------------------------------------------------- text of source and logs, larger graphs


@query(r"""select event_id, 'C:\src\f'||user_id||'.xpp' as file, (event_id%97)::int as line, (user_id%13)::int as col, case when event_type='error' then 'error' else 'warning' end as kind, 'BP'||user_id as code, event_type||': '||event_id as message from events where event_type<>'signup'""")
def log_diagnostics(t):
    from lodestrata.functions.text import log_diagnostic

    head = F.concat(F.lit("  C:\\src\\f"), F.col("user_id").cast("string"), F.lit(".xpp("), (F.col("event_id") % 97).cast("string"), F.lit(","), (F.col("user_id") % 13).cast("string"), F.lit("): "))
    tail = F.concat(F.when(F.col("event_type") == "error", "Error").otherwise("WARNING"), F.lit(" BP"), F.col("user_id").cast("string"), F.lit(": "), F.col("event_type"), F.lit(": "), F.col("event_id").cast("string"))
    line = F.when(F.col("event_type") == "signup", "Build started").otherwise(F.concat(head, tail))
    return t.events.select("event_id", log_diagnostic(line).alias("d")).filter("d IS NOT NULL").select("event_id", "d.*")


@query("select o_orderkey, case when o_orderkey%4 in (0,1,2) then true when o_orderkey%4=3 and o_custkey%7=0 then null else false end as yes from orders")
def to_bool(t):
    from lodestrata.functions import text

    v = F.when(F.col("o_orderkey") % 4 == 0, "1").when(F.col("o_orderkey") % 4 == 1, " TRUE").when(F.col("o_orderkey") % 4 == 2, "Yes").when(F.col("o_custkey") % 7 != 0, "maybe")
    return t.orders.select("o_orderkey", text.to_bool(v).alias("yes"))


@query("select o_orderkey, case o_orderkey%4 when 0 then 'Parameter' when 1 then 'WorksheetLine' when 2 then 'Main' end as pattern, case o_orderkey%4 when 0 then 'SimpleListDetails' when 1 then 'TableOfContents' when 2 then 'Lookup' else 'SimpleList' end as form from orders")
def pattern_aliases(t):
    from lodestrata.functions import text

    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", text.table_pattern(pick("Set-Up", "Lines", "MASTER", "other")).alias("pattern"), text.form_pattern(pick("simple list + details", "To C", "look-up", "what")).alias("form"))


def all_trade(t) -> DataFrame:
    """Distinct edges from customers to the suppliers of all their lines, and back where a line was returned."""
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"), "l_returnflag")
    back = lines.filter("l_returnflag = 'R'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return lines.select("src", "dst").unionByName(back).distinct()


ALL_TRADE = """select distinct 'C'||o_custkey as src, 'S'||l_suppkey as dst from lineitem join orders on o_orderkey=l_orderkey union select 'S'||l_suppkey, 'C'||o_custkey from lineitem join orders on o_orderkey=l_orderkey where l_returnflag='R'"""


@query(f"""with e as ({ALL_TRADE}), n as (select src as v from e union select dst from e), fo as (select src, count(*) k from e group by 1), fi as (select dst, count(*) k from e group by 1)
 select v, coalesce(fo.k,0) as fan_out, coalesce(fi.k,0) as fan_in, round_even(cast(coalesce(fo.k,0) as double)/(coalesce(fo.k,0)+coalesce(fi.k,0)),3) as instability from n left join fo on fo.src=v left join fi on fi.dst=v""")
def coupling_of_trade(t):
    edges = all_trade(t)
    return graph.coupling(edges, graph.nodes_of(edges))


@query(None)
def scc_of_trade(t):
    """Components of a graph of many nodes, by colours; SQL would build all pairs, so a test holds it against brute force."""
    return graph.strong_components(all_trade(t), closure_nodes=0)


@query("select n_name as model, n_name||'+' as fingerprint from nation where n_nationkey%3=0 or n_nationkey>=20")
def changed_models(t):
    from lodestrata.plans.catalogue import changed_models as changed

    stored = t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("model"), F.when(F.col("n_nationkey") % 3 == 0, "old").otherwise(F.concat("n_name", F.lit("+"))).alias("fingerprint"))
    now = t.nation.select(F.col("n_name").alias("model"), F.concat("n_name", F.lit("+")).alias("fingerprint"), F.lit("2024-01-01").cast("timestamp").alias("newest"))
    return changed(now, stored).select("model", "fingerprint")


@query("select c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where n_nationkey not in (4,5) union all select c_name||'*', n_name from customer join nation on n_nationkey=c_nationkey where n_nationkey=5")
def replaced_models(t):
    """The writer's own path: of a store's models one is replaced, one keeps no row, and a write that no version names is not seen."""
    import uuid

    from lodestrata.plans.snapshots import Snapshots
    from lodestrata.session import shared_dir

    store = Snapshots(t.spark, f"{shared_dir(t.spark)}/stores/{uuid.uuid4().hex}")
    rows = customers(t).select(F.col("c_name").alias("name"), F.col("n_name").alias("model"))
    changed = rows.filter("model = 'NATION_5'").withColumn("name", F.concat("name", F.lit("*")))
    models = [r["n_name"] for r in t.nation.select("n_name").collect()]
    for df, replaced, seen in ((rows, models, True), (changed, ["NATION_4", "NATION_5"], True), (rows, models, False)):
        version, write = store.manifest().following(), store.new_write()
        store.put("tables", df, write)
        version.replaced("objects", replaced, write)
        if seen:
            store.commit(version)
    return store.rows(store.manifest(), "tables", rows.schema, "objects")


@query("""select 'r/'||coalesce(a.o_orderkey,b.o_orderkey) as source_path, coalesce(a.o_orderstatus,b.o_orderstatus) as model, case when a.o_orderkey is null then 'removed' when b.o_orderkey is null then 'added'
 when a.o_orderkey%5<>0 then 'same' when a.o_orderkey%2=0 then 'changed' else 'touched' end as status from (select * from orders where o_orderkey%7<>0) a full join (select * from orders where o_orderkey%11<>0) b on a.o_orderkey=b.o_orderkey""")
def changed_files(t):
    """Orders as files of two listings: some are new, gone, of another time, or of other content too."""
    from lodestrata.sources.changes import compared

    k = F.col("o_orderkey")
    state = lambda later, mark: t.orders.select(F.concat(F.lit("r/"), k.cast("string")).alias("source_path"), F.lit("P").alias("package"), F.col("o_orderstatus").alias("model"), F.lit("AxTable").alias("kind"), (k % 100).alias("size"),
        F.timestamp_seconds(F.lit(0) + F.when(k % 5 == 0, later).otherwise(0)).alias("modified"), F.concat(k.cast("string"), F.when((k % 10 == 0), mark).otherwise("")).alias("hash"), k)
    now, before = state(60, "new").filter(k % 7 != 0).drop("o_orderkey"), state(0, "").filter(k % 11 != 0).drop("o_orderkey")
    return compared(now.drop("hash"), before, now.select("source_path", "hash")).select("source_path", "model", "status")
