import datetime
import os

import pytest

from lodestrata.operators import details, lint, relations, search, stats
from lodestrata.plans import catalogue as cat
from lodestrata.sources.labels import read_label_files
from lodestrata.sources.tree import parse_tree
from lodestrata.streaming.ingest import ingest_available

TABLE = """<AxTable><Name>DemoTable</Name><Label>Demo</Label><Fields>
<AxTableField><Name>Code</Name><ExtendedDataType>Name</ExtendedDataType><Mandatory>Yes</Mandatory></AxTableField>
<AxTableFieldString><Name>Raw</Name><Type>String</Type></AxTableFieldString></Fields>
<Relations><AxTableRelation><Name>R</Name><RelatedTable>Other</RelatedTable><Cardinality>ZeroMore</Cardinality></AxTableRelation></Relations>
<Indexes><AxTableIndex><Name>CodeIdx</Name><AllowDuplicates>No</AllowDuplicates><AlternateKey>Yes</AlternateKey><Fields><AxTableIndexField><DataField>Code</DataField></AxTableIndexField><AxTableIndexField><DataField>Raw</DataField></AxTableIndexField></Fields></AxTableIndex></Indexes>
<DeleteActions><AxTableDeleteAction><Name>D</Name><RelatedTable>Other</RelatedTable><DeleteAction>Cascade</DeleteAction></AxTableDeleteAction></DeleteActions></AxTable>"""
ENUM = "<AxEnum><Name>DemoEnum</Name><EnumValues><AxEnumValue><Name>One</Name><Value>0</Value></AxEnumValue><AxEnumValue><Name>Two</Name><Value>x</Value></AxEnumValue></EnumValues></AxEnum>"
CLASS = """<AxClass><Name>Cust_Extension</Name><SourceCode><Declaration><![CDATA[[ExtensionOf(tableStr(DemoTable))]
public final class Cust_Extension]]></Declaration><Methods><Method><Name>update</Name><Source><![CDATA[    [DataEventHandler(tableStr(DemoTable), DataEventType::Inserted)]
    public static void update(Common c)
    { DemoTable t; demotable u; DemoTableX v; }]]></Source></Method></Methods></SourceCode></AxClass>"""
FORM = "<AxForm><Name>DemoForm</Name><DataSources><AxFormDataSource><Name>A</Name><Table>DemoTable</Table></AxFormDataSource><AxFormDataSource><Name>B</Name><Table>Other</Table><JoinSource>A</JoinSource></AxFormDataSource></DataSources><Design><Pattern>SimpleList</Pattern><PatternVersion>1.1</PatternVersion></Design></AxForm>"
QUERY = "<AxQuery><Name>Q</Name><DataSources><AxQuerySimpleRootDataSource><Name>A</Name><Table>T</Table><DataSources><AxQuerySimpleEmbeddedDataSource><Name>B</Name><DataSources><AxQuerySimpleEmbeddedDataSource><Name>C</Name></AxQuerySimpleEmbeddedDataSource></DataSources></AxQuerySimpleEmbeddedDataSource></DataSources></AxQuerySimpleRootDataSource></DataSources></AxQuery>"
FILES = {
    "Pkg/ModelA/AxTable/DemoTable.xml": TABLE, "Pkg/ModelA/AxTable/Bad.xml": "<AxTable><Name>", "Pkg/ModelA/AxEnum/DemoEnum.xml": ENUM, "Pkg/ModelA/AxClass/Cust_Extension.xml": CLASS,
    "Pkg/ModelA/AxForm/DemoForm.xml": FORM, "Pkg/ModelA/AxQuery/Q.xml": QUERY, "Pkg/ModelA/AxEdt/E.xml": "<AxEdtString><Name>VinEdt</Name><StringSize>17</StringSize></AxEdtString>",
    "Pkg/ModelA/AxMenuItemDisplay/M.xml": "<AxMenuItemDisplay><Name>M</Name><Object>DemoForm</Object></AxMenuItemDisplay>",
    "Pkg/ModelA/AxTableExtension/X.xml": "<AxTableExtension><Name>DemoTable.Fleet</Name></AxTableExtension>",
    "Pkg/ModelA/AxView/V.xml": "<AxView><Name>V</Name><Query>Q</Query><Fields><AxViewField><Name>F</Name><DataSource>A</DataSource><DataField>Code</DataField></AxViewField></Fields></AxView>",
    "Pkg/ModelA/AxDataEntityView/DE.xml": "<AxDataEntityView><Name>DE</Name><PublicEntityName>Demo</PublicEntityName><Fields><AxDataEntityViewField><Name>F</Name><IsMandatory>Yes</IsMandatory><AllowEdit>No</AllowEdit></AxDataEntityViewField></Fields></AxDataEntityView>",
    "Pkg/ModelA/AxReport/Rp.xml": "<AxReport><Name>Rp</Name><DataSets><AxReportDataSet><Name>Ds</Name><Query>Q</Query></AxReportDataSet></DataSets></AxReport>",
    "Pkg/ModelA/AxService/Sv.xml": "<AxService><Name>Sv</Name><Class>C</Class><Operations><AxServiceOperation><Name>op</Name><Method>m</Method></AxServiceOperation></Operations></AxService>",
    "Pkg/ModelA/AxServiceGroup/Sg.xml": "<AxServiceGroup><Name>Sg</Name><Services><AxServiceGroupService><Name>x</Name><Service>Sv</Service></AxServiceGroupService></Services></AxServiceGroup>",
    "Pkg/ModelA/AxWorkflowType/W.xml": "<AxWorkflowType><Name>W</Name><Document>Doc</Document></AxWorkflowType>",
    "Pkg/ModelA/AxSecurityRole/R1.xml": "<AxSecurityRole><Name>R1</Name><Duties><AxSecurityDutyReference><Name>D1</Name></AxSecurityDutyReference></Duties><Privileges><AxSecurityPrivilegeReference><Name>P3</Name></AxSecurityPrivilegeReference></Privileges></AxSecurityRole>",
    "Pkg/ModelA/AxSecurityDuty/D1.xml": "<AxSecurityDuty><Name>D1</Name><Privileges><P><Name>P1</Name></P><P><Name>P2</Name></P></Privileges></AxSecurityDuty>",
    "Pkg/ModelA/AxSecurityPrivilege/P1.xml": "<AxSecurityPrivilege><Name>P1</Name><EntryPoints><E><ObjectName>MI1</ObjectName><ObjectType>MenuItemDisplay</ObjectType></E></EntryPoints></AxSecurityPrivilege>",
    "Pkg/ModelA/AxSecurityPrivilege/P3.xml": "<AxSecurityPrivilege><Name>P3</Name><EntryPoints><E><ObjectName>MI2</ObjectName><ObjectType>MenuItemAction</ObjectType></E></EntryPoints></AxSecurityPrivilege>",
    "Pkg/ModelB/AxTable/T2.xml": "<AxTable><Name>T2</Name></AxTable>", "PkgFormAdaptor/M/AxTable/T.xml": "<AxTable><Name>T</Name></AxTable>",
    "Pkg/Descriptor/ModelA.xml": "<AxModelInfo><Name>modela</Name><Publisher>Contoso</Publisher><Layer>usr</Layer><ModuleReferences><string>Base</string><string>BASE</string></ModuleReferences></AxModelInfo>",
    "Pkg/ModelA/AxLabelFile/Fleet.en-us.label.txt": "﻿;note\nTitle=Fleet Manager\n\nMultiEq=a=b=c\n", "Pkg/ModelA/AxLabelFile/Fleet.cs.label.txt": "Title=Správce\n",
}


def write(root, files):
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(content)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    write(root, FILES)
    return root


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    assert cat.refresh(spark, tree, path) == ["ModelA", "ModelB"]
    return path


@pytest.fixture(scope="module")
def catalogue(spark, store):
    return cat.Catalogue(spark, store)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_bad_files_are_reported(spark, tree):
    df = parse_tree(spark, tree)
    assert [r["source_path"].rsplit("/", 1)[-1] for r in df.filter("error IS NOT NULL").collect()] == ["Bad.xml"]
    assert "M" not in {r["model"] for r in df.select("model").distinct().collect()}


def test_tables(catalogue):
    assert rows(catalogue.table("table_fields"), "table", "name", "type", "edt_name", "mandatory") == [("DemoTable", "Code", "ExtendedDataType", "Name", True), ("DemoTable", "Raw", "String", None, False)]
    assert rows(catalogue.table("table_indexes"), "name", "allow_duplicates", "alternate_key", "fields") == [("CodeIdx", False, True, ["Code", "Raw"])]
    assert rows(catalogue.table("relations"), "from_table", "to_table", "cardinality") == [("DemoTable", "Other", "ZeroMore")]
    assert rows(catalogue.table("enum_values"), "name", "value") == [("One", 0), ("Two", None)]
    assert rows(catalogue.table("edts"), "name", "base_type", "string_size") == [("VinEdt", "String", 17)]
    assert rows(catalogue.table("form_data_sources"), "name", "order_index", "join_source") == [("A", 0, None), ("B", 1, "A")]
    assert rows(catalogue.table("query_data_sources"), "name", "parent_ds") == [("A", None), ("B", "A"), ("C", "B")]
    assert rows(catalogue.table("object_extensions"), "kind", "target_name") == [("Table", "DemoTable")]
    assert rows(catalogue.table("data_entity_fields"), "name", "is_mandatory", "is_read_only") == [("F", True, True)]
    assert rows(catalogue.table("report_data_sets"), "name", "kind", "query_or_class") == [("Ds", "Query", "Q")]
    assert rows(catalogue.table("service_group_members"), "service_name") == [("Sv",)]
    assert rows(catalogue.table("workflow_types"), "name", "document_class") == [("W", "Doc")]
    assert rows(catalogue.table("models"), "name", "publisher", "layer") == [("ModelA", "Contoso", "usr"), ("ModelB", None, None)]
    assert rows(catalogue.table("model_dependencies"), "target") in ([("BASE",)], [("Base",)])


def test_classes(catalogue):
    assert rows(catalogue.table("classes"), "name", "is_final", "is_abstract") == [("Cust_Extension", True, False)]
    assert rows(catalogue.table("methods"), "name", "return_type", "is_static") == [("update", "void", True)]
    assert rows(relations.coc_extensions(catalogue.table("coc"), "DemoTable"), "target_method", "extension_class") == [("update", "Cust_Extension")]
    assert rows(relations.event_subscribers(catalogue.table("event_subscribers"), "DemoTable"), "source_kind", "event_type") == [("Table", "Inserted")]
    refs = relations.source_references(catalogue.table("methods"), "DEMOTABLE").collect()
    assert len(refs) == 1 and len(refs[0]["sample_lines"]) == 2


def test_security(catalogue):
    assert rows(catalogue.security(), "role", "duty", "privilege", "object_name") == sorted([("R1", "D1", "P1", "MI1"), ("R1", "D1", "P2", None), ("R1", None, "P3", "MI2")], key=repr)
    assert rows(relations.security_coverage(catalogue.security(), "mi1", "menuitemdisplay"), "role", "privilege") == [("R1", "P1")]


def test_details_and_searches(catalogue):
    t = details.get(catalogue, "tables", "DemoTable").first()
    assert [f["name"] for f in t["fields"]] == ["Code", "Raw"] and t["indexes"][0]["name"] == "CodeIdx" and t["methods"] == []
    assert "indexes" not in details.get(catalogue, "tables", "DemoTable", include=["fields"]).columns
    assert details.get(catalogue, "tables", "Nope").count() == 0
    assert details.get(catalogue, "data_entities", "Demo").first()["name"] == "DE"
    assert [v["name"] for v in details.get(catalogue, "enums", "DemoEnum").first()["values"]] == ["One", "Two"]
    assert rows(search.search_kind(catalogue, "data_entities", "demo"), "name") == [("DE",)]
    assert {r["kind"] for r in search.find_usages(catalogue.objects(), "demo").collect()} == {"Table", "Enum", "Form", "DataEntity", "MenuItem"}
    f = relations.form_patterns(catalogue.table("forms"), catalogue.table("form_data_sources"), "Simple", "Other").first()
    assert (f["name"], f["primary_table"], f["data_source_count"]) == ("DemoForm", "DemoTable", 2)
    assert dict((r["k"], r["n"]) for r in catalogue.counts().collect())["tables"] == 2


def test_lint(spark, catalogue):
    assert rows(lint.tables_without_index(catalogue, only_custom=False), "name") == [("T2",)]
    assert rows(lint.unmarked_extensions(catalogue), "name") == []
    assert rows(lint.string_fields_without_type(catalogue, only_custom=False), "target") == [("DemoTable.Raw",)]
    assert rows(lint.review_sources(spark.createDataFrame([("p", 'x = "abc"; y = @"de f"; z = "a"; str2Con(q); new Query()')], "source_path string, content string")), "rule") == [("DYNAMIC_QUERY",), ("HARDCODED_STRING",), ("HARDCODED_STRING",)]


def test_labels(spark, tree):
    df = read_label_files(spark, tree)
    assert rows(df, "model", "label_file", "language", "key", "value") == sorted([("ModelA", "Fleet", "en-us", "Title", "Fleet Manager"), ("ModelA", "Fleet", "en-us", "MultiEq", "a=b=c"), ("ModelA", "Fleet", "cs", "Title", "Správce")], key=repr)
    assert read_label_files(spark, tree, ["CS"]).count() == 1
    assert details.get_label(df, "FLEET", "EN-US", "title").first()["value"] == "Fleet Manager"
    assert search.search_labels(df, "manager", ["EN-us"]).count() == 1


def test_resolve_token(spark):
    labels = spark.createDataFrame([("SYS", "en-us", "SYS12345", "a"), ("SYS", "en-us", "12345", "b"), ("ABC", "cs", "SYS12345", "c"), ("XYZ", "en-us", "12345", "d")], "label_file string, language string, key string, value string")
    got = search.resolve_token(labels, spark.createDataFrame([("@SYS12345",)], "token string"))
    assert rows(got, "value") == [("a",), ("b",), ("c",)]
    text = spark.createDataFrame([(1, "See @SYS1 and @ABC9"), (2, None), (3, "plain")], "id int, t string")
    known = spark.createDataFrame([("SYS", "en-us", "SYS1", "text")], "label_file string, language string, key string, value string")
    assert rows(relations.inline_labels(text, known, "t", "id"), "id", "t") == [(1, "See text [[@SYS1]] and @ABC9"), (2, None), (3, "plain")]


def test_refresh_reads_what_changed(spark, tmp_path):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, {"P/A/AxTable/T.xml": "<AxTable><Name>T</Name></AxTable>", "P/B/AxTable/U.xml": "<AxTable><Name>U</Name></AxTable>", "P/B/AxLabelFile/L.en.label.txt": "k=v"})
    held = lambda: rows(cat.Catalogue(spark, path).table("tables"), "name", "model")
    assert cat.refresh(spark, root, path) == ["A", "B"]
    before = held()
    assert cat.refresh(spark, root, path) == []
    assert cat.refresh(spark, root, path, force=True) == ["A", "B"]
    assert held() == before == [("T", "A"), ("U", "B")]
    write(root, {"P/A/AxTable/T3.xml": "<AxTable><Name>T3</Name></AxTable>"})
    assert cat.refresh(spark, root, path, since=datetime.datetime(2100, 1, 1)) == []
    assert cat.refresh(spark, root, path) == ["A"]
    assert held() == [("T", "A"), ("T3", "A"), ("U", "B")]
    assert not cat.ensure_schema(spark, path)
    assert rows(spark.read.parquet(f"{path}/extraction_runs"), "model", "n_objects") == [("A", 1), ("A", 1), ("A", 2), ("B", 2), ("B", 2)]


def test_refresh_drops_what_is_gone(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, {"P/A b/AxForm/F.xml": FORM, "P/A b/AxTable/T.xml": TABLE, "P/B/AxForm/G.xml": FORM, "P/C/AxTable/U.xml": TABLE})
    kinds = {"AxForm": "forms", "AxTable": "tables"}

    def read_tree(spark, root, models, languages, custom):
        found = [(kinds[k], m) for m in models for k in os.listdir(f"{root}/P/{m}") if os.listdir(f"{root}/P/{m}/{k}")]
        return {t: spark.createDataFrame([(k, m) for k, m in found if k == t], "name string, model string") for t in kinds.values()}

    monkeypatch.setattr(cat, "read_tree", read_tree)
    held = lambda m: {t for t in kinds.values() if m in {r["model"] for r in cat.Catalogue(spark, path).table(t).collect()}}
    assert cat.refresh(spark, root, path) == ["A b", "B", "C"]
    assert held("A b") == {"forms", "tables"} and held("C") == {"tables"}
    os.remove(f"{root}/P/A b/AxForm/F.xml")
    os.remove(f"{root}/P/C/AxTable/U.xml")
    assert cat.refresh(spark, root, path) == ["A b", "C"]
    assert held("A b") == {"tables"} and held("B") == {"forms"} and held("C") == set()
    assert rows(cat.Catalogue(spark, path).table("forms"), "model") == [("B",)]
    assert cat.refresh(spark, root, path) == []
    assert rows(cat.Catalogue(spark, path).table("models"), "name") == [("A b",), ("B",)]


DESCRIPTOR = "<AxModelInfo><Name>{}</Name><Publisher>{}</Publisher><Layer>usr</Layer><ModuleReferences>{}</ModuleReferences></AxModelInfo>"


def test_refresh_follows_descriptors_and_knows_models_from_packages(spark, tmp_path):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    ref = lambda *names: "".join(f"<string>{n}</string>" for n in names)
    write(root, {"Pkg/A/AxTable/T.xml": "<AxTable><Name>T</Name></AxTable>", "Pkg/B/AxTable/U.xml": "<AxTable><Name>U</Name></AxTable>", "Pkg/Descriptor/A.xml": DESCRIPTOR.format("a", "One", ref("Base"))})
    assert cat.refresh(spark, root, path) == ["A", "B"]
    info = lambda: (rows(cat.Catalogue(spark, path).table("models"), "name", "publisher"), rows(cat.Catalogue(spark, path).table("model_dependencies"), "model", "target"))
    assert info() == ([("A", "One"), ("B", None)], [("A", "Base")])
    held = cat.Catalogue(spark, path).version.models("objects")
    write(root, {"Pkg/Descriptor/A.xml": DESCRIPTOR.format("a", "Another", ref("Base", "Core"))})
    assert cat.refresh(spark, root, path) == ["A"]
    assert info() == ([("A", "Another"), ("B", None)], [("A", "Base"), ("A", "Core")])
    assert cat.Catalogue(spark, path).version.models("objects") == held  # no object was read again
    write(root, {"Pkg/Descriptor/B.xml": DESCRIPTOR.format("B", "Two", "")})
    assert cat.refresh(spark, root, path) == ["B"]
    os.remove(f"{root}/Pkg/Descriptor/A.xml")
    assert cat.refresh(spark, root, path) == ["A"]
    assert info() == ([("A", None), ("B", "Two")], [])
    assert cat.refresh(spark, root, path) == []
    assert {r["model"] for r in spark.read.parquet(f"{path}/extraction_runs").collect()} == {"A", "B"}


def test_a_file_of_a_new_time_alone_is_not_read_again(spark, tmp_path):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, {"P/A/AxTable/T.xml": TABLE, "P/B/AxTable/U.xml": TABLE, "P/A/AxLabelFile/L.en.label.txt": "k=v\n", "P/A/Other/x.xml": "<x/>"})
    assert cat.refresh(spark, root, path) == ["A", "B"]
    held = cat.Catalogue(spark, path).version
    os.utime(f"{root}/P/A/AxTable/T.xml", (2_000_000_000, 2_000_000_000))
    assert cat.refresh(spark, root, path) == []
    now = cat.Catalogue(spark, path).version
    assert now.models("objects") == held.models("objects") and now.number == held.number + 1
    assert cat.refresh(spark, root, path) == [] and cat.Catalogue(spark, path).version.number == now.number  # its time is known now
    os.utime(f"{root}/P/A/AxTable/T.xml", (1_000_000_000, 1_000_000_000))
    write(root, {"P/A/AxLabelFile/L.en.label.txt": "k=w\n"})  # as long as before
    os.utime(f"{root}/P/A/AxLabelFile/L.en.label.txt", (1_500_000_000, 1_500_000_000))
    assert cat.refresh(spark, root, path) == ["A"]
    assert rows(cat.Catalogue(spark, path).table("labels"), "value") == [("w",)]
    assert {r["source_path"].split("/P/")[1] for r in cat.Catalogue(spark, path).table("files").collect()} == {"A/AxTable/T.xml", "B/AxTable/U.xml", "A/AxLabelFile/L.en.label.txt"}


def test_readers_see_one_version_whatever_a_refresh_does(spark, tmp_path, monkeypatch):
    from lodestrata.plans.snapshots import Snapshots, VersionConflict

    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, {"P/A/AxTable/T.xml": "<AxTable><Name>T</Name></AxTable>", "P/A/AxEdt/E.xml": "<AxEdt><Name>E</Name></AxEdt>"})
    cat.refresh(spark, root, path)
    reader = cat.Catalogue(spark, path)
    write(root, {"P/A/AxTable/T.xml": "<AxTable><Name>Tnew</Name></AxTable>", "P/A/AxEdt/E.xml": "<AxEdt><Name>Enew</Name></AxEdt>"})
    whole, seen = Snapshots.put, []

    def broken(self, name, df, write, by_model=True):
        if name == "tables":  # edts, written before or after, must not show either
            raise OSError("killed")
        seen.append(name)
        return whole(self, name, df, write, by_model)

    monkeypatch.setattr(Snapshots, "put", broken)
    with pytest.raises(OSError):
        cat.refresh(spark, root, path)
    names = lambda c: (rows(c.table("tables"), "name"), rows(c.table("edts"), "name"))
    assert names(cat.Catalogue(spark, path)) == names(reader) == ([("T",)], [("E",)])
    monkeypatch.setattr(Snapshots, "put", whole)
    assert cat.refresh(spark, root, path) == ["A"]
    assert names(cat.Catalogue(spark, path)) == ([("Tnew",)], [("Enew",)])
    late = cat.Catalogue(spark, path, version=1)
    assert names(late) == ([("T",)], [("E",)])
    store = Snapshots(spark, path)
    with pytest.raises(VersionConflict):
        store.commit(store.manifest(1))
    assert store.manifest().number == 2 and not [f for f in os.listdir(f"{path}/manifests") if f.startswith("_")]
    assert store.expire(3600) == [] and store.expire(-5) == [1]
    assert names(cat.Catalogue(spark, path)) == ([("Tnew",)], [("Enew",)]) and len(os.listdir(f"{path}/data/tables")) == 1


def test_a_store_of_the_first_schema_version_opens(spark, tmp_path):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    spark.sql("SELECT 1 AS version, current_timestamp() AS applied_utc").write.parquet(f"{path}/schema_version")
    spark.createDataFrame([("T", "A"), ("U", "B c")], "name string, model string").write.partitionBy("model").parquet(f"{path}/tables")
    spark.createDataFrame([("A", "A", "P")], "name string, model string, publisher string").write.partitionBy("model").parquet(f"{path}/models")
    assert cat.ensure_schema(spark, path) and not cat.ensure_schema(spark, path)
    c = cat.Catalogue(spark, path)
    assert rows(c.table("tables"), "name", "model", "label") == [("T", "A", None), ("U", "B c", None)] and rows(c.table("models"), "name", "publisher", "is_custom") == [("A", "P", None)]
    write(root, {"P/A/AxTable/V.xml": "<AxTable><Name>V</Name></AxTable>"})
    assert cat.refresh(spark, root, path) == ["A", "B c"]
    assert rows(cat.Catalogue(spark, path).table("tables"), "name") == [("V",)]


def test_stream(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, {"P/A/AxLabelFile/L.en.label.txt": "\ufeffa=1\n;c\nb=2=3\n"})
    for _ in range(2):
        ingest_available(spark, root, str(tmp_path / "out"), str(tmp_path / "cp"))
    write(root, {"P/B/AxLabelFile/L.en.label.txt": "a=other\n"})
    ingest_available(spark, root, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "model", "key", "value") == [("A", "a", "1"), ("A", "b", "2=3"), ("B", "a", "other")]


def test_tools(catalogue):
    from lodestrata.plans import api

    assert api.call(catalogue, "get_service", name="Nope")["error"]["code"] == "SERVICE_NOT_FOUND"
    assert api.call(catalogue, "nothing")["error"]["code"] == "UNKNOWN_TOOL" and api.call(catalogue, "get_table")["error"]["code"] == "BAD_INPUT"
    got = lambda tool, **p: api.call(catalogue, tool, **p)["data"]["items"]
    assert got("search_table", query="demo")[0]["name"] == "DemoTable"
    assert got("suggest_names", kind="Table", name="DemoTabel")[0]["name"] == "DemoTable"
    assert got("search_labels_fts", query="fleet")[0]["id"] == "ModelA/Fleet/en-us/Title"
    assert got("analyze_extension_points", target="DemoTable")[0]["strategy"] == "coc"
    assert {x["v"] for x in got("models_coupling")} >= {"ModelA", "ModelB"}
    assert got("stats_top_tables")[0] == {"name": "DemoTable", "model": "ModelA", "k": 2}
    assert got("summarize_form_patterns") == [{"pattern": "SimpleList", "cnt": 1}]
    per = {x["name"]: x for x in got("stats_per_model")}
    assert per["ModelA"]["tables"] == 1 and per["ModelA"]["labels"] == 3 and per["ModelB"]["classes"] == 0
    assert got("resolve_label", token="@Title")[0]["label_file"] == "Fleet"
    assert {x["name"] for x in got("find_references", name="DemoTable")} == {"update"}


def test_patterns(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import text

    df = spark.createDataFrame([("Set-Up", "simple list + details"), ("nothing", "ToC"), (None, None)], "t string, f string")
    assert [tuple(r) for r in df.select(text.table_pattern(F.col("t")), text.form_pattern(F.col("f"))).collect()] == [("Parameter", "SimpleListDetails"), (None, "TableOfContents"), (None, "SimpleList")]


def test_files_that_no_parser_takes(spark, tmp_path):
    root = str(tmp_path / "tree")
    bad = {"A": "<AxTable><Name>", "B": "<?xml version='1.0' encoding='no-such-code'?><AxTable/>", "C": "<?xml version='1.0' encoding='UTF-7'?><AxTable/>", "D": "<a>" * 30_000 + "</a>" * 30_000}
    write(root, {f"P/M/AxTable/{k}.xml": v for k, v in bad.items()} | {"P/M/AxTable/Good.xml": TABLE, "P/Descriptor/M.xml": bad["B"]})
    got = {r["source_path"].rsplit("/", 1)[-1]: r["error"] for r in parse_tree(spark, root).collect()}
    assert {k for k, v in got.items() if v} == {f"{k}.xml" for k in bad} and got["Good.xml"] is None
    assert rows(cat.read_tree(spark, root)["unreadable"], "model") == [("M",)] * len(bad)


def test_children_are_those_of_the_model(spark):
    tables = spark.createDataFrame([("T1", "M2", None, "b"), ("T1", "M1", None, "a")], "name string, model string, label string, source_path string")
    fields = spark.createDataFrame([("T1", "M1", "F1"), ("T1", "M2", "G1")], "table string, model string, name string").selectExpr("*", "'String' AS type", "'' AS edt_name", "'' AS label", "false AS mandatory")
    links = spark.createDataFrame([("T1", "U", "M1", "1", "r"), ("V", "T1", "M2", "1", "s"), ("V", "U", "M1", "1", "t")], "from_table string, to_table string, model string, cardinality string, relation_name string")
    c = cat.Catalogue(spark, tables={"tables": tables, "table_fields": fields, "relations": links})
    got = details.get(c, "tables", "T1", include=["fields", "relations"]).first()
    assert (got["model"], [f["name"] for f in got["fields"]]) == ("M1", ["F1"]) and [r["relation_name"] for r in got["relations"]] == ["r", "s"]
    top = stats.top_by_children(tables, fields, "name", "table", "name", within=["model"])
    assert rows(top, "name", "model", "k") == [("T1", "M1", 1), ("T1", "M2", 1)]


def test_custom_models_and_the_label_index(spark, tmp_path):
    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    label = "P/{}/AxLabelFile/L.en.label.txt"
    write(root, {"P/Asl1/AxTable/T.xml": "<AxTable><Name>T</Name></AxTable>", "P/Base/AxTable/U.xml": "<AxTable><Name>U</Name></AxTable>", label.format("Asl1"): "k=fleet manager\n", label.format("Base"): "k=fleet\n"})
    assert cat.refresh(spark, root, path, custom=["Asl*", "!AslTest"]) == ["Asl1", "Base"]
    c = cat.Catalogue(spark, path)
    assert rows(lint.tables_without_index(c), "name", "model") == [("T", "Asl1")]
    assert rows(lint.tables_without_index(c, only_custom=False), "name") == [("T",), ("U",)]
    assert rows(spark.read.parquet(f"{path}/extraction_runs"), "model", "is_custom") == [("Asl1", True), ("Base", False)]
    found = lambda q: rows(cat.Catalogue(spark, path).search_label_texts(q), "id")
    assert found("fleet") == [("Asl1/L/en/k",), ("Base/L/en/k",)] and found('"fleet manager"') == [("Asl1/L/en/k",)]
    write(root, {label.format("Asl1"): "k=other words here\n"})
    os.remove(f"{root}/P/Base/AxTable/U.xml")
    os.remove(f"{root}/{label.format('Base')}")
    assert cat.refresh(spark, root, path) == ["Asl1", "Base"]
    assert found("fleet") == [] and found("oth*") == [("Asl1/L/en/k",)]


def test_stored_and_scanned_text_ranks_agree(spark):
    from lodestrata.operators import fulltext

    docs = spark.createDataFrame([(1, "a b c a", "x"), (2, "b c", "a"), (3, None, "c b"), (4, "", None), (5, "Ábc b", "z")], "id int, t string, u string")
    for query in ("a", "b c", '"b c"', "t:b", "ab*", '"a b" c', "zz"):
        want = rows(fulltext.match(docs, "id", ["t", "u"], query, stored=fulltext.index(docs, "id", ["t", "u"])), "id", "score")
        assert rows(fulltext.match(docs, "id", ["t", "u"], query), "id", "score") == want


def test_many_needles_are_joined(spark):
    names = spark.createDataFrame([(x,) for x in ["CustTable", "custom", "a", "", None, "VendTable", "ab"]], "name string")
    needles = spark.createDataFrame([(x,) for x in ["cust", "TABLE", "a", "ab", "zz", "", "ustT"]], "needle string")
    want = rows(search.batch_search(names, needles), "needle", "hits")
    assert rows(search.batch_search(names, needles, few=2), "needle", "hits") == want and ("TABLE", 2) in want and ("zz", 0) in want


def test_sources_by_path(spark, tree, catalogue):
    from lodestrata.plans import api

    got = lambda tool, **p: api.call(catalogue, tool, **p)["data"]["items"]
    assert [x["kind"] for x in got("read_class", name="Cust_Extension")] == ["Declaration", "Method"]
    assert got("read_class", name="Cust_Extension", method="UPDATE", first=2, last=2)[0]["body"].strip() == "public static void update(Common c)"
    assert "3: " in got("read_class", name="Cust_Extension", method="update", around="demotable u", context=0)[0]["body"]
    assert got("read_table", name="Nope") == [] if api.call(catalogue, "read_table", name="Nope")["ok"] else True
    assert got("read_source", path=f"{tree}/Pkg/ModelA/AxTable/Bad.xml") == []


def test_cross_references_over_jdbc(spark):
    from lodestrata.sources.xref import read_xref

    url, driver = "jdbc:derby:memory:xref;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    one = spark._jvm.java.sql.DriverManager.getConnection(url)
    s = one.createStatement()
    for x in ('CREATE TABLE "Names" ("Id" INT, "Path" VARCHAR(99), "ModuleId" INT)', 'CREATE TABLE "Modules" ("Id" INT, "Module" VARCHAR(99))', 'CREATE TABLE "References" ("SourceId" INT, "TargetId" INT, "Kind" SMALLINT, "Line" SMALLINT, "Column" SMALLINT)',
              """INSERT INTO "Names" VALUES (1, '/Classes/A', 7), (2, '/Tables/Cust', NULL), (3, '/Tables/Customs', NULL)""", """INSERT INTO "Modules" VALUES (7, 'App')""", 'INSERT INTO "References" VALUES (1, 2, 3, 10, 1), (1, 3, 3, 11, 1), (2, 1, 6, 1, 1)'):
        s.execute(x)
    got = relations.cross_references(*read_xref(spark, url, driver, parts=2, bounds=(1, 3)), "Cust", "call")
    assert rows(got, "source", "target", "line", "module") == [("/Classes/A", "/Tables/Cust", 10, "App"), ("/Classes/A", "/Tables/Customs", 11, "App")]


def components(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in after.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    far = {v: reach(v) for v in after}
    return {v: min(w for w in far[v] if v in far.get(w, ())) for v in after if v in far[v]}


def test_components_of_chains_rings_and_what_hangs_on_them(spark):
    import random

    from lodestrata.operators import graph

    r = random.Random(3)
    shapes = {
        "chain": [(i, i + 1) for i in range(70)],
        "rings": [(i, (i + 1) % 40) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)],
        "ears": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 1), (4, 9), (9, 8), (8, 7), (0, 5), (5, 6), (6, 0), (50, 0), (51, 50), (52, 50)],
        "legs": [(i, i + 1) for i in range(30)] + [(100 + i, i) for i in range(30)] + [(31, 60), (60, 61), (61, 31), (30, 31)],
        "random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(75)],
    }
    edges = [(1000 * k + a, 1000 * k + b) for k, shape in enumerate(shapes.values()) for a, b in shape]
    got = graph.strong_components(spark.createDataFrame(edges, "src int, dst int"), closure_nodes=0)
    assert {x["v"]: x["comp"] for x in got.collect()} == components(edges)
    assert graph.strong_components(spark.createDataFrame([], "src int, dst int"), closure_nodes=0).collect() == []


@pytest.mark.parametrize("shape", ["chain", "ring"])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch, shape):
    from lodestrata.operators import graph

    rounds, whole = [0], graph.materialise

    def counted(df):
        rounds[0] += 1
        return whole(df)

    monkeypatch.setattr(graph, "materialise", counted)
    used = {}
    for n in (16, 64):
        rounds[0] = 0
        edges = [(i, i + 1) for i in range(n)] + ([(n, 0)] if shape == "ring" else [])
        assert graph.strong_components(spark.createDataFrame(edges, "src int, dst int"), closure_nodes=0).count() == (n + 1 if shape == "ring" else 0)
        used[n] = rounds[0]
    assert used[64] <= used[16] + 2 * 2 + 1, used


def test_form_patterns_are_those_of_the_model(spark):
    forms = spark.createDataFrame([("F", "M1", "P"), ("F", "M2", "P"), ("G", "M1", "P")], "name string, model string, pattern string")
    sources = spark.createDataFrame([("F", "M1", "A", "A", 0), ("F", "M2", "B", "B", 0), ("F", "M2", "C", "C", 1)], "form string, model string, name string, table_name string, order_index int")
    got = lambda **how: rows(relations.form_patterns(forms, sources, **how), "name", "model", "primary_table", "data_source_count")
    assert got() == [("F", "M1", "A", 1), ("F", "M2", "B", 2), ("G", "M1", None, 0)]
    assert got(table="A") == [("F", "M1", "A", 1)] and got(table="C") == [("F", "M2", "B", 2)]


def test_label_search_by_language_limit_column_and_rank(spark, tmp_path):
    from lodestrata.operators import fulltext

    root, path = str(tmp_path / "tree"), str(tmp_path / "store")
    label = "P/M/AxLabelFile/L.{}.label.txt"
    write(root, {label.format("en-us"): "a=customer world\nb=Customer group of the world customers\nworld=x\n", label.format("cs"): "a=customer\n"})
    cat.refresh(spark, root, path)
    c = cat.Catalogue(spark, path)
    got = lambda q, **how: [(x["language"], x["key"]) for x in c.search_label_texts(q, **how).collect()]
    assert got("customer", languages=["CS"]) == [("cs", "a")] and got("customer")[0] == ("cs", "a")
    assert got("Value:customer", languages=["en-us"]) == [("en-us", "a"), ("en-us", "b")] and got("KEY:world") == [("en-us", "world")]
    assert len(got('customer"', limit=1)) == 0 and len(got('"', limit=1)) == 0
    assert set(c.search_label_texts("customer").columns) == {"id", "label_file", "language", "key", "value", "model", "score"}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a\\b say \"x", "word of", "of words of worth words", "the wide word " * 3])], "id int, t string")
    assert [x["id"] for x in fulltext.match(texts, "id", ["t"], '\\b say "', limit=3).collect()] == [0]
    ranks = {x["id"]: x["score"] for x in fulltext.match(texts, "id", ["t"], "wor*").collect()}
    assert len(ranks) == 3 and all(v > 0 for v in ranks.values()) and len(set(ranks.values())) == 3
    phrase = [x["score"] for x in fulltext.match(texts, "id", ["t"], '"wide word"').collect()]
    plain = [x["score"] for x in fulltext.match(texts, "id", ["t"], "wide word").collect()]
    assert len(phrase) == len(plain) == 1 and phrase[0] < plain[0]  # one term, not two


def test_backslashes_and_patterns_of_the_engine(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import fuzzy, text

    names = spark.createDataFrame([("a\\b", "Table"), ("ab", "Table"), ("a\\%", "Table")], "name string, kind string")
    for strict in (False, True):
        assert rows(names.filter(text.contains_ci(F.col("name"), "A\\B", strict)), "name") == [("a\\b",)]
    assert rows(names.filter(text.contains_ci(F.col("name"), "\\")), "name") == [("a\\%",), ("a\\b",)]
    assert [x["name"] for x in fuzzy.suggest_names(names, "Table", "a\\b").collect()] == ["a\\b"]
    lines = spark.createDataFrame([("one\nword\n",)], "t string")
    found = lambda p: text.around_pattern(lines, "t", p, 0).first()["context"]
    assert found("(?P<x>word)") == "" and found("[") == "" and found("(?<x>word)") == "2: word" and found("w\\Qord\\E") == "2: word"


def test_handlers_with_three_arguments(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import text

    source = "[FormControlEventHandler(formControlStr(FormA, GroupB, ControlC), FormControlEventType::Clicked)]\nvoid x()"
    got = spark.createDataFrame([(source,)], "s string").select(F.explode(text.handlers(F.col("s"))).alias("h")).select("h.*").collect()
    assert [tuple(x) for x in got] == [("FormControl", "FormA", "GroupB", "Clicked")]


def test_envelopes_say_that_there_is_more(catalogue, monkeypatch):
    from lodestrata.plans import api

    monkeypatch.setattr(api, "MOST_ROWS", 2)
    got = api.call(catalogue, "source_paths")["data"]
    assert got["count"] == len(got["items"]) == 2 and got["truncated"] is True
    assert "truncated" not in api.call(catalogue, "list_models")["data"]


def test_a_stream_follows_files_that_change(spark, tmp_path):
    from lodestrata.streaming import ingest

    root, at = str(tmp_path / "tree"), lambda x: str(tmp_path / x)
    label = "P/A/AxLabelFile/L.en.label.txt"
    run = lambda: ingest.ingest_tree(spark, root, at("out"), at("log"), at("cp"))
    got = lambda: (rows(ingest.tree_table(spark, at("out"), "labels"), "key", "value"), sorted(r["source_path"].rsplit("/", 1)[1] + ":" + (r["props"] or {}).get("Label", "") for r in ingest.tree_table(spark, at("out"), "parsed").collect()))
    table = "<AxTable><Name>T</Name><Label>{}</Label></AxTable>"
    write(root, {label: "\ufeffa=1\n;c\nb=2\n", "P/A/AxTable/T.xml": table.format("one"), "P/B/AxTable/U.xml": table.format("u")})
    assert run() == 1 and got() == ([("a", "1"), ("b", "2")], ["T.xml:one", "U.xml:u"])
    assert run() == 0 and got()[1] == ["T.xml:one", "U.xml:u"]
    write(root, {label: "a=edited\n", "P/A/AxTable/T.xml": table.format("another"), "P/A/AxTable/New.xml": table.format("new")})
    os.remove(f"{root}/P/B/AxTable/U.xml")
    assert ingest.log_changes(spark, root, at("log")) == 2  # two looks before the stream runs again
    write(root, {label: ""})
    os.utime(f"{root}/{label}", (2_000_000_000, 2_000_000_000))
    assert run() == 3 and got() == ([], ["New.xml:new", "T.xml:another"])
    store = ingest.Snapshots(spark, at("out"))
    held, last = store.manifest().number, int(store.manifest().notes["batch"])
    ingest.put_versions(spark, at("out"), spark.read.schema(ingest.LOG).parquet(at("log")), last)  # a batch given again
    assert store.manifest().number == held and got() == ([], ["New.xml:new", "T.xml:another"])


def test_depth_and_path_tell_data_sources_of_one_name_apart(spark):
    from lodestrata.sources.entities import extract
    from lodestrata.sources.tree import parse_files

    box = lambda *inner: f"<DataSources>{''.join(inner)}</DataSources>"
    one = lambda name, *inner: f"<AxQuerySimpleEmbeddedDataSource><Name>{name}</Name>{box(*inner) if inner else ''}</AxQuerySimpleEmbeddedDataSource>"
    xml = f"<AxQuery><Name>Q</Name>{box(one('A', one('B', one('C')), one('B', one('C'), one('D'))))}</AxQuery>"
    files = spark.createDataFrame([("P", "M", "AxQuery", "x/Q.xml", None, xml.encode())], "package string, model string, kind string, source_path string, modified timestamp, content binary")
    got = rows(extract(parse_files(files))["query_data_sources"], "place", "depth", "path")
    assert got == [("0", 1, "A"), ("0/0", 2, "A/B"), ("0/0/0", 3, "A/B/C"), ("0/1", 2, "A/B"), ("0/1/0", 3, "A/B/C"), ("0/1/1", 3, "A/B/D")]


def test_labels_are_inlined_at_any_depth(spark):
    schema = "id int, name string, fields array<struct<label:string,more:map<string,string>,n:int>>, own struct<a:string,b:array<string>>"
    data = [(1, "@SYS1", [("x @SYS12 y", {"@SYS1": "@SYS1"}, 1), (None, None, 2)], ("@no1", ["@SYS1", None])), (2, None, None, None)]
    labels = spark.createDataFrame([("SYS", "en-us", "SYS1", "one"), ("SYS", "cs", "SYS1", "jedna"), ("SYS", "en-us", "@SYS12", "twelve @SYS1")], "label_file string, language string, key string, value string")
    got = {r["id"]: r for r in relations.inline_nested(spark.createDataFrame(data, schema), labels, "id", languages=["en-us", "cs"]).collect()}
    assert got[1]["name"] == "one [[@SYS1]]" and got[1]["fields"][0]["label"] == "x twelve @SYS1 [[@SYS12]] y" and got[1]["fields"][0]["more"] == {"@SYS1": "one [[@SYS1]]"}
    assert got[1]["fields"][1]["label"] is None and tuple(got[1]["own"]) == ("@no1", ["one [[@SYS1]]", None]) and tuple(got[2])[1:] == (None, None, None)


def test_a_static_analysis_log_is_whole(spark, monkeypatch):
    from lodestrata.plans import api

    found = spark.createDataFrame([("B", "second", "x/T.xml"), ("A", "first", "x/U.xml"), ("B", "first", "x/T.xml")], "rule string, text string, path string")
    got = api.sarif_document(found, "rule", "text", "path")
    run = got["runs"][0]
    assert got["version"] == "2.1.0" and run["tool"]["driver"] == {"name": "lodestrata", "rules": [{"id": "A"}, {"id": "B"}]} and "properties" not in run
    assert [(r["ruleId"], r["message"]["text"]) for r in run["results"]] == [("A", "first"), ("B", "first"), ("B", "second")]
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "x/U.xml"
    monkeypatch.setattr(api, "MOST_ROWS", 1)
    assert api.sarif_document(found, "rule", "text", "path")["runs"][0]["properties"] == {"truncated": True}
    assert api.sarif_document(found.limit(0), "rule", "text", "path")["runs"][0]["results"] == []
