"""What must hold so that queries grow no faster than their tables."""

from pyspark.sql import functions as F

from lodestrata.functions import fuzzy
from lodestrata.operators import search
from lodestrata.sources import tree
from lodestrata.sources.entities import extract


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_names_are_never_sent_whole(spark):
    names = spark.range(3000).select(F.concat(F.lit("Name"), "id").alias("name"))
    needles = spark.range(300).select(F.concat(F.lit("e"), "id").alias("needle"))
    want = {f"e{i}": sum(f"e{i}" in f"name{k}" for k in range(3000)) for i in range(300)}
    for sent in (100_000, 10):
        found = search.batch_search(names.unionAll(names), needles, few=0, sent=sent)
        assert {r["needle"]: r["hits"] for r in found.collect()} == {k: 2 * n for k, n in want.items()}
        joins = [x for x in plan_of(found).split("Generate explode")[0].splitlines() if "Join" in x and "_start" in x]
        assert joins and all(("BuildRight" in x or "BuildLeft" not in x) for x in joins)
        assert ("SortMergeJoin" in joins[0]) == (sent == 10)


def test_texts_with_deletions_are_merged(spark):
    names = spark.range(200).select(F.concat(F.lit("Name"), "id").alias("name"))
    needles = spark.range(20).select(F.concat(F.lit("Nam"), "id").alias("needle"))
    plan = plan_of(fuzzy.near_pairs(names, needles, 2, "name", "needle"))
    assert "SortMergeJoin [rest" in plan and "Broadcast" not in plan


def test_rows_of_parsed_files_are_bounded(spark):
    field = lambda i: f"<AxTableField><Name>F{i}</Name><Label>L{i}</Label></AxTableField>"
    index = lambda i: f"<AxTableIndex><Name>I{i}</Name><Fields><AxTableIndexField><DataField>F{i}</DataField></AxTableIndexField><AxTableIndexField><DataField>G</DataField></AxTableIndexField></Fields></AxTableIndex>"
    body = f"<Fields>{''.join(map(field, range(5000)))}</Fields><Indexes>{''.join(map(index, range(2500)))}</Indexes><SourceCode><Methods>{''.join(f'<Method><Name>m{i}</Name><Source>void m{i}()</Source></Method>' for i in range(4500))}</Methods></SourceCode>"
    deep = "<a>" * 30_000 + "</a>" * 30_000
    xml = {"T": f"<AxTable>{body}<Name>T</Name><Label>own</Label></AxTable>", "Bad": f"<AxTable>{body}<Name>Bad</Name>", "Deep": f"<AxTable>{body}{deep}</AxTable>", "U": "<AxTable><Name>U</Name></AxTable>"}
    files = spark.createDataFrame([("P", "M", "AxTable", f"x/{k}.xml", None, v.encode()) for k, v in xml.items()], "package string, model string, kind string, source_path string, modified timestamp, content binary")
    parsed = tree.parse_files(files).cache()
    assert parsed.filter((F.size("children") > tree.PIECE) | (F.size("methods") > tree.PIECE)).isEmpty()
    assert sorted(r["source_path"] for r in parsed.filter("error IS NOT NULL").collect()) == ["x/Bad.xml", "x/Deep.xml"]
    assert parsed.filter("source_path IN ('x/Bad.xml', 'x/Deep.xml', 'x/U.xml')").count() == 3
    t = extract(parsed)
    assert sorted((r["name"], r["label"]) for r in t["tables"].collect()) == [("T", "own"), ("U", None)]
    assert sorted((r["table"], r["name"], r["label"]) for r in t["table_fields"].collect()) == sorted(("T", f"F{i}", f"L{i}") for i in range(5000))
    assert sorted((r["name"], tuple(r["fields"])) for r in t["table_indexes"].collect()) == sorted((f"I{i}", (f"F{i}", "G")) for i in range(2500))
    assert sorted(r["name"] for r in t["table_methods"].collect()) == sorted(f"m{i}" for i in range(4500))


def test_parsed_files_are_dealt_out_and_hold_what_is_asked_for(spark):
    from lodestrata.plans.tree_queries import extracted

    body = "<Fields><AxTableField><Name>F</Name></AxTableField></Fields><Indexes><AxTableIndex><Name>I</Name><Fields><AxTableIndexField><DataField>F</DataField></AxTableIndexField></Fields></AxTableIndex></Indexes><Methods><Method><Name>m</Name><Source>void m()</Source></Method></Methods>"
    deep = "<Fields><A>" * 20_000 + "</A></Fields>" * 20_000
    xml = {f"T{i}": f"<AxTable><Name>T{i}</Name>{body}</AxTable>" for i in range(50)} | {"Deep": f"<AxTable><Name>Deep</Name>{deep}</AxTable>"}
    files = spark.createDataFrame([("P", "M", "AxTable", f"x/{k}.xml", None, v.encode()) for k, v in xml.items()], "package string, model string, kind string, source_path string, modified timestamp, content binary").coalesce(1)
    whole, names = extract(tree.parse_files(files)), ["tables", "table_fields", "table_indexes", "table_methods"]
    for name in names:
        part = extracted(files, name)[name]
        assert sorted(map(str, part.collect())) == sorted(map(str, whole[name].collect())) and part.count() == 50
        assert "hashpartitioning(source_path" in plan_of(part)
    assert [len(p[4]) for p in tree.parse(xml["T0"].encode(), frozenset(["Indexes"]), False)] == [1]
    assert [(len(p[4]), len(p[5])) for p in tree.parse(xml["T0"].encode(), frozenset(), False)] == [(0, 0)]


def test_indexes_and_their_fields_meet_in_one_grouping(spark):
    part = lambda *f: "".join(f"<AxTableIndexField><DataField>{x}</DataField></AxTableIndexField>" for x in f)
    index = lambda name, inner: f"<AxTableIndex><Name>{name}</Name><Fields>{inner}</Fields><AlternateKey>Yes</AlternateKey></AxTableIndex>"
    xml = f"<AxTable><Name>T</Name><Indexes>{index('A', part('x', 'y'))}{index('A', part('z'))}{index('E', '')}{index('', part('lost'))}</Indexes></AxTable>"
    files = spark.createDataFrame([("P", "M", "AxTable", "x/T.xml", None, xml.encode())], "package string, model string, kind string, source_path string, modified timestamp, content binary")
    found = extract(tree.parse_files(files))["table_indexes"]
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r["name"], r["allow_duplicates"], r["alternate_key"], sorted(r["fields"])) for r in found.collect()) == [("A", True, True, ["x", "y", "z"])] * 2 + [("E", True, True, [])]
