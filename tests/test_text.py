import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fuzzy, text
from lodestrata.operators import fulltext, graph, lint


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("first", "last", "want"), [(2, 3, "b\nc"), (0, 99, "a\nb\nc\nd\ne"), (5, 1, None)])
def test_line_slice(spark, first, last, want):
    assert one(spark, "a\nb\r\nc\nd\ne", lambda c: text.line_slice(c, first, last)) == want


def test_around(spark):
    df = spark.createDataFrame([("\n".join(f"line{i}" for i in range(1, 11)),), (None,)], "v string")
    got = [r["c"] for r in text.around_pattern(df, "v", "line5|line9", 1, "c").collect()]
    assert got == ["4: line4\n5: line5\n6: line6\n---\n8: line8\n9: line9\n10: line10", ""]
    assert text.around_pattern(df, "v", "[unclosed", 1, "c").first()["c"] == ""


def test_sanitize(spark):
    assert one(spark, "hello\nworld\t!", text.sanitize) == "hello\nworld\t!"
    assert one(spark, "safe\x01text\x07here", text.sanitize) == "safetexthere"
    assert one(spark, None, text.sanitize) is None


@pytest.mark.parametrize(("patterns", "name", "want"), [
    ([], "AnyModel", False), (["AslCore"], "aslcore", True), (["AslCore"], "AslCoreExt", False), (["Asl*"], "Asl", True), (["Asl*"], "ISVFoo", False),
    (["Mod?"], "Mod1", True), (["Mod?"], "ModAB", False), (["Mod?"], "Mod", False), (["Asl*", "!AslTest"], "AslTest", False), (["", "  ", "ISV*"], "ISV_Foo", True), (["a_b"], "axb", False),
])
def test_globs(spark, patterns, name, want):
    assert one(spark, name, lambda c: text.glob_match(c, patterns)) is want


def test_signature(spark):
    body = "[A(\n b)]\n\npublic static int f(int x)\n{"
    assert one(spark, body, text.signature_line) == "public static int f(int x)"
    assert one(spark, body, lambda c: text.return_type(text.signature_line(c))) == "int"
    assert one(spark, "public new()", text.return_type) is None
    assert one(spark, "static void main()", text.is_static) is True


def test_handlers(spark):
    h = one(spark, "[FormDataSourceEventHandler(formDataSourceStr(F, DS), FormDataSourceEventType::Initialized)]", text.handlers)
    assert [tuple(x) for x in h] == [("FormDataSource", "F", "DS", "Initialized")]
    h = one(spark, "[SubscribesTo(classStr(X), delegateStr(X, onY))]\npublic static void h()", text.handlers)
    assert [tuple(x) for x in h] == [("Delegate", "X", "onY", None)]
    two = """[Other(classStr(Wrong), FormEventType::Wrong)]
[DataEventHandler(tableStr(T), DataEventType::Inserted)]
[FormEventHandler(formStr(F), FormEventType.Closing)]
[SubscribesTo()]
public static void h() { x = [classStr(Body)]; e = FormEventType::Body; }"""
    assert [tuple(x) for x in one(spark, two, text.handlers)] == [("Table", "T", None, "Inserted"), ("Form", "F", None, "Closing")]
    assert one(spark, "public void x() {}", text.handlers) == []


def test_extended_class(spark):
    df = spark.createDataFrame([("[ExtensionOf(tableStr(CustTable))]\nfinal class A", "A", None), ("class", "Foo_Extension", None), ("class", "Bar_Extension", "Z")], "d string, n string, e string")
    assert [r[0] for r in df.select(text.extended_class(F.col("d"), F.col("n"), F.col("e"))).collect()] == ["CustTable", "Foo", None]


def test_attributes(spark):
    got = one(spark, "[Form]\n[DataEventHandler(tableStr(T), DataEventType::Inserted)]\n x[i] y[Z]", text.attributes)
    assert [(a["name"], a["args"]) for a in got] == [("Form", None), ("DataEventHandler", "tableStr(T), DataEventType::Inserted)")] or [a["name"] for a in got] == ["Form", "DataEventHandler"]


def test_log_line(spark):
    d = one(spark, "a/b.xpp(12,3): error X001: bad thing", text.log_diagnostic)
    assert (d["file"], d["line"], d["col"], d["kind"], d["code"], d["message"]) == ("a/b.xpp", 12, 3, "error", "X001", "bad thing")
    assert one(spark, "all fine", text.log_diagnostic) is None


def test_key_value_and_alias(spark):
    k, v = text.key_value(F.lit("MultiEq=a=b=c"))
    assert tuple(spark.range(1).select(k, v).first()) == ("MultiEq", "a=b=c")
    names = {"Main": ["master"], "Parameter": ["setup", "config"]}
    assert one(spark, "Set-Up", lambda c: text.alias_of(c, names)) == "Parameter"
    assert one(spark, "none", lambda c: text.alias_of(c, names)) is None


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "ABC", 0), ("abc", "abd", 1), ("", "abc", 3)])
def test_distance(spark, a, b, want):
    assert one(spark, a, lambda c: fuzzy.distance(c, b)) == want


def test_type_suggestions(spark):
    types = spark.createDataFrame([("CustAccount",), ("CustomerAccount",), ("AccountNum",), ("OrderAmount",), ("TransDate",)], "name string")
    got = lambda f, n=5: [tuple(r) for r in fuzzy.suggest_types(types, f, n).collect()]
    assert got("CustAccount")[0] == ("CustAccount", 1.0)
    assert got("CustAccountId")[0][0] == "CustAccount" and got("CustAccountId")[0][1] >= 0.8
    assert got("TotallyUnrelatedThing") == [] and got(" ") == []
    conf = [c for _, c in got("Account")]
    assert conf == sorted(conf, reverse=True)


@pytest.mark.parametrize(("kind", "name", "prefix", "codes"), [
    ("Table", "CustTable", None, {"TABLE_SUFFIX"}), ("Table", "", None, {"EMPTY_NAME"}), ("Class", "Bad Name", None, {"INVALID_CHARS"}), ("Class", "1Foo", None, {"LEADS_WITH_DIGIT", "NOT_PASCAL_CASE"}),
    ("Table", "CustTable", "Contoso_", {"TABLE_SUFFIX", "MISSING_PUBLISHER_PREFIX"}), ("Coc", "CustTableHelper", None, {"COC_SUFFIX"}), ("Coc", "CustTable_Extension", None, set()), ("Class", "A" * 81, None, {"NAME_TOO_LONG"}),
])
def test_naming(spark, kind, name, prefix, codes):
    df = spark.createDataFrame([(kind, name)], "kind string, name string")
    assert {r["code"] for r in lint.validate_names(df, prefix).collect()} == codes


LABELS = [(1, "Vehicle fleet operations", "VehicleFleet"), (2, "Fleet management console", "FleetMgmt"), (3, "Customer invoice register", "CustInv"), (4, "Véhicle is mandatory", "VehMandatory")]


@pytest.mark.parametrize(("query", "want"), [("Vehicle fleet", {1}), ('"fleet operations"', {1}), ("vehicle", {1, 4}), ("veh*", {1, 4}), ("key:CustInv", {3}), ("nothing", set()), ('fleet"', set())])
def test_full_text(spark, query, want):
    df = spark.createDataFrame(LABELS, "id long, value string, key string")
    assert {r["id"] for r in fulltext.match(df, "id", ["value", "key"], query).collect()} == want


def edges(spark, text_):
    return spark.createDataFrame([tuple(x) for x in text_.split()], "src string, dst string")


def test_cycles(spark):
    got = {tuple(r["members"]) for r in graph.cycles(edges(spark, "AB BC CA DD CE EF XE")).collect()}
    assert got == {("A", "B", "C"), ("D",)}
    assert graph.cycles(edges(spark, "AB BC")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_match_reachability(spark, seed):
    import random

    r = random.Random(seed)
    e = {(r.randrange(14), r.randrange(14)) for _ in range(22)}
    reach = set(e)
    while (new := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) != reach:
        reach = new
    want = {a: min(b for b in range(14) if (a, b) in reach and (b, a) in reach) for a in range(14) if (a, a) in reach}
    df = spark.createDataFrame(sorted(e), "src long, dst long")
    assert {x["v"]: x["comp"] for x in graph.strong_components(df).collect()} == want
    assert {x["v"]: x["comp"] for x in graph.strong_components(df, closure_nodes=0).collect()} == want


def test_coupling(spark):
    e = edges(spark, "CP CS SP")
    got = {r["v"]: (r["fan_out"], r["fan_in"], r["instability"]) for r in graph.coupling(e, graph.nodes_of(e)).collect()}
    assert got == {"P": (0, 2, 0.0), "C": (2, 0, 1.0), "S": (1, 1, 0.5)}
    assert {r["v"] for r in graph.dependencies(e, "c")[0].collect()} == {"P", "S"}


def test_names_within_a_distance_are_all_found_and_few_are_measured(spark):
    import random

    from lodestrata.functions import fuzzy

    r = random.Random(4)
    names = sorted({"".join(r.choice("abC") for _ in range(r.randint(0, 7))) for _ in range(150)} | {"CustTable", "CustTrans", "VendTable"})
    needles = ["", "a", "AB", "cusTabel", "VendTables", "x" * 9] + ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(25)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for most in (1, 2):
        got = fuzzy.within_distance(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(n,) for n in [*needles, None]], "needle string"), most)
        want = sorted((a, b, d) for a in set(needles) for b in names if (d := distance(a.lower(), b.lower())) <= most)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    long = [f"{r.randrange(10**9):09d}" for _ in range(300)]
    given = spark.createDataFrame([(n,) for n in long], "name string"), spark.createDataFrame([(n[:-1] + "x",) for n in long[:20]], "needle string"), 2, "name", "needle"
    df = fuzzy.within_distance(*given)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {x["name"] for x in df.collect()} >= set(long[:20]) and "Cartesian" not in plan and "NestedLoop" not in plan
    assert fuzzy.near_pairs(*given).count() < 0.1 * len(long) * 20


def test_postings_answer_as_the_scan_does(spark):
    from lodestrata.operators import relations

    sources = ["x = DemoTable.find();\r\n demotable y;\nDemoTableX z", "int demo; // DemoTable\nfoo", "", None, "a\na\nA\na b"]
    methods = spark.createDataFrame([(f"C{i % 2}", f"m{i}", s) for i, s in enumerate(sources)], "class string, name string, source string")
    postings = relations.identifier_postings(methods)
    names = ["DEMOTABLE", "demo", "a", "B", "zz", "find"]
    got = relations.references_of(postings, spark.createDataFrame([(n,) for n in names], "asked string"), "asked").collect()
    want = [(n, r["class"], r["name"], r["sample_lines"]) for n in names for r in relations.source_references(methods, n).collect()]
    assert sorted((r["searched"], r["class"], r["name"], r["sample_lines"]) for r in got) == sorted(want) and len(want) > 5
