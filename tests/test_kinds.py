"""Only files of the kinds that tables come from are parsed."""

from lodestrata.sources import tree
from lodestrata.sources.entities import FROM_KINDS, FROM_LISTS, extract, extract_only


def test_only_kinds_asked_for_are_parsed(spark):
    box = lambda name, x="X": f"<{name}><{x}><Name>a</Name><RelatedTable>r</RelatedTable><ObjectName>o</ObjectName></{x}></{name}>"
    kinds = ["AxTable", "AxClass", "AxEdt", "AxEnum", "AxMenuItemDisplay", "AxForm", "AxFormExtension", "AxSecurityRole", "AxSecurityDuty", "AxSecurityPrivilege", "AxQuery", "AxView", "AxDataEntityView", "AxReport", "AxSsrsReport", "AxService", "AxServiceGroup", "AxWorkflowTask"]
    tags = {"AxTable": ("AxTableField", "AxTableIndex", "AxTableRelation", "AxTableDeleteAction"), "AxEnum": ("AxEnumValue",) * 4, "AxForm": ("AxFormDataSource",) * 4}
    rows = []
    for k in kinds:
        a, b, c, d = tags.get(k, ("X",) * 4)
        lists = box("Fields", a) + box("Indexes", b) + box("Relations", c) + box("DeleteActions", d) + "".join(box(x, "AxQueryX" if k == "AxQuery" else a) for x in tree.LISTS if x not in ("Fields", "Indexes", "Relations", "DeleteActions"))
        method = "<SourceCode><Declaration>[ExtensionOf(tableStr(T))] class C</Declaration><Methods><Method><Name>m</Name><Source>[SubscribesTo(classStr(C), delegateStr(C, on))] void m()</Source></Method></Methods></SourceCode>"
        rows.append(("P", "M", k, f"x/{k}/N.xml", None, f"<{k}><Name>N</Name>{lists}{method}</{k}>".encode()))
    files = spark.createDataFrame(rows, "package string, model string, kind string, source_path string, modified timestamp, content binary")
    names = sorted(x for of in FROM_KINDS.values() for x in of)
    every = extract(tree.parse_files(files).cache())
    assert names == sorted(every) and set(FROM_LISTS) <= set(names)
    want = {n: sorted(map(str, every[n].collect())) for n in names}
    for name in names:
        got = extract_only(files, [name])[name]
        assert sorted(map(str, got.collect())) == want[name] and want[name]
    parsed = []
    extract_only(files, ["security_privileges"], kept=lambda p: parsed.append(p) or p)
    assert [r["kind"] for r in parsed[-1].collect()] == ["AxSecurityPrivilege"]
