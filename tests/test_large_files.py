"""Large files are parsed in parts, with the objects of a tree held whole."""

import tracemalloc

import pytest

from lodestrata.sources import tree

LISTS = frozenset(tree.LISTS)


def whole(xml: bytes, lists=LISTS):
    return list(tree.parse(xml, lists, False))


def joined(pieces):
    """All of a file's pieces as one."""
    first = pieces[0]
    return first[:4], [x for p in pieces for x in p[4]]


XML = {
    "objects": "<A><Name>N</Name><Fields><F><Name>f</Name><X>1</X><Fields><G><Name>g</Name></G></Fields></F><F>text</F><F/></Fields><Box><Indexes><I><Name>i</Name></I></Indexes><B><Fields><F><Q>q</Q></F></Fields></B></Box><Label>after</Label></A>",
    "design": "<A><Design><Pattern>p</Pattern><DataSources><D><Name>d</Name></D><D><Name>e</Name></D></DataSources><Style>s</Style></Design><Fields>text<F><Name>f</Name></F></Fields><Fields>t2</Fields></A>",
    "source": "<A><SourceCode><Declaration>class A</Declaration><Methods><M><Fields><F><Name>no</Name></F></Fields></M></Methods></SourceCode><Fields><F><Name>f</Name></F></Fields></A>",
    "source inside": "<A><Fields><F><SourceCode><Declaration>own</Declaration></SourceCode></F><F><SourceCode><Declaration>two</Declaration></SourceCode></F></Fields></A>",
    "spaces": "<x:A xmlns:x='u'><x:Fields><x:F><x:Name>f</x:Name></x:F></x:Fields><x:Name>N</x:Name></x:A>",
    "list as root": "<Fields><F><Name>f</Name><Fields><G><Name>g</Name></G></Fields></F></Fields>",
    "nothing": "<A/>",
}


@pytest.mark.parametrize("name", sorted(XML))
@pytest.mark.parametrize("lists", [LISTS, frozenset(["Fields"]), frozenset()])
def test_parts_give_what_the_whole_tree_gives(name, lists, monkeypatch):
    monkeypatch.setattr(tree, "LARGE", 0)
    monkeypatch.setattr(tree, "FED", 7)
    monkeypatch.setattr(tree, "PIECE", 2)
    xml = XML[name].encode()
    got = list(tree.parsed_or_error(memoryview(xml), lists, False))
    assert all(p[-1] is None and len(p[4]) <= 2 for p in got)
    monkeypatch.setattr(tree, "PIECE", 1000)
    assert joined(got) == joined(whole(xml, lists))


def test_errors_are_those_of_the_whole_file(monkeypatch):
    bad = [b"<A><Fields><F/></Fields>", b"<A><Fields><F/></Fields></B>", b"<A>&no;</A>", b"<?xml version='1.0' encoding='none'?><A/>", b"<A>" + b"<Fields><A>" * 20_000 + b"</A></Fields>" * 20_000 + b"</A>"]
    want = [list(tree.parsed_or_error(memoryview(x), LISTS, False)) for x in bad]
    monkeypatch.setattr(tree, "LARGE", 0)
    assert [list(tree.parsed_or_error(memoryview(x), LISTS, False)) for x in bad] == want and all(len(x) == 1 and x[0][-1] for x in want)


def test_memory_does_not_grow_with_a_file():
    peaks = []
    for n in (20_000, 80_000):
        xml = memoryview(("<AxReport><Name>R</Name><DataSets>" + "".join(f"<AxReportDataSet><Name>V{i}</Name><Query>abcdefghij{i}</Query></AxReportDataSet>" for i in range(n)) + "</DataSets></AxReport>").encode())
        assert len(xml) >= tree.LARGE
        tracemalloc.start()
        assert sum(len(p[4]) for p in tree.parsed_or_error(xml, frozenset(["DataSets"]), False)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] < 8e6
