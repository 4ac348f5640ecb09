"""What a task holds of table files depends neither on how many they are nor on how many fields and indexes they have."""

import tracemalloc

import pyarrow as pa
import pytest

from lodestrata.sources import tree

FILES = "package string, model string, kind string, source_path string, modified timestamp, content binary"
ASKED = frozenset(["Indexes", "Fields"])


def table(orders: int) -> bytes:
    field = lambda i: f"<AxTableField><Name>O{i}</Name><Label>F</Label></AxTableField>"
    part = lambda i: f"<AxTableIndexField><DataField>P{i}</DataField></AxTableIndexField>"
    index = lambda i: f"<AxTableIndex><Name>I{i}</Name><Fields>{''.join(map(part, range(4)))}</Fields></AxTableIndex>"
    return f"<AxTable><Name>T</Name><Fields>{''.join(map(field, range(orders)))}</Fields><Indexes>{''.join(map(index, range(0, orders, 7)))}</Indexes></AxTable>".encode()


def held(orders: int, files: int) -> tuple[int, int]:
    """(peak of the parser in bytes, objects given) for a batch of so many files."""
    own = [["x"] * files] * 4 + [[None] * files, [table(orders)] * files]
    types = [pa.string()] * 4 + [pa.timestamp("us"), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, types, strict=True)], names=[*tree.HEAD, "content"])
    tracemalloc.start()
    n = sum(len(b.column("children").flatten()) for b in tree.parsed_batches(iter([batch]), ASKED, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, n


@pytest.mark.parametrize(("less", "more"), [((10, 800), (10, 3200)), ((2000, 4), (2000, 16)), ((20_000, 1), (60_000, 1))])
def test_memory_does_not_grow_with_files_or_their_objects(less, more):
    (small, a), (large, b) = held(*less), held(*more)
    assert a > tree.OBJECTS and b > 2.9 * a
    assert large < 1.3 * small


def test_batches_of_files_are_bounded_by_bytes(spark):
    rows = [("P", "M", "AxTable", f"x/T{i}.xml", None, table(100)) for i in range(1500)]
    files = spark.createDataFrame(rows, FILES).coalesce(1)
    total, one = sum(len(r[-1]) for r in rows), len(rows[0][-1])
    tree.parse_files(files)  # sets what a batch may hold
    sizes = files.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.column("content").nbytes])], names=["n"]) for b in batches), "n long")
    got = [r["n"] for r in sizes.collect()]
    assert total > 3 * tree.TAKEN and sum(got) >= total
    assert max(got) < 1.5 * tree.TAKEN + one
