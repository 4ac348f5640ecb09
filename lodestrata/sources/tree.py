"""The source tree: <root>/<Package>/<Model>/<Kind>/*.xml, one object a file, read as one DataFrame.

Each file becomes a row: where it lies, its root's name and own values, and all objects nested in it as a flat array
(list it stands in, position, the object around it, its values), methods and the declaration. Child tables are
selections from that row, so all kinds are parsed in one pass over the files. A file of more than PIECE objects or
methods has further rows (`part` 1 and on), which bear its name, the next objects and the next methods: no row and no
batch grows with a file, and a file of more than LARGE bytes whose methods aren't asked for is parsed in parts, so that its
tree is never held whole. A file that can't be parsed (malformed,
in an unknown encoding, nested beyond any depth) gives a row with its error and does not stop the job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import glob_match

#: Element names that hold lists of objects.
LISTS = ("Fields", "Relations", "Indexes", "DeleteActions", "EnumValues", "DataSources", "Duties", "Privileges", "EntryPoints", "DataSets", "Operations", "Services")
EVERY = frozenset(LISTS)
PARSED = (
    "package string, model string, kind string, source_path string, modified timestamp, root string, props map<string,string>, design map<string,string>, declaration string, "
    "children array<struct<list:string,position:int,parent:string,tag:string,props:map<string,string>,depth:int,path:string,place:string>>, methods array<struct<name:string,source:string,nested:boolean>>, error string, part int"
)
TEXTS = pa.map_(pa.string(), pa.string())
CHILD = {"list": pa.string(), "position": pa.int32(), "parent": pa.string(), "tag": pa.string(), "props": TEXTS, "depth": pa.int32(), "path": pa.string(), "place": pa.string()}
METHOD = {"name": pa.string(), "source": pa.string(), "nested": pa.bool_()}
HEAD = ["package", "model", "kind", "source_path", "modified"]
#: Elements of a file up to which no walk over its objects can be too deep.
SHALLOW = 200
#: Objects of a row, rows and objects of a batch that the parser gives, and bytes of a batch that it takes (one file at least).
PIECE, ROWS, OBJECTS, TAKEN = 2_000, 1_000, 10_000, 4 << 20
#: Bytes of a file from which on its tree is not held whole, and of a part of it that is parsed at once.
LARGE, FED = 1 << 20, 1 << 16


def local(e: ET.Element) -> str:
    return e.tag if e.tag[:1] != "{" else e.tag.rpartition("}")[2]


def values(e: ET.Element) -> dict[str, str]:
    """The texts of an element's own leaves; the first of a name counts, blank ones don't."""
    out: dict[str, str] = {}
    for x in e:
        if not len(x) and (text := x.text) and (text := text.strip()):
            name = x.tag
            out.setdefault(name if name[:1] != "{" else local(x), text)
    return out


def nested(e: ET.Element, parent: str | None, above: tuple[str, ...] = (), places: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Objects in the lists below an element, each with the object around it, to any depth, with the fields of CHILD.

    path names the objects from the outermost one on, place gives their positions, which tell apart those of one name.
    """
    for box in e:
        if not len(box):
            continue
        name = local(box)
        if name in EVERY:
            for i, x in enumerate(box):
                row, *inside = described(name, i, x, parent, above, places)
                yield row
                if any(map(len, x)):
                    yield from nested(x, *inside)
        elif parent is None and name != "Methods":
            yield from nested(box, None)


def described(name: str, i: int, x: ET.Element, parent: str | None, above: tuple[str, ...], places: tuple[str, ...]) -> tuple[tuple, str | None, tuple[str, ...], tuple[str, ...]]:
    """An object at a place of a list, and what those nested in it need: its name, path and place."""
    props = values(x)
    if not len(x) and (text := (x.text or "").strip()):
        props["Name"] = text
    own = props.get("Name")
    path, place = (*above, own or local(x)), (*places, str(i))
    return (name, i, parent, local(x), list(props.items()), len(path), "/".join(path), "/".join(place)), own, path, place


def item(name: str, i: int, x: ET.Element) -> Iterator[tuple]:
    """An object in a list that is in no object, and those nested in it."""
    row, *inside = described(name, i, x, None, (), ())
    yield row
    yield from nested(x, *inside)


def events_of(content: memoryview) -> Iterator[tuple[str, ET.Element]]:
    """Starts and ends of a file's elements, as its parts are parsed."""
    parser = ET.XMLPullParser(("start", "end"))
    for at in range(0, len(content), FED):
        parser.feed(bytes(content[at : at + FED]))
        yield from parser.read_events()
    parser.close()
    yield from parser.read_events()


def top_objects(content: memoryview) -> Iterator[tuple[str, int, ET.Element] | ET.Element | None]:
    """(list, position, element) of each object in a list that is in no object, as it ends, and at last the root; None where elements are nested deeper than SHALLOW.

    Objects leave the tree after their turn; an empty one stays in each list, so what is left has the file's own values.
    """
    above: list[tuple[ET.Element, str]] = []  # the elements around, each with its list where objects stand in it, "" where lists may, else None
    seen: list[int] = []
    for event, e in events_of(content):
        if event == "start":
            if len(above) > SHALLOW:
                yield None
                return
            inside = above[-1][1] if above else ""
            name = local(e)
            above.append((e, (name if name in EVERY else None if name == "Methods" and len(above) else "") if inside == "" else None))
            seen.append(0)
            continue
        above.pop()
        seen.pop()
        if above and above[-1][1]:
            box, name = above[-1]
            yield name, seen[-1], e
            if seen[-1]:
                box.remove(e)
            elif not any(local(x) == "SourceCode" for x in e.iter()):
                e.clear()
            seen[-1] += 1
        elif not above:
            yield e


def parse_large(content: memoryview, lists: frozenset[str]) -> Iterator[tuple] | None:
    """What `parse` gives without methods, in two walks over the file's parts; None where the tree must be held whole."""
    n, root = 0, None
    for x in top_objects(content):  # what can't be parsed is an error of the whole file, before any of its pieces
        if x is None:
            return None
        if isinstance(x, tuple):
            n += 1
            if x[1] and any(local(y) == "SourceCode" for y in x[2].iter()):
                return None
        else:
            root = x
    if local(root) in EVERY or root.tag.endswith("SourceCode"):
        return None
    objects = (y for x in top_objects(content) if isinstance(x, tuple) for y in item(*x) if y[0] in lists) if n else iter(())
    return pieces(root, objects)


def pieces(root: ET.Element, children: Iterator[tuple]) -> Iterator[tuple]:
    source = next((x for x in root.iter() if local(x) == "SourceCode"), None)
    text = next((x.text or "" for x in source if local(x) == "Declaration"), "") if source is not None else ""
    design = next((values(x) for x in root if local(x) == "Design"), None)
    name, props = local(root), values(root)
    yield name, list(props.items()), None if design is None else list(design.items()), text, list(islice(children, PIECE)), []
    own = [(k, v) for k, v in props.items() if k == "Name"]
    while some := list(islice(children, PIECE)):
        yield name, own, None, None, some, []


def methods_of(root: ET.Element, source: ET.Element | None) -> Iterator[tuple]:
    """All methods with a name, with the fields of METHOD."""
    top = next((x for x in root if local(x) == "Methods"), None)
    if top is None and source is not None:
        top = next((x for x in source if local(x) == "Methods"), None)
    own = set(map(id, top)) if top is not None else set()
    for m in root.iter():
        if local(m) == "Method" and (name := values(m).get("Name")):
            yield name, next((y.text or "" for y in m if local(y) == "Source"), ""), id(m) not in own


def parse(content: bytes, lists: frozenset[str] = EVERY, with_methods: bool = True) -> Iterator[tuple]:
    """(root, values, design, declaration, objects, methods) of each piece of a file; only the first has design and declaration.

    Objects of other lists than these are left out, and so are methods that aren't asked for.
    """
    root = ET.fromstring(content)
    tags = [x.tag for x in root.iter()]
    size, many, kinds = len(tags), len(tags) > PIECE, {t.rpartition("}")[2] for t in set(tags)}
    del tags
    source = next((x for x in root.iter() if local(x) == "SourceCode"), None) if "SourceCode" in kinds else None
    text = next((x.text or "" for x in source if local(x) == "Declaration"), "") if source is not None else ""
    design = next((values(x) for x in root if local(x) == "Design"), None)
    name, props = local(root), values(root)
    methods = methods_of(root, source) if with_methods and "Method" in kinds else iter(())
    unasked = lists.isdisjoint(kinds)
    children = iter(()) if unasked else nested(root, None) if lists.issuperset(kinds & EVERY) else (x for x in nested(root, None) if x[0] in lists)
    if many or (unasked and size > SHALLOW):  # what can't be walked is an error of the whole file, before any of its pieces, whatever is asked for
        for _ in nested(root, None):
            pass
    if not many:
        yield name, list(props.items()), None if design is None else list(design.items()), text, list(children), list(methods)
        return
    own, first = [(k, v) for k, v in props.items() if k == "Name"], True
    while True:
        some, more = list(islice(children, PIECE)), list(islice(methods, PIECE))
        if first:
            yield name, list(props.items()), None if design is None else list(design.items()), text, some, more
        elif some or more:
            yield name, own, None, None, some, more
        else:
            return
        first = False


def parsed_or_error(content: memoryview, lists: frozenset[str], with_methods: bool) -> Iterator[tuple]:
    """The pieces of a file with an error that is null, or one without anything but its error."""
    try:
        large = None
        if len(content) >= LARGE and not with_methods:
            large = parse_large(content, lists)
        for piece in large or parse(bytes(content), lists, with_methods):
            yield *piece, None
    except (ET.ParseError, LookupError, ValueError, RecursionError) as e:
        yield None, None, None, None, [], [], f"{type(e).__name__}: {e}"


def arrays(lists: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of tuples as an array of lists of structs."""
    flat = [x for one in lists for x in one]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), inner)


def read_files(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """Files below a root with package, model and kind from their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    at = lambda n: F.element_at(parts, -n)
    return files.select(at(4).alias("package"), at(3).alias("model"), at(2).alias("kind"), F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"), "length", "content")


def parse_tree(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """All object files below a root, parsed."""
    return parse_files(read_files(spark, root), models)


def parsed_rows(b: pa.RecordBatch, at: list[int], part: list[int], pieces: list[tuple]) -> pa.RecordBatch:
    own = b.select(HEAD).take(pa.array(at, pa.int32()))
    root, props, design, text, children, methods, error = zip(*pieces, strict=True)
    got = [pa.array(root, pa.string()), pa.array(props, TEXTS), pa.array(design, TEXTS), pa.array(text, pa.string()), arrays(children, CHILD), arrays(methods, METHOD), pa.array(error, pa.string()), pa.array(part, pa.int32())]
    return pa.RecordBatch.from_arrays([*own.columns, *got], names=[*HEAD, "root", "props", "design", "declaration", "children", "methods", "error", "part"])


def parsed_batches(batches: Iterator[pa.RecordBatch], lists: frozenset[str] = EVERY, with_methods: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, part, pieces, n = [], [], [], 0
        contents = b.column(len(HEAD))
        for i in range(len(b)):
            for k, piece in enumerate(parsed_or_error(memoryview(contents[i].as_buffer()), lists, with_methods)):
                at.append(i)
                part.append(k)
                pieces.append(piece)
                n += len(piece[4]) + len(piece[5])
                if len(at) >= ROWS or n >= OBJECTS:
                    yield parsed_rows(b, at, part, pieces)
                    at, part, pieces, n = [], [], [], 0
        if at:
            yield parsed_rows(b, at, part, pieces)


def parse_files(files: DataFrame, models: list[str] | None = None, lists: Iterable[str] = LISTS, methods: bool = True) -> DataFrame:
    """Files with package, model, kind, source_path, modified and content, parsed; adaptor packages and models and non-object folders are left out.

    All rows come with all their columns; objects come from these lists only, and methods if they are asked for.
    """
    wanted = frozenset(lists)
    adaptor = F.lower("package").endswith("formadaptor") | F.lower("model").endswith("formadaptor")
    files = files.filter(F.col("kind").startswith("Ax") & ~adaptor)
    if models:
        files = files.filter(glob_match(F.col("model"), models))

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TAKEN))  # read when the plan runs
    return files.select(*HEAD, "content").mapInArrow(lambda batches: parsed_batches(batches, wanted, methods), PARSED)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """kind (Declaration or Method), name, body of one file's source, as it stands now; nothing where it can't be read."""
    files = spark.read.format("binaryFile").load(path).select(F.lit("").alias("package"), F.lit("").alias("model"), F.lit("Ax").alias("kind"), F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"), "content")
    return source_blocks(parse_files(files))


def source_blocks(parsed: DataFrame) -> DataFrame:
    """source_path, kind, name and body: the declaration and all methods, nested ones too."""
    top = parsed.filter(F.trim("declaration") != "").select("source_path", F.lit("Declaration").alias("kind"), F.lit(None).cast("string").alias("name"), F.trim("declaration").alias("body"))
    methods = parsed.select("source_path", F.explode("methods").alias("m")).select("source_path", F.lit("Method").alias("kind"), "m.name", F.col("m.source").alias("body"))
    return top.unionByName(methods)


def descriptors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(models, dependencies) from <Package>/Descriptor/*.xml."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root).filter(F.element_at(F.split("path", "/"), -2) == "Descriptor")
    return parse_descriptors(files)


def parse_descriptors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models, dependencies) of descriptor files with path and content; files that can't be parsed are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    e = ET.fromstring(bytes(content))
                except (ET.ParseError, LookupError, ValueError):
                    continue
                v = values(e)
                refs = [y.text.strip() for x in e.iter() if local(x) in ("ModuleReferences", "ModelReferences") for y in x if (y.text or "").strip()]
                rows.append((v.get("Name") or path.rsplit("/", 1)[-1].removesuffix(".xml"), v.get("Publisher"), v.get("Layer"), refs))
            yield pd.DataFrame(rows, columns=["name", "publisher", "layer", "targets"])

    found = files.select("path", "content").mapInPandas(run, "name string, publisher string, layer string, targets array<string>")
    deps = found.select(F.col("name").alias("model"), F.explode("targets").alias("target")).groupBy("model", F.lower("target").alias("_t")).agg(F.min("target").alias("target")).drop("_t")
    return found.drop("targets"), deps
