"""Text functions as Column expressions: matching, tokens, slices and the patterns of source code."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_ci(col: Column, needle: str, strict: bool = False) -> Column:
    """`%needle%` without regard to case. `%` and `_` of the needle are wildcards, a backslash is itself; strict folds ASCII letters only."""
    pattern = like_part(needle)
    return F.translate(col, UPPER, LOWER).like(pattern.translate(str.maketrans(UPPER, LOWER))) if strict else col.ilike(pattern)


def like_part(needle: str) -> str:
    """A LIKE pattern for texts that contain the needle, whose wildcards count and whose backslashes don't escape."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def prefix(col: Column, start: str) -> Column:
    """A prefix test that reaches the Parquet scan."""
    return col.startswith(start)


def eq_ci(col: Column, value: Column | str) -> Column:
    return F.lower(col) == F.lower(value if isinstance(value, Column) else F.lit(value))


def to_bool(col: Column) -> Column:
    """1, true and yes in any case are true; other values false; null stays null."""
    return F.lower(F.trim(col.cast("string"))).isin("1", "true", "yes")


def sanitize(col: Column) -> Column:
    """Drop control characters, keep tab, line feed and carriage return."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def glob_like(pattern: str) -> str:
    """A glob as a LIKE pattern; LIKE's own wildcards are escaped."""
    return re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_")


def glob_match(col: Column, patterns: list[str]) -> Column:
    """Ordered globs without regard to case, `!` negates, the last match decides, no match is false."""
    out: Column = F.lit(False)
    for p in patterns:
        p = (p or "").strip()
        body = p[1:].strip() if p.startswith("!") else p
        if body:
            out = F.when(col.ilike(glob_like(body)), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def lines(col: Column) -> Column:
    return F.split(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def line_slice(col: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1, both included and clamped; null where nothing can be left."""
    at, end = max(first, 1), last
    if at > end:
        return F.lit(None).cast("string")
    parts = lines(col)
    return F.when(F.size(parts) >= at, F.array_join(F.slice(parts, at, end - at + 1), "\n"))


def tail(col: Column, n: int) -> Column:
    parts = lines(col)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n, F.lit(0)) + 1, F.lit(n)), "\n")


def is_regex(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will match it takes the pattern; that engine is Java's, not Python's."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except IllegalArgumentException:
        return False
    return True


def around_pattern(df: DataFrame, col: str, pattern: str, context: int = 3, into: str = "context") -> DataFrame:
    """Numbered lines within `context` of a matching line, in one text; `---` stands where lines are left out.

    A pattern that is not a regular expression matches nothing; so does a null text.
    """
    if not is_regex(df.sparkSession, pattern):
        return df.withColumn(into, F.lit(""))
    number = lambda t, i: F.when(t.rlike(f"(?i){pattern}"), i + 1)
    df = df.withColumn("_lines", F.coalesce(lines(F.col(col)), F.array().cast("array<string>")))
    df = df.withColumn("_hits", F.array_compact(F.transform("_lines", number)))
    around = F.flatten(F.transform("_hits", lambda h: F.sequence(F.greatest(h - context, F.lit(1)), F.least(h + context, F.size("_lines")))))
    df = df.withColumn("_near", F.array_sort(F.array_distinct(around)))
    before = F.concat(F.array(F.lit(None).cast("int")), F.col("_near"))
    shown = F.transform(F.arrays_zip(F.col("_near").alias("n"), before.alias("p")), lambda x: F.concat(
        F.when(x["p"] < x["n"] - 1, "---\n").otherwise(""), x["n"].cast("string"), F.lit(": "), F.get("_lines", x["n"] - 1)))
    return df.withColumn(into, F.array_join(shown, "\n")).drop("_lines", "_hits", "_near")


def key_value(col: Column) -> tuple[Column, Column]:
    """Key and value about the first `=`; null where there is none."""
    at = F.instr(col, "=")
    return F.when(at > 0, F.substring(col, F.lit(1), at - 1)), F.when(at > 0, F.substring(col, at + 1, F.length(col)))


def token_parts(col: Column) -> tuple[Column, Column]:
    """Letters and the rest of a token, without a leading `@`."""
    return F.regexp_extract(col, r"^@?([A-Za-z]*)", 1), F.regexp_extract(col, r"^@?[A-Za-z]*(.*)$", 1)


def fold_accents(col: Column) -> Column:
    """Letters of the Latin supplement and extension A without their accents."""
    pairs = {chr(c): d[0] for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and not unicodedata.combining(d[0])}
    return F.translate(col, "".join(pairs), "".join(pairs.values()))


def words(col: Column) -> Column:
    """Lower-case words without accents: runs of letters and digits."""
    return F.filter(F.split(F.lower(fold_accents(col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def rounded(col: Column, places: int) -> Column:
    """Half goes to the even neighbour."""
    return F.bround(col, places)


# ---------------------------------------------------------------- source code

# Patterns of attributes, of the extended class, of `...Str(object, member)` calls, of event types, of
# compiler messages.
ATTRIBUTE = r"\[\s*([A-Z][A-Za-z0-9_]+)\s*(?:\(\s*([^\]]*)\))?\s*\]"
EXTENSION_OF = r"\[\s*ExtensionOf\s*\(\s*\w+Str\s*\(\s*(\w+)"
STR_CALL = r"\b\w+Str\s*\(\s*(\w+)\s*(?:,\s*(\w+))?"
EVENT_TYPE = r"\w+EventType(?:\.|::)(\w+)"
DIAGNOSTIC = r"^\s*(.+?)\((\d+),(\d+)\)\s*:\s*(?i:(error|warning|info))\s+(\w+)\s*:\s*(.*)$"
# Words that may precede a return type.
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "client", "server")
# Attribute names of handlers and what they handle.
HANDLERS = {
    "FormEventHandler": "Form",
    "FormDataSourceEventHandler": "FormDataSource",
    "FormControlEventHandler": "FormControl",
    "DataEventHandler": "Table",
    "SubscribesTo": "Delegate",
}


def signature_line(body: Column) -> Column:
    """The first line that is neither blank nor part of a bracketed attribute in front of a declaration."""
    bare = F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"^(?:\s*(?:\[(?:[^\[\]]|\[[^\]]*\])*\]|//[^\n]*))*\s*", "")
    return F.nullif(F.trim(F.element_at(F.split(bare, "\n"), 1)), F.lit(""))


def return_type(signature: Column) -> Column:
    """The first word that is no modifier; null where it is already the name."""
    word = F.get(F.filter(F.split(F.trim(signature), " +"), lambda w: ~w.isin(*MODIFIERS)), 0)
    return F.when(~word.contains("("), word)


def is_static(signature: Column) -> Column:
    return signature.rlike(r"(?i)\bstatic\b")


def attributes(source: Column) -> Column:
    """Attributes [Name(args)] of Pascal-case names, as array of struct(name, args)."""
    names, args = (F.regexp_extract_all(source, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), args.alias("args")), lambda x: F.struct(x["name"].alias("name"), F.nullif(x["args"], F.lit("")).alias("args")))


def extended_class(declaration: Column, name: Column, extends: Column) -> Column:
    """The class that a declaration extends by attribute, or by its name's ending where it has no base class."""
    by_attribute = F.regexp_extract(declaration, EXTENSION_OF, 1)
    by_name = F.when(name.endswith("_Extension") & (F.coalesce(extends, F.lit("")) == ""), F.regexp_replace(name, "_Extension$", ""))
    return F.coalesce(F.nullif(by_attribute, F.lit("")), by_name)


def handlers(source: Column) -> Column:
    """array of struct(source_kind, source_object, source_member, event_type): one for each handler attribute.

    Names come from the `...Str(object, member)` calls among the attribute's own arguments, so neither other attributes
    nor the body count; a subscription takes the delegate of the second call. Attributes without a call give none.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv])

    def shown(a: Column) -> Column:
        args = F.coalesce(a["args"], F.lit(""))
        objects, members = (F.regexp_extract_all(args, F.lit(STR_CALL), F.lit(i)) for i in (1, 2))
        kind = F.element_at(kinds, a["name"])
        member = F.when(kind == "Delegate", F.coalesce(none(F.get(members, 1)), none(F.get(objects, 1)))).otherwise(none(F.get(members, 0)))
        return F.struct(kind.alias("source_kind"), none(F.get(objects, 0)).alias("source_object"), member.alias("source_member"), none(F.regexp_extract(args, EVENT_TYPE, 1)).alias("event_type"))

    found = F.transform(F.filter(attributes(source), lambda a: a["name"].isin(*HANDLERS)), shown)
    return F.filter(found, lambda h: h["source_object"].isNotNull())


def log_diagnostic(line: Column) -> Column:
    """struct(file, line, col, kind, code, message) of a compiler's log line; null for others."""
    g = lambda i: F.regexp_extract(line, DIAGNOSTIC, i)
    return F.when(line.rlike(DIAGNOSTIC), F.struct(g(1).alias("file"), g(2).cast("int").alias("line"), g(3).cast("int").alias("col"), F.lower(g(4)).alias("kind"), g(5).alias("code"), g(6).alias("message")))


def alias_of(col: Column, names: dict[str, list[str]]) -> Column:
    """The canonical name of an alias, compared without case, blanks, dashes and underscores; null for others."""
    plain = F.regexp_replace(F.lower(col), r"[\s_-]+", "")
    fold = lambda s: re.sub(r"[\s_-]+", "", s.lower())
    return reduce(lambda out, kv: F.when(plain.isin(*{fold(x) for x in [kv[0], *kv[1]]}), F.lit(kv[0])).otherwise(out), names.items(), F.lit(None).cast("string"))


# Table patterns with their other names; form patterns by the parts of a name that tell them, in order.
TABLE_PATTERNS = {
    "Main": ["main", "master"],
    "Transaction": ["transaction", "transactional", "trans"],
    "Parameter": ["parameter", "parameters", "setup", "config", "configuration"],
    "Group": ["group", "category"],
    "WorksheetHeader": ["worksheetheader", "header"],
    "WorksheetLine": ["worksheetline", "line", "lines"],
    "Reference": ["reference", "lookup", "ref"],
    "Framework": ["framework"],
    "Miscellaneous": ["miscellaneous", "misc"],
}
FORM_PATTERNS = (
    (r"simplelist.*detail|detail.*simplelist", "SimpleListDetails"),
    (r"simplelist", "SimpleList"),
    (r"listpage", "ListPage"),
    (r"details?master|^master$", "DetailsMaster"),
    (r"details?transaction|^transaction$", "DetailsTransaction"),
    (r"dialog", "Dialog"),
    (r"tableofcontents|toc|parameter", "TableOfContents"),
    (r"lookup", "Lookup"),
    (r"workspace|panorama|operational", "Workspace"),
)


def table_pattern(col: Column) -> Column:
    """A table pattern by any of its names; null for others."""
    return alias_of(F.regexp_replace(col, r"[^\p{L}]", ""), TABLE_PATTERNS)


def form_pattern(col: Column) -> Column:
    """The form pattern that a name tells; SimpleList where it tells none."""
    plain = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}]", ""))
    out: Column = F.lit("SimpleList")
    for pattern, name in reversed(FORM_PATTERNS):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out
