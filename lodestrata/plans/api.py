"""The operators by name, for a front end: each takes a catalogue and its parameters and returns a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import fuzzy, text
from lodestrata.operators import details, graph, lint, relations, search, stats
from lodestrata.plans.catalogue import Catalogue
from lodestrata.sources import tree

KINDS = {
    "class": "classes", "table": "tables", "edt": "edts", "enum": "enums", "query": "queries", "view": "views", "data_entity": "data_entities", "report": "reports",
    "service": "services", "workflow_type": "workflow_types", "form": "forms",
}
DETAILS = KINDS | {"menu_item": "menu_items", "service_group": "service_groups", "security_role": "security_roles", "security_duty": "security_duties", "security_privilege": "security_privileges"}
#: What is counted by model, under which name.
MODEL_COUNTS = {
    "tables": "tables", "classes": "classes", "edts": "edts", "enums": "enums", "menu_items": "menu_items", "forms": "forms", "extensions": "object_extensions", "coc": "coc", "labels": "labels",
}


def source_text(blocks: DataFrame, method: str | None = None, first: int | None = None, last: int | None = None, around: str | None = None, context: int = 3) -> DataFrame:
    """Blocks of source, or one method's (without regard to case), whole, as lines first..last, or around a pattern."""
    if method is not None:
        blocks = blocks.filter(text.eq_ci(F.col("name"), method))
    if around is not None:
        return text.around_pattern(blocks, "body", around, context, "body")
    return blocks if first is None and last is None else blocks.withColumn("body", text.line_slice(F.col("body"), first or 1, last if last is not None else (1 << 31) - 2))


def read_object(catalogue: Catalogue, table: str, name: str, **how) -> DataFrame:
    """The source of one object of a kind by its name, from the file that the catalogue names."""
    found = catalogue.table(table).filter(F.col("name") == name).orderBy("model", "source_path").select("source_path").first()
    if found is None:
        return catalogue.spark.createDataFrame([], "source_path string, kind string, name string, body string")
    return source_text(tree.read_source(catalogue.spark, found[0]), **how)


TOOLS: dict[str, Callable[..., DataFrame]] = {f"search_{k}": (lambda c, query, model=None, limit=50, t=t: search.search_kind(c, t, query, model, limit)) for k, t in KINDS.items()}
TOOLS |= {f"get_{k}": (lambda c, name, include=None, t=t: details.get(c, t, name, include)) for k, t in DETAILS.items() if k != "workflow_type"}
TOOLS |= {f"read_{k}": (lambda c, name, t=t, **how: read_object(c, t, name, **how)) for k, t in KINDS.items() if k in ("class", "table", "form")}
TOOLS |= {
    "search_any": lambda c, query, limit=100: search.find_usages(c.objects(), query, limit),
    "find_usages": lambda c, query, limit=100: search.find_usages(c.objects(), query, limit),
    "counts_by_kind": lambda c, query: search.counts_by_kind(search.find_usages(c.objects(), query, None)),
    "batch_search": lambda c, queries: search.batch_search(c.objects(), c.spark.createDataFrame([(q,) for q in queries], "needle string")),
    "source_paths": lambda c, model=None: search.source_paths(c.objects(), model),
    "suggest_names": lambda c, kind, name, limit=5: fuzzy.suggest_names(c.objects(), kind, name, limit),
    "search_labels": lambda c, query, languages=None, limit=100: search.search_labels(c.table("labels"), query, languages, limit=limit),
    "search_labels_fts": lambda c, query, languages=None, limit=100: c.search_label_texts(query, limit, languages),
    "get_label": lambda c, label_file, language, key: details.get_label(c.table("labels"), label_file, language, key),
    "get_label_by_key": lambda c, key: details.get_label_by_key(c.table("labels"), key),
    "resolve_label": lambda c, token, languages=None: search.resolve_token(c.table("labels"), c.spark.createDataFrame([(token,)], "token string"), languages),
    "find_coc_extensions": lambda c, target, method=None: relations.coc_extensions(c.table("coc"), target, method),
    "find_extensions": lambda c, target, kind=None: relations.object_extensions(c.table("object_extensions"), target, kind),
    "find_event_subscribers": lambda c, source, kind=None: relations.event_subscribers(c.table("event_subscribers"), source, kind),
    "find_form_patterns": lambda c, pattern=None, table=None, model=None, limit=50: relations.form_patterns(c.table("forms"), c.table("form_data_sources"), pattern, table, model, limit),
    "summarize_form_patterns": lambda c: relations.histogram(c.table("forms"), "pattern"),
    "similar_forms": lambda c, name, limit=50: relations.similar_forms(relations.form_patterns(c.table("forms"), c.table("form_data_sources"), limit=None), name, limit=limit),
    "find_references": lambda c, name: relations.source_references(c.table("methods").unionByName(c.table("table_methods").withColumnRenamed("table", "class")), name),
    "get_table_relations": lambda c, table: details.both_directions(c.table("relations"), table),
    "get_table_methods": lambda c, table: details.children_of(c, "table_methods", table),
    "get_table_indexes": lambda c, table: details.children_of(c, "table_indexes", table),
    "get_table_delete_actions": lambda c, table: details.children_of(c, "table_delete_actions", table),
    "get_security_coverage": lambda c, name, kind: relations.security_coverage(c.security(), name, kind),
    "suggest_edt": lambda c, field, limit=5: fuzzy.suggest_types(c.table("edts"), field, limit),
    "validate_object_naming": lambda c, kind, name, prefix=None: lint.validate_names(c.spark.createDataFrame([(kind, name)], "kind string, name string"), prefix),
    "lint_tables_without_index": lambda c, only_custom=True: lint.tables_without_index(c, only_custom),
    "lint_unmarked_extensions": lambda c, only_custom=True: lint.unmarked_extensions(c, only_custom),
    "lint_string_fields": lambda c, only_custom=True: lint.string_fields_without_type(c, only_custom),
    "list_models": lambda c: c.table("models").orderBy("name"),
    "model_dependencies": lambda c, model, transitive=False: graph.dependencies(c.dependency_edges(), model, transitive)[0],
    "model_dependents": lambda c, model, transitive=False: graph.dependencies(c.dependency_edges(), model, transitive)[1],
    "models_coupling": lambda c, top=None: graph.ranked(graph.coupling(graph.canonical_edges(c.dependency_edges()), graph.nodes_of(graph.canonical_edges(c.dependency_edges()), c.table("models").select("name"))), top),
    "models_cycles": lambda c: graph.cycles(graph.canonical_edges(c.dependency_edges())),
    "index_status": lambda c: c.counts(),
    "stats_per_model": lambda c: stats.counts_per_owner(c.table("models"), "name", "name", {name: (c.table(t), "model") for name, t in MODEL_COUNTS.items()}),
    "stats_top_tables": lambda c, limit=10: stats.top_by_children(c.table("tables"), c.table("table_fields"), "name", "table", "name", limit, within=["model"]),
    "stats_top_classes": lambda c, limit=10: stats.top_by_children(c.table("classes"), c.table("methods"), "name", "class", "name", limit, within=["model"]),
    "read_source": lambda c, path, method=None, first=None, last=None, around=None, context=3: source_text(tree.read_source(c.spark, path), method, first, last, around, context),
    "stats_top_coc": lambda c, limit=10: stats.top_groups(c.table("coc"), "target_class", limit),
    "index_history": lambda c, model=None, limit=200: stats.history(c.spark.read.parquet(f"{c.path}/extraction_runs"), {"model": model} if model else None, "started_utc", limit),
    "analyze_extension_points": lambda c, target: relations.extension_points(
        c.spark.createDataFrame([(target,)], "target string"), "target",
        {"coc": c.table("coc").select("target_class"), "handlers": c.table("event_subscribers").select("source_object"), "extensions": c.table("object_extensions").select("target_name")}),
}


#: Rows that an envelope holds at most; `truncated` says that there are more.
MOST_ROWS = 10_000


def call(catalogue: Catalogue, tool: str, **params) -> dict:
    """The result as an envelope: ok and data, or an error with a code and a message. Absent values are left out."""
    if tool not in TOOLS:
        return {"ok": False, "error": {"code": "UNKNOWN_TOOL", "message": f"no tool is called {tool}"}}
    try:
        df = TOOLS[tool](catalogue, **params)
    except TypeError as e:
        return {"ok": False, "error": {"code": "BAD_INPUT", "message": str(e)}}
    rows = [json.loads(x) for x in df.limit(MOST_ROWS + 1).toJSON().collect()]
    rows, more = rows[:MOST_ROWS], len(rows) > MOST_ROWS
    if tool.startswith("get_") and not rows:
        return {"ok": False, "error": {"code": f"{tool[4:].upper()}_NOT_FOUND", "message": f"nothing is called {next(iter(params.values()), '')}"}}
    return {"ok": True, "data": {"count": len(rows), "items": rows} | ({"truncated": True} if more else {})}


def sarif(found: DataFrame, rule: str, message: str, uri: str) -> DataFrame:
    """Findings as results of a static analysis log, one JSON text a row."""
    place = F.array(F.struct(F.struct(F.struct(F.col(uri).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return found.select(F.to_json(F.struct(F.col(rule).alias("ruleId"), F.struct(F.col(message).alias("text")).alias("message"), place.alias("locations"))).alias("result"))


# The version of the log format and where its schema lies.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"


def sarif_document(found: DataFrame, rule: str, message: str, uri: str, tool: str = "lodestrata") -> dict:
    """A whole static analysis log of findings: its version, the tool with the rules that were broken, and their results in order.

    It holds MOST_ROWS results at most and says in its properties when there are more; `sarif` gives all as rows.
    """
    shown = found.select(rule, message, uri).orderBy(rule, uri, message).limit(MOST_ROWS + 1)
    rows = [json.loads(r["result"]) for r in sarif(shown, rule, message, uri).collect()]
    rules = [{"id": r[0]} for r in found.select(rule).distinct().orderBy(rule).collect()]  # a row a rule
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": rows[:MOST_ROWS]}
    return {"version": SARIF_VERSION, "$schema": SARIF_SCHEMA, "runs": [run | ({"properties": {"truncated": True}} if len(rows) > MOST_ROWS else {})]}
