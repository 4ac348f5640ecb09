"""Registered queries of the catalogue operators over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fuzzy, text
from lodestrata.operators import details, fulltext, graph, lint, relations, search, stats
from lodestrata.plans import tree_queries
from lodestrata.plans.catalogue import merge_fingerprints, replace_by, update_labels
from lodestrata.plans.tables import Tables
from lodestrata.session import shared_dir
from lodestrata.sources import label_files
from lodestrata.sources.labels import read_label_files


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name, with the SQL that gives its rows."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- searches


@query("select c_name, n_name, c_acctbal from customer join nation on n_nationkey=c_nationkey where c_name ilike '%r#00000001%' order by c_name limit 50")
def search_ci_topk(t):
    return search.search(t.customer, "R#00000001", ["c_name"], t.nation, "n_nationkey", "c_nationkey").select("c_name", "n_name", "c_acctbal")


USAGES = """select * from (select 'Customer' as kind, c_name as name, n_name as model from customer join nation on n_nationkey=c_nationkey where c_name ilike '%0001%'
 union all select 'Supplier', s_name, n_name from supplier join nation on n_nationkey=s_nationkey where s_name ilike '%0001%'
 union all select 'Part', p_name, p_brand from part where p_name ilike '%0001%' or p_brand ilike '%0001%') order by name, kind, model limit 100"""


def branches(t):
    n = t.nation.select("n_nationkey", "n_name")
    c, s = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")), t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return [
        ("Customer", c, F.col("c_name"), F.col("n_name"), [F.col("c_name")]),
        ("Supplier", s, F.col("s_name"), F.col("n_name"), [F.col("s_name")]),
        ("Part", t.part, F.col("p_name"), F.col("p_brand"), [F.col("p_name"), F.col("p_brand")]),
    ]


@query(USAGES)
def usages_union_all(t):
    return search.usages(branches(t), "0001")


@query("""select kind, count(*) as n from (select 'Customer' as kind, c_name as name from customer union all select 'Supplier', s_name from supplier union all select 'Part', p_name from part)
 where name ilike '%red%' group by kind""")
def by_kind_counts(t):
    parts = [(k, df, name, model, [name]) for k, df, name, model, _ in branches(t)]
    return search.counts_by_kind(search.usages(parts, "red", None))


@query("""select q.needle as needle, count(c.c_custkey) as hits from (values ('00001'),('0000012'),('zzz')) q(needle) left join customer c on contains(lower(c.c_name), lower(q.needle)) group by q.needle""")
def batch_search(t):
    needles = t.spark.createDataFrame([("00001",), ("0000012",), ("zzz",)], "needle string")
    return search.batch_search(t.customer, needles, "c_name")


@query("select doc_id, lang, source from documents where text ilike '%tion%' and lower(lang) in ('en','fr') order by source, doc_id limit 100")
def label_like_lang(t):
    return search.search_labels(t.documents, "TION", ["EN", "fr"], on=("text",), lang_col="lang", order=["source", "doc_id"]).select("doc_id", "lang", "source")


@query("select c_name, regexp_extract(c_name,'^@?([A-Za-z]*)',1) as pre, regexp_extract(c_name,'^@?[A-Za-z]*(.*)$',1) as suf from customer")
def resolve_token(t):
    pre, suf = text.token_parts(F.col("c_name"))
    return t.customer.select("c_name", pre.alias("pre"), suf.alias("suf"))


@query("""select s.kind, s.name, s.model, s.source_path from (select 'Customer' as kind, c_name as name, c_mktsegment as model, case when c_acctbal>0 then c_name||'.xml' else '' end as source_path from customer
 union all select 'Supplier', s_name, 'S', nullif(s_name||'.xml', s_name||'.xml') from supplier) s where coalesce(source_path,'')<>'' and model='BUILDING'""")
def source_paths(t):
    c = t.customer.select(F.lit("Customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("model"), F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit(".xml"))).otherwise("").alias("source_path"))
    s = t.supplier.select(F.lit("Supplier").alias("kind"), F.col("s_name").alias("name"), F.lit("S").alias("model"), F.lit(None).cast("string").alias("source_path"))
    return search.source_paths(c.unionByName(s), "BUILDING")


# ---------------------------------------------------------------- details


@query("select o_orderkey, to_json(list(l_partkey order by l_linenumber, l_partkey))::varchar as j from orders join lineitem on l_orderkey=o_orderkey group by o_orderkey")
def details_json_children(t):
    df = details.nest(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", ["l_partkey"], ["l_linenumber", "l_partkey"], "lines", inner=True)
    return df.select("o_orderkey", F.to_json(F.transform("lines", lambda x: x["l_partkey"])).alias("j"))


@query("select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as csv from lineitem group by l_orderkey")
def fields_csv(t):
    return details.csv_of(t.lineitem, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"])


COALESCED = "coalesce(case when event_type='error' then null else cast(user_id as bigint) end, event_id)"


@query(f"select event_id, case when event_type='error' then null else cast(user_id as bigint) end as v from events order by {COALESCED}, event_id limit 20")
def coalesce_order(t):
    v = F.when(F.col("event_type") != "error", F.col("user_id").cast("bigint"))
    return t.events.select("event_id", v.alias("v")).orderBy(F.coalesce(v, F.col("event_id")), "event_id").limit(20).select("event_id", "v")


RELATED = """select distinct s_nationkey as f, c_nationkey as t from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join supplier on s_suppkey=l_suppkey where l_quantity=50"""


def trade(t, condition: str, src: str = "f", dst: str = "t") -> DataFrame:
    l = t.lineitem.filter(condition).select("l_orderkey", "l_suppkey")  # noqa: E741
    df = l.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return df.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias(src), F.col("c_nationkey").alias(dst)).distinct()


@query(f"with rel as ({RELATED}) select f, t from rel where f=3 or t=3")
def bidirectional_or(t):
    return details.both_directions(trade(t, "l_quantity = 50"), 3, "f", "t")


@query(f"with rel as ({RELATED}), q(name) as (values (3),(5)) select q.name, f, t from q join rel on f=q.name or t=q.name")
def related_of_many(t):
    return details.related_of_many(trade(t, "l_quantity = 50"), t.spark.createDataFrame([(3,), (5,)], "name int"), "f", "t")


@query("select c_custkey, c_name from customer where lower(c_name)=lower('CUSTOMER#000000007') and lower(c_mktsegment)=lower((select c_mktsegment from customer where c_name='Customer#000000007')) order by c_custkey limit 1")
def label_nocase(t):
    one = t.customer.filter(text.eq_ci(F.col("c_name"), "CUSTOMER#000000007"))
    return one.select("c_custkey", "c_name").orderBy("c_custkey").limit(1)


# ---------------------------------------------------------------- relations


FIRST_LINE = """select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn, count(*) over (partition by l_orderkey) as dc from lineitem"""


@query(f"""with ds as ({FIRST_LINE}) select o.o_orderkey, o.o_orderpriority, ds.l_partkey as primary_part, coalesce(ds.dc,0) as ds_count from orders o left join ds on ds.l_orderkey=o.o_orderkey and ds.rn=1
 where o.o_orderpriority like '1%' and exists (select 1 from lineitem l where l.l_orderkey=o.o_orderkey and l.l_suppkey=7)""")
def form_patterns_exists_firstchild(t):
    o = t.orders.select("o_orderkey", "o_orderpriority").filter(text.prefix(F.col("o_orderpriority"), "1"))
    o = relations.having_child(o, t.lineitem.filter("l_suppkey = 7"), "o_orderkey", "l_orderkey")
    return relations.with_first_child(o, t.lineitem, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "primary_part", "ds_count")


@query("select coalesce(nullif(o_orderpriority,'4-NOT SPECIFIED'),'(none)') as pattern, count(*) as cnt from orders group by coalesce(nullif(o_orderpriority,'4-NOT SPECIFIED'),'(none)')")
def pattern_histogram(t):
    return relations.histogram(t.orders, "o_orderpriority", blank="4-NOT SPECIFIED")


@query(f"""with fc as (select o_orderkey, o_orderpriority, l_partkey from orders join ({FIRST_LINE}) x on l_orderkey=o_orderkey and rn=1)
 select a.o_orderkey as ref, b.o_orderkey as peer from fc a join fc b on a.o_orderpriority=b.o_orderpriority and a.l_partkey=b.l_partkey and a.o_orderkey<>b.o_orderkey where a.o_orderkey=5""")
def similar_objects(t):
    first = details.first_child(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_orderpriority").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    return relations.similar_forms(o, 5, "o_orderkey", ("o_orderpriority", "l_partkey"))


SECURITY = """select r.r_name, n.n_name, c.c_custkey, o.o_orderkey from region r join nation n on n.n_regionkey=r.r_regionkey join customer c on c.c_nationkey=n.n_nationkey left join orders o on o.o_custkey=c.c_custkey and o.o_totalprice>450000
 union all select r.r_name, null, s.s_suppkey, l.l_orderkey from region r join nation n on n.n_regionkey=r.r_regionkey join supplier s on s.s_nationkey=n.n_nationkey left join lineitem l on l.l_suppkey=s.s_suppkey and l.l_quantity=50"""


def closure(t) -> DataFrame:
    roles = t.region.select(F.col("r_name").alias("name"))
    rn = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("role"), F.col("n_name").alias("duty"), "n_nationkey")
    dp = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("duty"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("privilege"))
    rp = rn.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("role", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("privilege"))
    ec = t.orders.filter("o_totalprice > 450000").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("privilege"), F.col("o_orderkey").cast("string").alias("object_name"), F.lit("Order").alias("object_type"), F.lit(None).cast("string").alias("access_level"))
    es = t.lineitem.filter("l_quantity = 50").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("privilege"), F.col("l_orderkey").cast("string").alias("object_name"), F.lit("Line").alias("object_type"), F.lit(None).cast("string").alias("access_level"))
    return relations.security_map(roles, rn.drop("n_nationkey"), dp, rp, ec.unionByName(es))


@query(SECURITY)
def security_map(t):
    return closure(t).select(F.col("role").alias("r_name"), F.col("duty").alias("n_name"), F.substring("privilege", 2, 20).cast("bigint").alias("c_custkey"), F.col("object_name").cast("bigint").alias("o_orderkey"))


@query("""select r.r_name as role, n.n_name as duty, o.o_orderkey from region r join nation n on n.n_regionkey=r.r_regionkey join customer c on c.c_nationkey=n.n_nationkey join orders o on o.o_custkey=c.c_custkey and o.o_totalprice>450000
 where o.o_orderkey in (select min(o_orderkey) from orders where o_totalprice>450000)""")
def security_coverage(t):
    first = t.orders.filter("o_totalprice > 450000").agg(F.min("o_orderkey")).first()[0]
    return relations.security_coverage(closure(t), str(first), "ORDER").select("role", "duty", F.col("object_name").cast("bigint").alias("o_orderkey"))


@query("""select s.s_name as source, '/'||p.p_name as target, l.l_linenumber as line, coalesce(n.n_name,'') as module from lineitem l join supplier s on s.s_suppkey=l.l_suppkey join part p on p.p_partkey=l.l_partkey left join nation n on n.n_nationkey=s.s_nationkey and n.n_nationkey<20
 where ('/'||p.p_name='/red widget' or '/'||p.p_name like '/red widget/%' or '/'||p.p_name like '%/red widget%') and l.l_linenumber=3 order by source, target, line, l_orderkey limit 200""")
def xref_topn(t):
    names = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("module_id"))
    names = names.unionByName(t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("/"), "p_name").alias("path"), F.lit(None).cast("int").alias("module_id")))
    refs = t.lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_id"), F.col("l_linenumber").alias("kind"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("column"))
    modules = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("module"))
    return relations.cross_references(refs, names, modules, "red widget", "call").select("source", "target", "line", "module")


@query("""select n_name, coalesce(a.k,0) as coc, coalesce(b.k,0) as handlers, coalesce(x.k,0) as extensions, case when coalesce(a.k,0)>0 then 'coc' when coalesce(b.k,0)>0 then 'handler' when coalesce(x.k,0)>0 then 'extension' else 'none' end as strategy from nation
 left join (select s_nationkey v, count(*) k from supplier where s_acctbal<1000 group by 1) a on a.v=n_nationkey left join (select c_nationkey v, count(*) k from customer where c_acctbal<-900 group by 1) b on b.v=n_nationkey left join (select c_nationkey v, count(*) k from customer where c_acctbal>9900 group by 1) x on x.v=n_nationkey""")
def extension_points(t):
    counts = {"coc": t.supplier.filter("s_acctbal < 1000").select("s_nationkey"), "handlers": t.customer.filter("c_acctbal < -900").select("c_nationkey"), "extensions": t.customer.filter("c_acctbal > 9900").select("c_nationkey")}
    return relations.extension_points(t.nation.select("n_nationkey", "n_name"), "n_nationkey", counts).drop("n_nationkey")


@query("select c_custkey, 'see '||n_name||' [[@N'||cast(c_nationkey as varchar)||']] and @Z1' as txt from customer join nation on n_nationkey=c_nationkey")
def inline_labels(t):
    rows = t.customer.select("c_custkey", F.concat(F.lit("see @N"), F.col("c_nationkey").cast("string"), F.lit(" and @Z1")).alias("txt"))
    labels = t.nation.select(F.lit("N").alias("label_file"), F.lit("en-us").alias("language"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return relations.inline_labels(rows, labels, "txt", "c_custkey", ["en-us"])


@query("""select o_custkey, string_agg(o_orderkey||'='||case when o_orderkey%3=0 then coalesce(n_name||' [[@N'||o_orderkey%30||']]', '@N'||o_orderkey%30) else 'plain' end, ',' order by o_orderkey) as leaves,
 any_value(case when c_nationkey is null then null else n2||' [[@N'||c_nationkey||']]/@Z1' end) as top from orders left join nation on n_nationkey=o_orderkey%30 join (select c_custkey, c_nationkey, n_name as n2 from customer join nation on n_nationkey=c_nationkey) on c_custkey=o_custkey group by o_custkey""")
def inline_nested_labels(t):
    """Tokens in structs in an array of a struct, as details of objects have them."""
    token = lambda c: F.concat(F.lit("@N"), c.cast("string"))
    leaf = F.struct("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 3 == 0, token(F.col("o_orderkey") % 30)).otherwise("plain").alias("text")).alias("label"))
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(leaf)).alias("fields"))
    rows = rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", F.struct(F.concat(token(F.col("c_nationkey")), F.lit("/@Z1")).alias("top"), "fields").alias("object"))
    labels = t.nation.select(F.lit("N").alias("label_file"), F.lit("en-us").alias("language"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    got = relations.inline_nested(rows, labels, "o_custkey", languages=["en-us"])
    leaves = F.transform("object.fields", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("="), x["label"]["text"]))
    return got.select("o_custkey", F.array_join(leaves, ",").alias("leaves"), F.col("object.top").alias("top"))


@query("""with n as (select distinct replace(s_name,'Supplier','Custome') as needle from supplier), p as (select needle, c_name as name, levenshtein(lower(needle), lower(c_name))::int as dist from n, (select distinct c_name from customer))
 select needle, name, dist, rank::int as rank from (select *, row_number() over (partition by needle order by dist, lower(name), name) as rank from p where dist<=2) where rank<=5""")
def suggest_many(t):
    """Misspelt names, all at once, with the nearest names of customers."""
    needles = t.supplier.select(F.replace("s_name", F.lit("Supplier"), F.lit("Custome")).alias("needle"))
    return fuzzy.suggest_many(t.customer, needles, name_col="c_name")


@query(r"select doc_id from documents where regexp_matches(text,'(?i)\bthe\b')")
def refs_regex(t):
    return relations.source_references(t.documents.select("doc_id", "text"), "the", "text").select("doc_id")


@query(r"""select searched, count(*) as n from documents, (select distinct lower(regexp_extract(text,'\w+',0)) as searched from benchmark where regexp_extract(text,'\w+',0)<>'')
 where regexp_matches(text,'(?i)\b'||searched||'\b') group by searched""")
def references_of_many(t):
    """How many documents hold each of many words, by one look at every document."""
    names = t.benchmark.select(F.lower(F.regexp_extract("text", r"\w+", 0)).alias("name")).filter("name <> ''")
    postings = relations.identifier_postings(t.documents.select("doc_id", "text"), "text")
    return relations.references_of(postings, names).groupBy("searched").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- statistics


@query("select 'region' as k, count(*) as n from region union all select 'nation', count(*) from nation union all select 'lineitem', count(*) from lineitem")
def count_all(t):
    return stats.count_all({k: getattr(t, k) for k in ("region", "nation", "lineitem")})


@query("""select n.n_name, coalesce(c.k,0) as customers, coalesce(sp.k,0) as suppliers from nation n left join (select c_nationkey, count(*) k from customer group by 1) c on c.c_nationkey=n.n_nationkey
 left join (select s_nationkey, count(*) k from supplier group by 1) sp on sp.s_nationkey=n.n_nationkey""")
def stats_per_model(t):
    return stats.counts_per_owner(t.nation, "n_nationkey", "n_name", {"customers": (t.customer, "c_nationkey"), "suppliers": (t.supplier, "s_nationkey")})


@query("select o.o_orderkey, count(l.l_linenumber) as k from orders o left join lineitem l on l.l_orderkey=o.o_orderkey group by o.o_orderkey order by k desc, o.o_orderkey limit 10")
def stats_top_children(t):
    return stats.top_by_children(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "l_linenumber")


@query("select c_nationkey, count(*) as n from customer group by c_nationkey order by n desc, c_nationkey limit 10")
def stats_top_groups(t):
    return stats.top_groups(t.customer, "c_nationkey")


@query("select event_id, user_id, event_type from events where user_id=8 order by event_id desc limit 50")
def history_topk(t):
    return stats.history(t.events, {"user_id": 8}, "event_id", 50, ["event_id", "user_id", "event_type"])


@query("select user_id, concat(cast(count(*) as varchar),':',cast(max(event_id) as varchar)) as fp from events group by user_id")
def fingerprint(t):
    return stats.fingerprints(t.events, "user_id", "event_id")


@query("select lower(w) as w, min(w) as keep, count(*) as n from (select unnest(regexp_split_to_array(text,'[^\\p{L}]+')) as w from documents) where w<>'' group by lower(w)")
def dedupe_ci(t):
    w = t.documents.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    return stats.dedupe_ci(w, "w")


# ---------------------------------------------------------------- lint


@query("select o.o_orderkey from orders o left join lineitem l on l.l_orderkey=o.o_orderkey where l.l_orderkey is null")
def lint_left_anti(t):
    return lint.without_children(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey")


@query("select s_name from supplier s where s_name like '%9' and not exists (select 1 from lineitem l where l.l_suppkey=s.s_suppkey and l.l_returnflag='R' and l.l_quantity>=50)")
def lint_not_exists(t):
    return lint.without_children(t.supplier.filter(F.col("s_name").endswith("9")), t.lineitem.filter("l_returnflag = 'R' AND l_quantity >= 50"), "s_suppkey", "l_suppkey").select("s_name")


@query("""select concat(n.n_name,'.',c.c_name) as target, r.r_name as model, c.c_mktsegment as detail from customer c join nation n on n.n_nationkey=c.c_nationkey join region r on r.r_regionkey=n.n_regionkey
 where c.c_mktsegment='BUILDING' and (c.c_acctbal is null or c.c_acctbal<0)""")
def lint_string_without_child(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    fields = df.select(F.col("n_name").alias("table"), F.col("c_name").alias("name"), F.col("r_name").alias("model"), F.when(F.col("c_mktsegment") == "BUILDING", "String").alias("type"), F.when(F.col("c_acctbal") >= 0, "typed").alias("edt_name"))

    class One:
        def table(self, _: str) -> DataFrame:
            return fields

    return lint.string_fields_without_type(One(), only_custom=False).select("target", "model", F.lit("BUILDING").alias("detail"))


@query("""with o as (select 'Table' as kind, r_name as name from region union all select 'Enum', n_name from nation union all select 'Coc', c_mktsegment from (select distinct c_mktsegment from customer)),
 v as (select kind, name, unnest(list_filter([case when trim(name)='' then 'EMPTY_NAME' end, case when length(name)>80 then 'NAME_TOO_LONG' end, case when regexp_matches(name,'[^\\p{L}\\p{Nd}_]') then 'INVALID_CHARS' end,
  case when regexp_matches(name,'^\\p{Nd}') then 'LEADS_WITH_DIGIT' end, case when not regexp_matches(name,'^[\\p{Lu}_]') then 'NOT_PASCAL_CASE' end, case when kind='Coc' and not ends_with(name,'_Extension') then 'COC_SUFFIX' end,
  case when kind='Table' and regexp_matches(name,'\\p{Ll}Table$') then 'TABLE_SUFFIX' end, case when kind='Enum' and starts_with(name,'Enum') then 'ENUM_PREFIX_REDUNDANT' end, case when not starts_with(name,'A') then 'MISSING_PUBLISHER_PREFIX' end], lambda x: x is not null)) as code from o)
 select kind, name, code, case when code in ('EMPTY_NAME','INVALID_CHARS','LEADS_WITH_DIGIT') then 'error' when code in ('TABLE_SUFFIX','ENUM_PREFIX_REDUNDANT') then 'info' else 'warn' end as severity from v""")
def naming_rules(t):
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    o = named(t.region, "Table", "r_name").unionByName(named(t.nation, "Enum", "n_name")).unionByName(named(t.customer.select("c_mktsegment").distinct(), "Coc", "c_mktsegment"))
    return lint.validate_names(o, "A")


@query("""select source_path, 'HARDCODED_STRING' as rule, snippet from (select page_id as source_path, unnest(regexp_extract_all(html,'@?"[^"\\n]{3,}"')) as snippet from pages)""")
def review_literals(t):
    return lint.review_sources(t.pages.select(F.col("page_id").alias("source_path"), F.col("html").alias("content")))


# ---------------------------------------------------------------- maintenance


@query("select c_custkey, c_name, c_nationkey from customer where c_nationkey<>3 union all select c_custkey, concat(c_name,'*'), c_nationkey from customer where c_nationkey=3 and c_acctbal>0")
def replace_model(t):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    new = t.customer.filter("c_nationkey = 3 AND c_acctbal > 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey")
    return replace_by(c, new, "c_nationkey", [3])


@query("""select coalesce(a.n_nationkey,b.n_nationkey) as model, coalesce(case when b.n_nationkey%2=0 then 'new' end, a.n_name) as fingerprint from (select * from nation where n_nationkey<20) a full join (select * from nation where n_nationkey>=10) b on a.n_nationkey=b.n_nationkey""")
def merged_fingerprints(t):
    old = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("model"), F.col("n_name").alias("fingerprint"))
    new = t.nation.filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("model"), F.when(F.col("n_nationkey") % 2 == 0, "new").alias("fingerprint"))
    return merge_fingerprints(old, new)


@query("""select 'F' as label_file, 'en' as language, case when n_nationkey=3 then 'moved' else n_name end as key, case when n_nationkey=2 then 'changed' else cast(n_regionkey as varchar) end as value from nation where n_nationkey<>1 union all select 'F','en','added','x'""")
def label_changes(t):
    labels = t.nation.select(F.lit("F").alias("label_file"), F.lit("en").alias("language"), F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    on = t.nation.select(F.lit("F").alias("label_file"), F.lit("en").alias("language"), F.col("n_name").alias("key"), F.when(F.col("n_nationkey") == 2, "changed").alias("value"), F.when(F.col("n_nationkey") == 3, "moved").alias("new_key"), "n_nationkey").filter("n_nationkey IN (1,2,3)").drop("n_nationkey")
    added = t.spark.createDataFrame([("F", "en", "added", "x", None)], on.schema)
    return update_labels(labels, on.unionByName(added))


@query("""with p as (select 'L'||(p_size%7) as label_file, 'en-us' as language, p_partkey%10 as m, p_partkey, p_name, p_type from part)
select label_file, language, case when m=1 then 'N' else 'K' end||p_partkey as key, case when m=0 then p_type||'\\n'||p_partkey else p_name end as value from p where m<>2
union all select label_file, language, 'A'||p_partkey, p_type from p where m=3""")
def changed_label_files(t):
    """Label files, written, changed by keys (set, renamed, deleted and added ones) and read again."""
    path = F.concat(F.lit("P/M/AxLabelFile/L"), (F.col("p_size") % 7).cast("string"), F.lit(".en-us.label.txt"))
    part = t.part.select(path.alias("path"), (F.col("p_partkey") % 10).alias("m"), "p_partkey", F.concat(F.lit("K"), "p_partkey").alias("key"), "p_name", "p_type")
    root = f"{shared_dir(t.spark)}/trees/{uuid.uuid4().hex}"
    folder = t.spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(t.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    text = lambda n, line: part.select("path", (F.col("p_partkey") * 2 + n).cast("bigint").alias("n"), line.alias("line"))
    label_files.write_lines(text(0, F.concat(F.lit(";"), "p_type")).unionByName(text(1, F.concat("key", F.lit("="), "p_name"))), root)
    change = lambda m, key, value, new_key: part.filter(F.col("m") == m).select(F.col("p_partkey").alias("change_id"), "path", key.alias("key"), value.cast("string").alias("value"), new_key.cast("string").alias("new_key"))
    none, key = F.lit(None), F.col("key")
    of = [
        change(0, key, F.concat("p_type", F.lit("\n"), "p_partkey"), none), change(1, key, none, F.concat(F.lit("N"), "p_partkey")), change(2, key, none, none),
        change(3, F.concat(F.lit("A"), "p_partkey"), F.col("p_type"), none),
    ]
    label_files.change_label_files(t.spark, root, reduce(DataFrame.unionByName, of), overwrite=True)
    return read_label_files(t.spark, root).select("label_file", "language", "key", "value")


# ---------------------------------------------------------------- text


@query("select doc_id, array_to_string(list_slice(string_split(replace(text,chr(13)||chr(10),chr(10)),chr(10)),2,4),chr(10)) as sl from documents where len(string_split(replace(text,chr(13)||chr(10),chr(10)),chr(10)))>=2")
def line_slice(t):
    return t.documents.select("doc_id", text.line_slice(F.col("text"), 2, 4).alias("sl")).filter("sl IS NOT NULL")


@query("select doc_id, array_to_string(list_slice(string_split(text,chr(10)), greatest(len(string_split(text,chr(10)))-1,1), len(string_split(text,chr(10)))),chr(10)) as tl from documents")
def tail_lines(t):
    return t.documents.select("doc_id", text.tail(F.col("text"), 2).alias("tl"))


@query(r"""with l as (select doc_id, unnest(range(1,len(a)+1)) as ln, unnest(a) as txt from (select doc_id, string_split(text,chr(10)) a from documents)), h as (select doc_id, ln from l where regexp_matches(txt,'(?i)\bthe\b')),
 near as (select distinct l.doc_id, l.ln, l.txt from l join h on h.doc_id=l.doc_id and l.ln between h.ln-1 and h.ln+1), marked as (select *, lag(ln) over (partition by doc_id order by ln) as p from near),
 o as (select doc_id, string_agg(case when p<ln-1 then '---'||chr(10) else '' end||ln||': '||txt, chr(10) order by ln) as ctx from marked group by doc_id)
 select d.doc_id, coalesce(o.ctx,'') as ctx from documents d left join o on o.doc_id=d.doc_id""")
def around_context(t):
    return text.around_pattern(t.documents.select("doc_id", "text"), "text", r"\bthe\b", 1, "ctx").select("doc_id", "ctx")


@query(r"select doc_id, length(regexp_replace(text,'[\x00-\x08\x0B\x0C\x0E-\x1F]','','g')) as n from documents")
def sanitize(t):
    return t.documents.select("doc_id", F.length(text.sanitize(F.col("text"))).cast("bigint").alias("n"))


@query("select n_name, case when n_name ilike 'NATION\\_12' escape '\\' then false when n_name ilike 'NATION\\_1%' escape '\\' then true else false end as m from nation")
def glob_last_match(t):
    return t.nation.select("n_name", text.glob_match(F.col("n_name"), ["nation_1*", "", "!Nation_12"]).alias("m"))


@query("select page_id, kv, split_part(kv,'=',1) as k, substring(kv,instr(kv,'=')+1) as v from (select page_id, unnest(regexp_extract_all(url,'[?&]([^&#]+)',1)) as kv from pages) where instr(kv,'=')>0")
def kv_first_eq(t):
    rows = t.pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[?&]([^&#]+)"), F.lit(1))).alias("kv"))
    k, v = text.key_value(F.col("kv"))
    return rows.select("page_id", "kv", k.alias("k"), v.alias("v")).filter("k IS NOT NULL")


@query("select page_id, regexp_extract(html,'<title>(.*?)</title>',1) as title from pages")
def html_title(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("select page_id, unnest(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1)) as href from pages")
def html_links(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("select page_id, unnest(regexp_extract_all(html,'<(h[1-6]|p|title|li)[ >]',1)) as tag from pages")
def attribute_scan(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(h[1-6]|p|title|li)[ >]"), F.lit(1))).alias("tag"))


@query("select event_id, cast(json_extract_string(props,'$.k') as int) as k from events")
def json_get(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""select conv_id, turn, list_filter(regexp_split_to_array(trim(s),' +'), lambda w: w not in ('public','protected','private','static','final','abstract','client','server'))[1] as rtype from (select conv_id, turn, 'public static '||replace(replace(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>'')[1],'(',' '),'[',' ') as s from conversations)""")
def signature_return_type(t):
    first = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 0)
    s = F.concat(F.lit("[Attr(\n a)]\npublic static "), F.translate(first, "([", "  "))
    return t.conversations.select("conv_id", "turn", text.return_type(text.signature_line(s)).alias("rtype"))


# ---------------------------------------------------------------- fuzzy names


@query("select p_name, levenshtein(lower(p_name),'red wigdet') as dist from (select distinct p_name from part) order by dist, p_name limit 5")
def edit_distance_rank(t):
    return fuzzy.rank_by_distance(t.part, "Red Wigdet", "p_name")


@query("""select name, levenshtein(lower(name),'red') as dist from (select distinct p_name as name from part where p_name ilike '%red%' order by name limit 50) order by dist, lower(name), name limit 5""")
def suggest_names(t):
    return fuzzy.suggest_names(t.part.select(F.lit("Part").alias("kind"), F.col("p_name").alias("name")), "Part", "Red").withColumn("dist", F.col("dist").cast("bigint"))


@query("""select name, conf from (select name, case when low='redwidgetid' then 1.0 when low='redwidget' then 0.9 when coalesce(case when ends_with(low,'id') and length(low)>2 then left(low,length(low)-2) when ends_with(low,'ids') and length(low)>3 then left(low,length(low)-3) when ends_with(low,'no') and length(low)>2 then left(low,length(low)-2) when ends_with(low,'num') and length(low)>3 then left(low,length(low)-3)
   when ends_with(low,'number') and length(low)>6 then left(low,length(low)-6) when ends_with(low,'name') and length(low)>4 then left(low,length(low)-4) when ends_with(low,'key') and length(low)>3 then left(low,length(low)-3) when ends_with(low,'code') and length(low)>4 then left(low,length(low)-4) when ends_with(low,'value') and length(low)>5 then left(low,length(low)-5) end, low)='redwidget' then 0.85
  when contains('redwidgetid',low) or contains(low,'redwidgetid') then 0.7 when contains(low,'redwidget') or contains('redwidget',low) then 0.6 when sim>=0.55 then round_even(0.4+(sim-0.55)*0.8,2) else 0 end::double as conf
  from (select name, lower(name) as low, 1.0::double-levenshtein(lower(name),'redwidgetid')/cast(greatest(length(name),11) as double) as sim from (select distinct replace(p_name,' ','') as name from part)))
 where conf>=0.4 order by conf desc, lower(name), name limit 5""")
def suggest_edt(t):
    return fuzzy.suggest_types(t.part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name")).distinct(), "redWidgetId")


# ---------------------------------------------------------------- full text


TOKENS = r"select doc_id, unnest(regexp_split_to_array(lower(strip_accents(text)),'[^\p{L}\p{N}]+')) as t from documents"


@query(f"""with tok as (select * from ({TOKENS}) where t<>''), dl as (select doc_id, count(*) n from tok group by 1), st as (select count(*) nn, avg(n) a from dl), tf as (select doc_id, t, count(*) f from tok where t in ('zu','nicht') group by 1,2), df as (select t, count(*) d from tf group by 1)
 select tf.doc_id, round(sum(greatest(ln((nn-d+0.5)/(d+0.5)),1e-6)*f*2.2/(f+1.2*(0.25+0.75*n/a))),6) as score from tf join df using(t) join dl on dl.doc_id=tf.doc_id cross join st group by tf.doc_id having count(*)=2""")
def bm25_fts5(t):
    terms = ["zu", "nicht"]
    postings, lengths = fulltext.selected(t.documents, "doc_id", ["text"], [{"words": [w], "prefix": False} for w in terms])
    return fulltext.bm25(postings, lengths, "doc_id", terms).select("doc_id", F.round("score", 6).alias("score"))


PHRASE = r"select doc_id from documents where regexp_matches(text,'(?i)(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)')"


@query(PHRASE)
def fts_phrase(t):
    return fulltext.phrase_scan(t.documents, "text", ["of", "the"]).select("doc_id")


@query(PHRASE)
def fts_index_phrase(t):
    return fulltext.match(t.documents, "doc_id", ["text"], '"of the"').select("doc_id")


# ---------------------------------------------------------------- graphs


EDGES = "select distinct s_nationkey src, c_nationkey dst from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join supplier on s_suppkey=l_suppkey where l_quantity=50 and l_discount=0.1"


@query(f"""with e as ({EDGES} and l_tax=0.08), fo as (select src, count(*) k from e group by src), fi as (select dst, count(*) k from e group by dst)
 select n_nationkey as v, coalesce(fo.k,0) as fan_out, coalesce(fi.k,0) as fan_in, case when coalesce(fo.k,0)+coalesce(fi.k,0)=0 then 0.0 else round_even(cast(coalesce(fo.k,0) as double)/(coalesce(fo.k,0)+coalesce(fi.k,0)),3) end as instability from nation left join fo on fo.src=n_nationkey left join fi on fi.dst=n_nationkey""")
def coupling(t):
    return graph.coupling(trade(t, "l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08", "src", "dst"), t.nation, "n_nationkey")


@query(f"""with recursive e as ({EDGES}), r(src,dst) as (select src, dst from e union select r.src, e.dst from r join e on r.dst=e.src)
 select a.src as v, min(b.src) as comp from r a join r b on a.src=b.dst and a.dst=b.src group by a.src""")
def scc_cycles(t):
    return graph.strong_components(trade(t, "l_quantity = 50 AND l_discount = 0.1", "src", "dst"))


@query(f"with recursive e as ({EDGES} and l_tax=0.08), r(v) as (select dst from e where src=3 union select e.dst from r join e on e.src=r.v) select v from r")
def reachable(t):
    return graph.dependencies(trade(t, "l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08", "src", "dst"), "3", transitive=True)[0]


def queries() -> dict:
    return QUERIES | tree_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | tree_queries.SQL
