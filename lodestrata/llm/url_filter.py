"""URL filters: a sort-merge range join of urls and host/path rules, in DataFrame operations only.

A host's labels, reversed and closed by a dot, make a key of which every rule for a parent domain is a prefix.
A prefix is an interval of the sorted keys, and intervals of prefixes nest. `prefix_stacks` sorts points together
with the starts and ends of rules, keeps a running depth, and remembers for each depth the rule that opened last:
these columns are the stack of active rules. It runs first over distinct hosts, then over distinct paths below
each rule's host.

Defined results: a null url, or one without `://`, has an empty host and path. Repeated pages each keep their row.
A page that no rule fits gets the default verdict and a null rule. Rules with a null host, path or verdict are
ignored; of equal (host, path) rules `block` wins. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import checkpoint, partitions

#: Sorts after every continuation of a prefix.
LAST = "\U0010ffff"
START, POINT, END = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, without query and fragment."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def prefix_stacks(points: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct `key` of points, the `stack` of rule keys that are its prefixes, shortest first.

    Points without a rule are left out. The sort is by ranges; what crosses from one range to the next is the depth
    and the open rule of each depth, a table of one row per range.
    """
    spark = points.sparkSession
    rules = rules.select("key").distinct()
    events = (
        rules.select("key", F.lit(START).alias("kind"))
        .unionByName(rules.select(F.concat("key", F.lit(LAST)).alias("key"), F.lit(END).alias("kind")))
        .unionByName(points.select("key").distinct().select("key", F.lit(POINT).alias("kind")))
    )
    # The range's number is stored with its rows: later steps must all see the same ranges.
    ranged = checkpoint(events.repartitionByRange(partitions(spark), "key", "kind").withColumn("part", F.spark_partition_id()))

    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    swept = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    depth_in = ranged.groupBy("part").agg(F.sum(step).alias("delta")).select("part", F.coalesce(F.sum("delta").over(earlier), F.lit(0)).alias("depth_in"))
    # one row per range: its size is the number of partitions
    deep = ranged.join(F.broadcast(depth_in), "part").withColumn("depth", F.col("depth_in") + F.sum(step).over(swept))
    levels = deep.agg(F.max("depth")).first()[0] or 0
    if not levels:
        return points.select("key", F.array().cast("array<string>").alias("stack")).limit(0)

    opened = [F.when((F.col("kind") == START) & (F.col("depth") == d), F.col("key")) for d in range(1, levels + 1)]
    carried = deep.groupBy("part").agg(*[F.max(c).alias(f"open{d}") for d, c in enumerate(opened)])
    carried = carried.select("part", *[F.last(f"open{d}", ignorenulls=True).over(earlier).alias(f"in{d}") for d in range(levels)])
    stack = F.array(*[F.coalesce(F.last(c, ignorenulls=True).over(swept), F.col(f"in{d}")) for d, c in enumerate(opened)])
    return (
        deep.join(F.broadcast(carried), "part")
        .withColumn("stack", F.slice(stack, 1, F.greatest(F.col("depth"), F.lit(0)).cast("int")))
        .filter((F.col("kind") == POINT) & (F.col("depth") > 0))
        .select("key", "stack")
    )


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest rule (host and path together, then host) that fits each url, and its verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with the rule's.
    """
    host, path = parse_url(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("hk", host_key(F.col("host")))
    rules = (
        rules.select("host", "path", "verdict").dropna().withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict")).withColumn("rk", host_key(F.col("host")))
        .select("rk", F.concat("rk", F.lit("/"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("n_host"))
    )
    by_host = prefix_stacks(parsed.select(F.col("hk").alias("key")), rules.select(F.col("rk").alias("key"))).withColumnRenamed("key", "hk")
    # below each open host, paths are swept in the same way; the last on the stack is the longest path
    urls = parsed.select("hk", "path").distinct().join(by_host, "hk").select("hk", "path", F.explode("stack").alias("rk"))
    urls = urls.withColumn("key", F.concat("rk", F.lit("/"), "path"))
    by_path = prefix_stacks(urls.select("key"), rules.select("key")).select("key", F.element_at("stack", -1).alias("top"))
    best = (
        urls.join(by_path, "key").join(rules.select(F.col("key").alias("top"), "rule", "verdict", "n_host"), "top")
        .groupBy("hk", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "n_host", "rule", "verdict")).alias("best"))
    )
    return parsed.join(best, ["hk", "path"], "left").select(
        F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
