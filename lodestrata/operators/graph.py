"""Dependency graphs: coupling metrics, cycles, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialise


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges without regard to case; the least spelling of each name is shown."""
    names = edges.select(F.col(src).alias("v")).unionByName(edges.select(F.col(dst).alias("v"))).groupBy(F.lower("v").alias("k")).agg(F.min("v").alias("v"))
    e = edges.select(F.lower(src).alias("s"), F.lower(dst).alias("d")).distinct()
    a, b = names.toDF("s", "src"), names.toDF("d", "dst")
    return e.join(a, "s").join(b, "d").select("src", "dst")


def nodes_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    df = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v")))
    return (df if more is None else df.unionByName(more.toDF("v"))).distinct()


def coupling(edges: DataFrame, nodes: DataFrame, key: str = "v", places: int = 3) -> DataFrame:
    """Fan-out, fan-in and instability of each node; a node without edges has 0. A loop counts on both sides."""
    out = edges.groupBy("src").agg(F.count("*").alias("fan_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("fan_in"))
    df = nodes.join(out, nodes[key] == out["src"], "left").join(into, nodes[key] == into["dst"], "left")
    df = df.select(nodes[key].alias("v"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_out", "fan_in")])
    total = F.col("fan_out") + F.col("fan_in")
    return df.withColumn("instability", F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.col("fan_out").cast("double") / total, places)))


def ranked(metrics: DataFrame, top: int | None = None) -> DataFrame:
    df = metrics.orderBy(F.desc(F.col("fan_out") + F.col("fan_in")), F.lower(F.col("v").cast("string")), "v")
    return df if top is None else df.limit(top)


#: Rows up to which one side of a join is sent whole to all tasks.
SENT_ROWS = 200_000


def met(df: DataFrame, n: int) -> DataFrame:
    """A side of a join that has `n` rows at most: few are sent to all tasks, more are dealt out by key.

    Spark would go by the size of files, and files of numbers in order take a hundredth of what their rows take in the driver.
    """
    return df.hint("broadcast" if n <= SENT_ROWS else "merge")


def dealt(edges: DataFrame, by: str) -> DataFrame:
    """Edges dealt out by one of their ends and kept on the executors' disks: rounds that join by it move nodes only."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = edges.repartition(n, by).sortWithinPartitions(by).persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def odd_nodes(edges: DataFrame) -> DataFrame:
    """(v, prior, next) of the nodes with one other node before and one after, and of those with none before or none after."""
    none = F.lit(None).cast(edges.schema["src"].dataType)
    out = edges.select(F.col("src").alias("v"), none.alias("prior"), F.col("dst").alias("next"))
    into = edges.select(F.col("dst").alias("v"), F.col("src").alias("prior"), none.alias("next"))
    df = out.unionByName(into).groupBy("v").agg(F.min("prior").alias("prior"), F.max("prior").alias("p"), F.min("next").alias("next"), F.max("next").alias("n"))
    return df.filter("prior IS NULL OR next IS NULL OR (prior = p AND next = n AND next <> v)").select("v", "prior", "next")


def jumped(steps: DataFrame, n: int) -> DataFrame:
    """(v, to, least): where each v comes to by its steps (v, to) until it meets no other v, and the least v on the way.

    Each round doubles the way, so rounds grow with the logarithm of the longest. On a ring nothing else is met; after
    enough rounds for `n` nodes `least` is the least of the ring.
    """
    state, reach = steps.withColumn("least", F.col("v")), 1
    while reach < n:
        far = met(state.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("least").alias("l")), n)
        new = materialise(state.join(far, "to", "left").select("v", F.coalesce("far", "to").alias("to"), F.least("least", F.coalesce("l", "least")).alias("least"), F.col("far").isNotNull().alias("moved")))
        state, reach = new.select("v", "to", "least"), reach * 2
        if new.filter("moved").isEmpty():
            break
    return state


def contracted(inside: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Between which nodes (v, before, after) the `n` insides of chains lie, and the rings (v, comp) that consist of insides alone.

    A node inside a chain is on a cycle where the chain's two ends are in one component, and in no other case.
    """
    ends = met(inside.select(F.col("v").alias("to")), n)
    ahead = jumped(inside.select("v", F.col("next").alias("to")), n)
    rings = ahead.join(ends, "to", "left_semi").select("v", F.col("least").alias("comp"))
    chains = ahead.join(ends, "to", "left_anti").select("v", F.col("to").alias("after"))
    steps = inside.join(met(chains, n), "v").select("v", F.col("prior").alias("to"))
    back = jumped(steps, n).select("v", F.col("to").alias("before"))
    return materialise(chains.join(met(back, n), "v").select("v", "before", "after")), materialise(rings)


def reduced(edges: DataFrame, chains: list[DataFrame], rings: list[DataFrame]) -> DataFrame:
    """Edges after chains are contracted and nodes that are on no cycle left out, until neither finds any; what was contracted is added to the lists.

    An edge may come twice where a chain lay beside it.
    """
    while True:
        odd = materialise(odd_nodes(edges))
        inside = odd.filter("prior IS NOT NULL AND next IS NOT NULL")
        if not (n := odd.count()):
            return edges
        gone = met(odd.select("v"), n)
        other = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")
        if m := inside.count():
            chain, ring = contracted(inside, m)
            chains.append(chain)
            rings.append(ring)
            short = chain.select(F.col("before").alias("src"), F.col("after").alias("dst")).distinct()
            # the ends of a chain are no insides, but an end may be on no cycle
            other = other.unionByName(short.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
        edges = materialise(other)


def spread_least(labels: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Each of `n` nodes' least label among the nodes that reach it (v, label), by rounds over the edges of nodes whose label has changed."""
    moved, m = labels, n
    while True:
        came = edges.join(met(moved, m), edges["src"] == moved["v"]).groupBy("dst").agg(F.min("label").alias("near"))
        new = labels.join(met(came, n), labels["v"] == came["dst"], "left").select("v", F.least("label", "near").alias("label"), F.coalesce(F.col("near") < F.col("label"), F.lit(False)).alias("moved"))
        new = materialise(new)
        labels, moved = new.select("v", "label"), new.filter("moved").select("v", "label")
        if not (m := moved.count()):
            return labels


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The edges between numbers, (v, id) and how many these are: numbers are in the order of the nodes."""
    ids = materialise(nodes_of(edges).orderBy("v").withColumn("id", F.monotonically_increasing_id()))  # partitions are in order, and so are rows in them
    n = ids.count()
    a, b = met(ids.toDF("src", "s"), n), met(ids.toDF("dst", "d"), n)
    return materialise(edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))), ids, n


#: Nodes up to which all reachable pairs, their square at most, are written out.
CLOSURE_NODES = 1000


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path between them, by doubling: few rounds, for graphs whose size is checked."""
    pairs, n = edges, -1
    while True:
        longer = pairs.toDF("src", "mid").join(pairs.toDF("mid", "dst"), "mid").select("src", "dst")
        pairs = materialise(pairs.unionByName(longer).distinct())
        if (m := pairs.count()) == n:
            return pairs
        n = m


def strong_components(edges: DataFrame, closure_nodes: int = CLOSURE_NODES) -> DataFrame:
    """(v, comp) of all nodes on a cycle: comp is the least node of the strongly connected component.

    Graphs of few nodes (counted first) go by their closure, all others by colours. Chains are contracted first, in rounds
    that grow with the logarithm of their length. Nodes are numbered in their order meanwhile, so that rounds move numbers
    and not names. Forward-backward colouring: least labels spread forward give colours;
    within a colour, what reaches its root backward is the root's component. Found components leave, the rest goes on. No
    closure of pairs is built.
    """
    edges = materialise(edges.select("src", "dst").distinct())
    if nodes_of(edges).limit(closure_nodes + 1).count() <= closure_nodes:
        pairs = closure(edges)
        return pairs.join(pairs.toDF("dst", "src"), ["src", "dst"]).groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("comp"))
    edges, ids, total = numbered(edges.filter("src IS NOT NULL AND dst IS NOT NULL"))
    found, chains, rings = edges.select(F.col("src").alias("v"), F.col("dst").alias("comp")).limit(0), [], []
    while True:
        edges = reduced(edges, chains, rings)
        if edges.isEmpty():
            all_found = expanded(reduce(DataFrame.unionByName, rings, found), chains)
            names = met(ids.toDF("name", "comp"), total)
            return all_found.join(met(ids.toDF("own", "v"), total), "v").join(names, "comp").select(F.col("own").alias("v"), F.col("name").alias("comp"))
        nodes = materialise(nodes_of(edges))
        n = nodes.count()
        ahead, back = (edges, edges) if n <= SENT_ROWS else (dealt(edges, "src"), dealt(edges, "dst"))
        colour = spread_least(nodes.select("v", F.col("v").alias("label")), ahead, n)
        seen = front = materialise(colour.filter("v = label"))
        while m := front.count():  # backward from the roots, within their colours
            step = back.join(met(front, m), back["dst"] == front["v"]).select(F.col("src").alias("v"), "label").distinct()
            front = materialise(step.join(met(colour, n), ["v", "label"], "left_semi").join(met(seen.select("v"), n), "v", "left_anti"))
            seen = materialise(seen.unionByName(front))
        # a root alone is a component only with a loop
        size = seen.groupBy("label").agg(F.count("*").alias("n"))
        loops = ahead.filter("src = dst").select(F.col("src").alias("label")).distinct().withColumn("loop", F.lit(True))
        keep = seen.join(met(size, n), "label").join(met(loops, n), "label", "left").filter("n > 1 OR loop").select("v", F.col("label").alias("comp"))
        found = materialise(found.unionByName(keep))
        rest = materialise(nodes.join(met(seen.select("v"), n), "v", "left_anti"))
        stay = met(rest, rest.count())
        edges = materialise(ahead.join(stay.toDF("src"), "src", "left_semi").join(stay.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        if n > SENT_ROWS:
            ahead.unpersist()
            back.unpersist()


def expanded(found: DataFrame, chains: list[DataFrame]) -> DataFrame:
    """The components with the insides of the chains, the last contracted first, each named by its least node."""
    n = found.count()
    for chain in reversed(chains):
        a, b = met(found.toDF("before", "c1"), n), met(found.toDF("after", "c2"), n)
        found = materialise(found.unionByName(chain.join(a, "before").join(b, "after").filter("c1 = c2").select("v", F.col("c1").alias("comp"))))
        n = found.count()
    least = found.groupBy("comp").agg(F.min("v").alias("least"))
    return found.join(met(least, n), "comp").select("v", F.col("least").alias("comp"))


def cycles(edges: DataFrame) -> DataFrame:
    """Components with their members in order."""
    return strong_components(edges).groupBy("comp").agg(F.sort_array(F.collect_list("v")).alias("members"))


def dependencies(edges: DataFrame, name: str, transitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """What a model depends on, and what depends on it."""
    def reach(a: str, b: str) -> DataFrame:
        near = edges.filter(F.lower(a) == name.lower()).select(F.col(b).alias("v")).distinct()
        if not transitive:
            return near.orderBy("v")
        seen = front = materialise(near)
        while not front.isEmpty():
            step = edges.join(front, edges[a] == front["v"]).select(F.col(b).alias("v")).distinct()
            front = materialise(step.join(seen, "v", "left_anti"))
            seen = materialise(seen.unionByName(front))
        return seen.orderBy("v")

    return reach("src", "dst"), reach("dst", "src")
