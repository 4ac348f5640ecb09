"""Conversation prefix trie: a burst trie over turns, built by shuffles.

A node is a distinct sequence of first turns. Under the heads of the trie lie containers, each with the suffixes that
begin with one turn below its head. A container that is too large is burst by its suffixes' next turn, which makes its
top a head; the others are sorted, and a sweep over their order gives their nodes.

1. Turns are numbered in their conversations. They are dealt out by ranges of (conversation, order), so a conversation
   of any length is spread over tasks; what a part lacks from those before it is known from the conversations that
   lie on a border, at most one a border. The same pass chains the ids of turns into the key of each prefix.
2. Equal sequences are one, with the number of their conversations. The digest of these reads them in order, as pieces
   that the sorted parts have joined before.
3. Bursts. A prefix that two sequences or more share, with more than `CONTAINER` turns beyond it, is a head. As a
   prefix has a key at every depth, one count finds the heads of all levels, however deep a shared beginning reaches.
4. Sweep. What is left of the sequences lies in containers of at most CONTAINER turns, many to a shard. Each is sorted;
   neighbours' common prefixes open and close nodes. A container of one sequence is a path and needs no task of its own.
5. Heads add up the containers below them. A head's subtree has the bytes of all turns on its paths, less those that
   the distinct heads have once; each head counts for the least conversation that passes it, which is why a sum over the
   paths' ends suffices, and no head is met with every other one above it.

Defined results: rows of null conversations belong to none. Null roles and texts are empty; turns of one number (null
first) are ordered by role and text, and repeated rows are turns of their own. Empty tables give no nodes. Other columns
are not read. Conversation ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, partitions

#: Turns of a container at most, turns that a shard comes from, characters of ids that are joined in a piece.
CONTAINER, SHARD, PIECE = 512, 20_000, 1_000_000
#: Prefix keys are polynomials of turn ids modulo a prime; the key of the empty prefix is 1.
PRIME, BASE = (1 << 127) - 1, 0x5BD1E9955BD1E9955BD1E9955BD1E995
ROOT = (1).to_bytes(16)
NO_ENDS = hashlib.sha256().hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]


# ---------------------------------------------------------------- places and prefix keys


def in_order(rows: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """(conv, place, tid, bytes, chain, cum): places from 0, prefix keys and bytes up to each turn, of rows (conv, order, tid, bytes)."""
    parts = parts or partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, "conv", order, "tid").sortWithinPartitions("conv", order, "tid").select("conv", "tid", "bytes")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, k, chain, cum = TaskContext.get().partitionId(), None, 0, 1, 0
        for b in batches:
            places, chains, cums = [], [], []
            for c, tid, n in zip(b["conv"].tolist(), b["tid"], b["bytes"].tolist(), strict=True):
                if c != last:
                    last, k, chain, cum = c, 0, 1, 0
                chain, cum = (chain * BASE + int.from_bytes(tid)) % PRIME, cum + n
                places.append(k)
                chains.append(chain.to_bytes(16))
                cums.append(cum)
                k += 1
            yield b.assign(part=part, place=places, chain=chains, cum=cums)

    runs = materialise(dealt.mapInPandas(number, "conv bigint, tid binary, bytes bigint, part int, place bigint, chain binary, cum bigint"))
    # at most one conversation lies on each of the parts - 1 borders
    split = [r["conv"] for r in runs.groupBy("conv").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("conv").collect()]
    if not split:
        return runs.drop("part")
    ends = runs.filter(F.col("conv").isin(split)).groupBy("conv", "part").agg(F.max("place").alias("place"), F.max_by("chain", "place").alias("chain"), F.max("cum").alias("cum"))
    before: dict[tuple[int, int], tuple[int, int, int]] = {}
    last, place, chain, cum = None, 0, 1, 0
    for r in sorted(ends.collect(), key=lambda r: (r["conv"], r["part"])):
        if r["conv"] != last:
            last, place, chain, cum = r["conv"], 0, 1, 0
        before[r["conv"], r["part"]] = place, chain, cum
        n = r["place"] + 1
        place, chain, cum = place + n, (int.from_bytes(r["chain"]) + (chain - 1) * pow(BASE, n, PRIME)) % PRIME, cum + r["cum"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [before.get(x, (0, 1, 0)) for x in zip(b["conv"].tolist(), b["part"].tolist(), strict=True)]
            chains = [c if first == 1 else ((int.from_bytes(c) + (first - 1) * pow(BASE, k + 1, PRIME)) % PRIME).to_bytes(16) for c, k, (_, first, _) in zip(b["chain"], b["place"].tolist(), known, strict=True)]
            yield b.assign(place=b["place"] + np.array([x[0] for x in known], dtype=np.int64), chain=chains, cum=b["cum"] + np.array([x[2] for x in known], dtype=np.int64))

    return runs.mapInPandas(joined, runs.schema).drop("part")


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role_text order, tid, bytes): a 128-bit id of each turn's role and text, and the text's bytes."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role, text = named(role_col), named(text_col)
    tid = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"), tid.alias("tid"), F.octet_length(text).cast("bigint").alias("bytes"))
    return rows.filter("conv IS NOT NULL")


def numbered(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv, place, tid, bytes) of all turns, ordered by turn (null first), role and text."""
    rows = turn_rows(conversations, **columns)
    tied = rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).filter("n > 1").select("conv", "turn")
    # role and text order only turns of one number, so only theirs move on
    key = rows.join(tied.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied")), (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    key = key.select("conv", F.struct("turn", F.when(F.col("tied"), F.struct("role", "text")).alias("tie")).alias("at"), "tid", "bytes")
    return in_order(materialise(key), "at").select("conv", "place", "tid", "bytes")


# ---------------------------------------------------------------- sequences


def end_digests(ends: DataFrame) -> DataFrame:
    """seq, the least conversation of it (`conv`), their number and the digest of their ids, of rows (seq, conv)."""
    n = partitions(ends.sparkSession)
    dealt = ends.repartitionByRange(n, "seq", "conv").sortWithinPartitions("seq", "conv").select("seq", "conv")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, ids, size = None, [], 0
        for b in batches:
            out = []
            for s, c in zip(b["seq"], b["conv"].tolist(), strict=True):
                if ids and (s != seq or size > PIECE):
                    out.append((bytes(seq), ids[0], len(ids), ",".join(map(str, ids))))
                    ids, size = [], 0
                seq = s
                ids.append(c)
                size += len(str(c)) + 1
            yield pd.DataFrame(out, columns=["seq", "conv", "n", "ids"])
        if ids:
            yield pd.DataFrame([(bytes(seq), ids[0], len(ids), ",".join(map(str, ids)))], columns=["seq", "conv", "n", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, first, n, digest = None, 0, 0, hashlib.sha256()
        for b in batches:
            out = []
            for s, c, k, ids in zip(b["seq"], b["conv"].tolist(), b["n"].tolist(), b["ids"], strict=True):
                if s != seq:
                    if seq is not None:
                        out.append((bytes(seq), first, n, digest.hexdigest()))
                    seq, first, n, digest = s, c, 0, hashlib.sha256()
                digest.update(f"{',' if n else ''}{ids}".encode())
                n += k
            yield pd.DataFrame(out, columns=["seq", "conv", "n", "ends"])
        if seq is not None:
            yield pd.DataFrame([(bytes(seq), first, n, digest.hexdigest())], columns=["seq", "conv", "n", "ends"])

    joined = dealt.mapInPandas(pieces, "seq binary, conv bigint, n bigint, ids string").repartition("seq").sortWithinPartitions("seq", "conv")
    return joined.mapInPandas(digests, "seq binary, conv bigint, n bigint, ends string")


# ---------------------------------------------------------------- containers


def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all containers in these rows: container, conv, depth, tid, bytes, n, head_depth, parent_conv, ends."""
    pdf = pdf.sort_values(["container", "conv", "depth"], ignore_index=True)
    new = np.flatnonzero(np.r_[True, (pdf["conv"].to_numpy()[1:] != pdf["conv"].to_numpy()[:-1]) | (pdf["container"].to_numpy()[1:] != pdf["container"].to_numpy()[:-1])])
    tid, size, ends = pdf["tid"].tolist(), pdf["bytes"].tolist(), pdf["ends"].tolist()
    heads = pdf.loc[new, ["container", "conv", "n", "head_depth", "parent_conv"]]
    suffixes = [(c, tid[lo:hi], size[lo:hi], conv, n, depth, parent, ends[hi - 1]) for lo, hi, (c, conv, n, depth, parent) in zip(new.tolist(), [*new.tolist()[1:], len(pdf)], heads.itertuples(index=False), strict=True)]
    suffixes.sort(key=lambda s: s[:2])
    nodes: list[list] = []
    open_nodes: list[list] = []  # conv, n, children, leaves, saved, ends, bytes, rows of the children

    def close(depth: int, parent: int) -> None:
        conv, n, children, leaves, saved, ended, own, below = open_nodes.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * own
        for k in below:
            nodes[k][2] = conv
        nodes.append([conv, depth, parent, n, children, leaves, saved, ended or NO_ENDS, not open_nodes])
        if open_nodes:
            up = open_nodes[-1]
            up[0], up[1], up[2], up[3], up[4] = min(up[0], conv), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved
            up[7].append(len(nodes) - 1)

    before, prior, depth, parent = None, [], 0, 0
    for container, ids, sizes, conv, n, head_depth, parent_conv, ended in suffixes:
        same = 0
        if container == before:
            while same < len(ids) and same < len(prior) and ids[same] == prior[same]:
                same += 1
        while len(open_nodes) > same:
            close(depth + len(open_nodes), parent)
        before, prior, depth, parent = container, ids, head_depth, parent_conv
        for k in range(same, len(ids)):
            open_nodes.append([conv, 0, 0, 0, 0, None, sizes[k], []])
        open_nodes[-1][1], open_nodes[-1][5] = n, ended
    while open_nodes:
        close(depth + len(open_nodes), parent)
    return pd.DataFrame(nodes, columns=[*COLUMNS, "top"])


def sequences_of(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences (seq, conv, n, ends, len, total) and their turns (conv, depth, chain, tid, bytes, cum), each with its least conversation.

    rows: what `in_order` gives; convs: all conversations (conv), those without turns too.
    """
    last = rows.groupBy("conv").agg(F.max_by("chain", "place").alias("seq"), F.max("place").alias("place"), F.max("cum").alias("total"))
    last = convs.join(last, "conv", "left").select("conv", F.coalesce("seq", F.lit(ROOT)).alias("seq"), (F.coalesce("place", F.lit(-1)) + 1).alias("len"), F.coalesce("total", F.lit(0)).alias("total"))
    last = materialise(last)
    seqs = materialise(end_digests(last).join(last.drop("seq"), "conv"))
    turns = materialise(rows.join(seqs.select("conv", "len"), "conv").select("conv", (F.col("place") + 1).alias("depth"), "len", "chain", "tid", "bytes", "cum"))
    return seqs, turns


def prefix_trie(rows: DataFrame, convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie (NODES) of these conversations: see `sequences_of` for the rows that it takes."""
    seqs, turns = sequences_of(rows, convs)
    # bursts: prefixes of several sequences with too many turns beyond them
    heads = turns.groupBy("chain").agg(F.count("*").alias("seqs"), F.sum(F.col("len") - F.col("depth")).alias("beyond"), F.min("conv").alias("head_conv"))
    heads = materialise(heads.filter((F.col("seqs") > 1) & (F.col("beyond") + F.col("seqs") > container)).select("chain", "head_conv"))
    passed = materialise(turns.join(heads, "chain").select("conv", "depth", "chain", "bytes", "cum", "head_conv"))
    deepest = passed.groupBy("conv").agg(F.max("depth").alias("head_depth"), F.max_by("head_conv", "depth").alias("parent_conv"), F.max_by("chain", "depth").alias("head"), F.max("cum").alias("head_cum"))
    least = seqs.agg(F.min("conv").alias("c")).first()["c"]
    if least is None:
        return rows.sparkSession.createDataFrame([], NODES)
    filled = {"head_depth": 0, "parent_conv": least, "head_cum": 0}
    placed = seqs.join(deepest, "conv", "left").fillna(filled).withColumn("head", F.coalesce("head", F.lit(ROOT)))
    # what lies below the heads, by container
    below = turns.drop("len").join(placed.drop("seq"), "conv").filter("depth > head_depth")
    tops = below.filter("depth = head_depth + 1").select("conv", F.col("chain").alias("container"))
    several = tops.groupBy("container").agg((F.count("*") > 1).alias("shared"))
    dealt = tops.join(several, "container")
    below = materialise(below.join(dealt, "conv").withColumn("ends", F.when(F.col("depth") == F.col("len"), F.col("ends"))))
    shards = max(partitions(rows.sparkSession), turns.count() // SHARD + 1)
    shared = below.filter("shared").select(F.pmod(F.xxhash64("container"), F.lit(shards)).alias("shard"), "container", "conv", "depth", "tid", "bytes", "n", "head_depth", "parent_conv", "ends")
    swept = materialise(shared.groupBy("shard").applyInPandas(sweep, f"{NODES}, top boolean"))
    is_top = F.col("depth") == F.col("head_depth") + 1
    paths = below.filter("NOT shared").select(
        F.col("conv").alias("conv_id"), "depth", F.when(is_top, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("cum") + F.col("bytes"))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), is_top.alias("top"),
    )
    found = swept.unionByName(paths)
    # units below the heads: containers, and sequences that end at a head
    units = found.filter("top").select(F.col("conv_id").alias("conv"), F.col("n_convs").alias("n"), "n_leaves", F.col("saved_tokens").alias("saved"))
    units = units.unionByName(placed.filter("len = head_depth").select("conv", "n", F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved")))
    units = materialise(units.join(placed.select("conv", "head", "head_depth", "head_cum", "len"), "conv"))
    return found.drop("top").unionByName(head_nodes(units, passed, placed, least))


def head_nodes(units: DataFrame, passed: DataFrame, placed: DataFrame, least: int) -> DataFrame:
    """The nodes of the heads and of the root, from the units below them and the heads that each sequence passes."""
    heads = materialise(passed.filter("conv = head_conv"))  # each head once, on the path of its least conversation
    up = passed.select("conv", (F.col("depth") + 1).alias("depth"), F.col("chain").alias("up"), F.col("head_conv").alias("up_conv"))
    heads = heads.join(up, ["conv", "depth"], "left").withColumn("up", F.coalesce("up", F.lit(ROOT))).withColumn("up_conv", F.coalesce("up_conv", F.lit(least)))
    containers = units.filter("len > head_depth").select(F.col("head").alias("chain"))
    children = containers.unionByName(heads.select(F.col("up").alias("chain"))).groupBy("chain").agg(F.count("*").alias("n_children"))
    ends = placed.filter("len = head_depth").select(F.col("seq").alias("chain"), "ends")
    own = heads.groupBy("conv").agg(F.sum("bytes").alias("own"))
    on_path = passed.join(units.join(own, "conv", "left").fillna({"own": 0}), "conv")
    before = F.col("cum") - F.col("bytes")
    first = F.min_by(F.col("head_cum") - before - F.col("own"), "conv")  # the least unit's heads from here on, in place of all that it owns
    sums = on_path.groupBy("chain").agg(
        F.sum("n").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        (F.sum(F.col("saved") + F.col("n") * (F.col("head_cum") - before) - F.col("own")) - first).alias("saved_tokens"),
    )
    made = heads.select("chain", F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "bytes").join(sums, "chain")
    made = materialise(made)
    root = units.agg(F.sum("n").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    inner = made.agg(F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("bytes")), F.lit(0)).alias("inner"))
    of_root = {**root.first().asDict(), **inner.first().asDict()}
    alone = F.lit(None).cast("bigint")
    top = units.sparkSession.createDataFrame([(ROOT, least, 0, of_root["n_convs"], of_root["n_leaves"] or 1, of_root["saved"] + of_root["inner"])], "chain binary, conv_id bigint, depth bigint, n_convs bigint, n_leaves bigint, saved_tokens bigint")
    both = made.drop("bytes").unionByName(top.withColumn("parent_conv_id", alone))
    both = both.join(children, "chain", "left").join(ends, "chain", "left").fillna({"n_children": 0, "ends": NO_ENDS})
    return both.withColumnRenamed("ends", "ends_sha256").select(*COLUMNS)


# ---------------------------------------------------------------- rebuilt conversations


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns in order, conversations): each conversation begins with the first turns of its group's first one.

    own: what `numbered` gives. Conversation c takes the first h = crc32(c) mod `most` turns of c - c mod `group`, and
    then its own after its first h.
    """
    convs = materialise(own.select("conv").distinct())
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    first = own.filter((F.col("conv") % group == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "donor")
    given = convs.select("conv", (F.col("conv") - F.col("conv") % group).alias("donor"), head.alias("h")).join(first, "donor").filter("place < h")
    kept = own.filter(F.col("place") >= head)
    return in_order(given.select("conv", "place", "tid", "bytes").unionByName(kept.select("conv", "place", "tid", "bytes")), "place"), convs


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(numbered(conversations, **columns)))
