"""Near-duplicate classes: ProbMinHash signatures of weighted shingles, banding and exact verification.

A shingle is five consecutive words, weighted by how often a text has it. Each shingle is a Poisson process whose rate
is its weight; each arrival goes to a random register, which keeps its first. A shingle's arrivals stop as soon as they
are later than the last register's, so most shingles of a long text take one step. Two texts agree in a register with
the probability Jaccard similarity of their shingles. `BANDS` groups of `ROWS` registers make candidates.

Equal texts are one from the start: signatures, bands and checks run over distinct texts. In a band's bucket the first
text leads. Each text is compared first with the least leader of its buckets, with their whole shingles. Verified links
join texts into classes by least labels with pointer jumps. A bucket that is then of one class is done, which is what
becomes of large groups of copies: a comparison a text, and no pair of them is emitted. In the other buckets the first
text meets the texts of other classes. In what is left a pair of different classes goes on unless an upper bound of its
similarity, from the weight of the shingles in `BINS` bins, shows that it is not near: first the pairs of a maximum
spanning forest of a bucket's classes, of which there are fewer than texts and which join nearly all that belongs
together, and then every pair whose classes are still different. Buckets of more than `CHUNK` texts are dealt out by pairs of chunks.
After each step only the classes that a new link joins are labelled again.

Defined results: a null text is empty. A text of fewer than five words is one shingle; a text without words has none
and is near to equal texts only. The class id is the least id in the class (null ids come last). Repeated rows each
keep a row in `near_duplicate_classes` and one row in `keep_first`. Ids that aren't integers are compared in their own order. Empty tables give empty results. Other columns are
kept by `keep_first` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import NOT_BLANK, ODD, checkpoint, free_names, groups_of, id_ranks, materialise, mix64, partitions, short_batches, with_number, word_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Bins of a text's shingles; what rounding may take from a bound; pairs bounded together; texts of a bucket in one task.
BINS, ROUNDING, PAIRS, CHUNK = 1024, 1e-4, 256, 2048
#: Bins of the first, cheap bound.
COARSE = 128
#: Bytes of text whose shingles are made together.
BLOCK = 1_000_000
LAST_ID = (1 << 63) - 1


# ---------------------------------------------------------------- shingles and signatures


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text, sorted by text and hash."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc, word = word_hashes(texts, NOT_BLANK)
    if not len(word):
        return none
    left = np.searchsorted(doc, doc, side="right") - np.arange(len(doc))  # words from here to the text's end
    n_words = np.bincount(doc, minlength=len(texts))[doc]
    own = (left >= size) | ((n_words < size) & (left == n_words))  # a short text is one shingle
    start, length = np.flatnonzero(own), np.minimum(n_words, size)[own]
    h = np.zeros(len(start), dtype=np.uint64)
    for j in range(size):
        more = length > j
        h[more] = h[more] * ODD + word[start[more] + j] + np.uint64(1)
    h, doc = mix64(h), doc[start]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Registers (n, m): the element whose arrival is first in each, and whether the text has any element."""
    time, chosen = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    now, step = np.zeros(len(doc)), np.zeros(len(doc), dtype=np.int64)
    live = np.arange(len(doc))
    while len(live):
        d = doc[live]
        many = np.maximum(1, m // np.bincount(d, minlength=n)[d])  # texts with few elements take several arrivals at once
        each = np.repeat(live, many)
        start = np.cumsum(many) - many
        k = np.arange(len(each)) - np.repeat(start, many) + step[each]
        r = mix64(element[each] + ODD * (k.astype(np.uint64) + np.uint64(1)))
        gap = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) / (1 << 53)) / weight[each]
        total = np.cumsum(gap)
        at = now[each] + total - np.repeat(total[start] - gap[start], many)
        cell = doc[each] * m + (mix64(r) % np.uint64(m)).astype(np.int64)
        near = at < time[cell]
        np.minimum.at(time, cell[near], at[near])
        won = near & (at == time[cell])
        chosen[cell[won]] = element[each[won]]
        step[live] += many
        now[live] = at[start + many - 1]
        latest = time.reshape(n, m).max(1)
        live = live[now[live] < latest[doc[live]]]
    return chosen.reshape(n, m), np.bincount(doc, minlength=n) > 0


def band_hashes(registers: np.ndarray) -> np.ndarray:
    n = len(registers)
    h = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
    for j in range(ROWS):
        h = mix64(h * ODD + registers.reshape(n, BANDS, ROWS)[:, :, j])
    return h.view(np.int64)


def binned(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> list[bytes]:
    """The weight of each text's shingles in each bin, in the least width that holds them."""
    sums = np.bincount(doc * BINS + (element % np.uint64(BINS)).astype(np.int64), weights=weight, minlength=n * BINS).reshape(n, BINS)
    return [x.astype(np.min_scalar_type(int(x.max())).newbyteorder("<")).tobytes() for x in sums]


def shares(bins: bytes) -> np.ndarray:
    x = np.frombuffer(bins, f"<u{len(bins) // BINS}").astype(np.float64)
    return (x / max(x.sum(), 1)).astype(np.float32)


def most_similar(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bound of the similarity of a text with each row of `q`, from the shares of their bins.

    Joining elements never lowers probability Jaccard: an element's term is at most g(p_i, q_i) with g(x, y) = 1 / sum of
    max(P / x, Q / y) over the bins, and g is concave and of degree 1, so the terms of a bin sum to at most g of its sums.
    A bin's term is at most the lesser share, and at most the larger one over the sum of max(P, Q).
    """
    out = np.empty(len(q))
    for lo in range(0, len(q), PAIRS):
        low, high = np.minimum(q[lo : lo + PAIRS], p), np.maximum(q[lo : lo + PAIRS], p)
        high /= high.sum(1, keepdims=True)
        out[lo : lo + PAIRS] = np.minimum(low, high).sum(1)
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two sorted (hash, weight) sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    if not both.any():
        return 0.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    only_x, cx, cy = x[~both].sum(), x[both], y[at[both]]
    only_y = y.sum() - cy.sum()
    ratio = cx / cy
    order = np.argsort(ratio, kind="stable")
    below = np.searchsorted(ratio[order], ratio, side="left")
    sum_x, sum_y = np.r_[0.0, np.cumsum(cx[order])], np.r_[0.0, np.cumsum(cy[order])]
    larger_x, larger_y = sum_x[-1] - sum_x[below] + only_x, sum_y[below] + only_y
    return float((1.0 / (larger_x / cx + larger_y / cy)).sum())


# ---------------------------------------------------------------- distinct texts


def _text(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")


def _keyed(docs: DataFrame, id_col: str, text_col: str, ranks: DataFrame | None = None) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("own_id"), _text(text_col).alias("text"))
    return with_number(rows, "own_id", ranks, "id", LAST_ID).select("own_id", "id", F.unhex(F.md5("text")).alias("key"), "text")


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """One row per text: a number, its content key, the least id, band hashes and bins; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(key=b["key"].map(bytes)).sort_values("id").drop_duplicates("key", ignore_index=True)
            texts = [bytes(t) for t in b["text"]]
            bands, bins = [], []
            for lo, hi in groups_of([len(t) for t in texts], BLOCK):
                made = shingles(texts[lo:hi])
                registers, some = signatures(*made, hi - lo)
                bands += [h.tolist() if s else [] for h, s in zip(band_hashes(registers), some, strict=True)]
                bins += binned(*made, hi - lo)
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "bands": bands, "bins": bins})

    made = keyed.drop("own_id").mapInPandas(run, "key binary, id bigint, bands array<bigint>, bins binary")
    return materialise(made.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bins").alias("bins")).withColumn("rid", F.monotonically_increasing_id()))


# ---------------------------------------------------------------- candidates, round by round


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similarity of each pair (a, b) of texts of the classes ra and rb, from their whole texts."""
    full = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            lead, which = np.unique(p["a"].to_numpy(), return_index=True)
            of = {a: bytes(p["text_a"].iloc[i]) for a, i in zip(lead, which, strict=True)}
            made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            out = []
            for a, t in zip(p["a"], p["text_b"], strict=True):
                if a not in made:
                    made = {a: shingles([of[a]])[1:]}  # pairs of one leader mostly come together
                out.append(probability_jaccard(made[a], shingles([bytes(t)])[1:]))
            yield p[["a", "b", "ra", "rb"]].assign(similarity=out)

    return full.select("a", "b", "ra", "rb", "text_a", "text_b").mapInPandas(run, "a bigint, b bigint, ra bigint, rb bigint, similarity double")


def find_classes(texts: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rid and root (the least rid of its class) of all texts that share a bucket, and the pairs that were verified."""
    rows = texts.select("rid", F.explode("bands").alias("bucket"))
    led = rows.groupBy("bucket").agg(F.min("rid").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    members = materialise(rows.join(led, "bucket").select("bucket", "rid", "lead"))
    needed = members.groupBy("rid").agg(F.min("lead").alias("lead")).join(texts.select("rid", "id", "key"), "rid")
    held = materialise(keyed.drop("own_id").join(needed, ["id", "key"]).dropDuplicates(["rid"]).select("rid", "lead", "text"))
    pairs = held.filter("rid > lead").select(F.col("lead").alias("a"), F.col("rid").alias("b"), F.col("lead").alias("ra"), F.col("rid").alias("rb"))
    met = checkpoint(verified(pairs, held))
    labels = relabelled(held.select("rid", F.col("rid").alias("root")), met)
    mixed = _mixed(members, labels)
    lead = mixed.groupBy("bucket").agg(F.min(F.struct("rid", "root")).alias("l")).select("bucket", F.col("l.rid").alias("lead"), F.col("l.root").alias("lead_root"))
    led = mixed.join(lead, "bucket").filter("root <> lead_root")
    led = led.select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b"), F.least("root", "lead_root").alias("ra"), F.greatest("root", "lead_root").alias("rb"))
    more = checkpoint(verified(led.distinct().join(met, ["a", "b"], "left_anti"), held))
    met, labels = met.unionByName(more), relabelled(labels, more)
    for pick in (forest_pairs, hopeful_pairs):
        mixed = _mixed(members, labels)
        if mixed.isEmpty():
            break
        across = picked(mixed, texts, pick)
        more = checkpoint(verified(across.join(met, ["a", "b"], "left_anti"), held))
        met, labels = met.unionByName(more), relabelled(labels, more)
    return labels, met


def find_links(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct texts, which join the same texts as all links do."""
    return find_classes(texts, keyed)[1].filter(F.col("similarity") >= SIMILAR).select("a", "b")


def relabelled(labels: DataFrame, met: DataFrame) -> DataFrame:
    """The labels (rid, root) after the pairs that are similar have joined their classes ra and rb."""
    links = met.filter(F.col("similarity") >= SIMILAR).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    if links.isEmpty():
        return labels
    moved = components(links).select(F.col("rid").alias("root"), F.col("root").alias("joined"))
    return checkpoint(labels.join(moved, "root", "left").select("rid", F.coalesce("joined", "root").alias("root")))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rid, root) of the buckets whose texts are of several classes by these labels."""
    classed = members.select("bucket", "rid").join(labels, "rid")
    several = classed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    return checkpoint(classed.join(several, "bucket", "left_semi").select("bucket", "rid", "root"))


def _dealt(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of each bucket with their bins, once for each pair (i, j) of its chunks; small buckets come together.

    `part` is the group's key besides i and j: a bucket of several chunks, or a hash that many small buckets share.
    """
    chunks = F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")
    rows = mixed.join(mixed.groupBy("bucket").agg(chunks), "bucket").join(texts.select("rid", "bins", "bands"), "rid")
    own = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = max(partitions(mixed.sparkSession), mixed.count() // CHUNK)
    part = F.when(F.col("chunks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(parts)))
    return rows.select(part.alias("part"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bucket", "own", "rid", "root", "bins", "bands")


def picked(mixed: DataFrame, texts: DataFrame, pick) -> DataFrame:
    """Pairs (a, b) with their classes that `pick` chooses in each bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "rid"], ignore_index=True)
        bands, share = np.stack([np.asarray(b, dtype=np.int64) for b in pdf["bands"]]), np.stack([shares(b) for b in pdf["bins"]])
        rid, root, own, bucket = (pdf[c].to_numpy() for c in ("rid", "root", "own", "bucket"))
        within, edges = pdf["i"].iloc[0] == pdf["j"].iloc[0], [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(pdf)]
        out = [np.empty((0, 4), dtype=np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            x, y, most = hopeful(rid[lo:hi], root[lo:hi], own[lo:hi], bands[lo:hi], share[lo:hi], bucket[lo], within)
            r, c = rid[lo:hi], root[lo:hi]
            pairs = np.stack([np.minimum(r[x], r[y]), np.maximum(r[x], r[y]), np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], axis=1)
            out.append(pick(pairs, most))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "ra", "rb"])

    return _dealt(mixed, texts).groupBy("part", "i", "j").applyInPandas(run, "a bigint, b bigint, ra bigint, rb bigint")


def hopeful(rid: np.ndarray, root: np.ndarray, own: np.ndarray, bands: np.ndarray, share: np.ndarray, bucket: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, bound) of a bucket's pairs of different classes, one of each chunk, that the bound doesn't exclude.

    A pair that meets in several buckets is given by that of their first common band.
    """
    coarse = share.reshape(len(share), COARSE, -1).sum(2)
    names, count = np.unique(root, return_counts=True)
    major = names[count.argmax()]
    one, two, most = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    for x in np.flatnonzero(root != major):  # pairs within the largest class need no look
        others = (root != root[x]) & ((root == major) | (rid > rid[x])) & (within | (own != own[x]))
        at = np.flatnonzero(others)
        at = at[bands[x][(bands[at] == bands[x]).argmax(1)] == bucket]
        at = at[most_similar(coarse[x], coarse[at]) >= SIMILAR - ROUNDING]  # fewer bins bound too, and mostly suffice
        bound = most_similar(share[x], share[at])
        able = bound >= SIMILAR - ROUNDING
        one.append(np.full(int(able.sum()), x))
        two.append(at[able])
        most.append(bound[able])
    return np.concatenate(one), np.concatenate(two), np.concatenate(most)


def hopeful_pairs(pairs: np.ndarray, most: np.ndarray) -> np.ndarray:
    """All of a bucket's hopeful pairs."""
    return pairs


def forest_pairs(pairs: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of a bucket's hopeful pairs, those of a maximum spanning forest of the classes: largest bound first."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0], -most))
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = r = parent.get(up, up)
        return r

    chosen = []
    for k, ra, rb in zip(order.tolist(), pairs[order, 2].tolist(), pairs[order, 3].tolist(), strict=True):
        ra, rb = top(ra), top(rb)
        if ra != rb:
            parent[rb] = ra
            chosen.append(k)
    return pairs[chosen]


# ---------------------------------------------------------------- classes


def components(links: DataFrame) -> DataFrame:
    """rid and root: the least rid it is linked to, over any number of links."""
    both = checkpoint(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "rid"))
    while True:
        near = both.join(labels.select(F.col("rid").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "rid"), "rid").select("rid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("rid").alias("root"), F.col("root").alias("far"))
        new = checkpoint(step.join(jump, "root").select("rid", "old", F.least("root", "far").alias("root")))
        labels = new.select("rid", "root")
        if new.filter("root <> old").isEmpty():
            return labels


def classes(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: key, the least id that has it (`id`), and its class's least id and that id's key."""
    short_batches(keyed.sparkSession)
    texts = distinct_texts(keyed)
    roots, _ = find_classes(texts, keyed)
    known = texts.select("rid", "key", "id").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    first = known.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    return known.join(first, "root").select("key", "id", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's class id, the least id of equal texts, and whether the row is the one that stands for its class."""
    ranks = id_ranks(docs, id_col)
    keyed = _keyed(docs, id_col, text_col, ranks)
    found = classes(keyed).withColumnRenamed("id", "text_id")
    rows = keyed.select("own_id", "id", "key").join(found, "key")
    rows = rows.withColumn("is_first", (F.col("id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))
    shown = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    if ranks is not None:
        for c in ("class_id", "text_id"):
            rows = rows.join(ranks.select(F.col("_rank").alias(c), F.col("_id").alias(f"{c}_own")), c, "left").drop(c).withColumnRenamed(f"{c}_own", c)
        shown = F.col
    return rows.select(F.col("own_id").alias(id_col), shown("class_id").alias("class_id"), shown("text_id").alias("text_id"), "is_first")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one of least id, with all its columns."""
    ranks = id_ranks(docs, id_col)
    found = classes(_keyed(docs, id_col, text_col, ranks))
    number, key = free_names(docs, "_stay_id", "_stay_key")
    stay = found.filter((F.col("id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))).select(F.col("id").alias(number), F.col("key").alias(key))
    # the key of both steps is one row's, so no text's copies meet in one task
    rows = with_number(docs, id_col, ranks, number, LAST_ID).withColumn(key, F.unhex(F.md5(_text(text_col))))
    return rows.join(stay, [number, key], "left_semi").dropDuplicates([number, key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity): verified links between different texts, by the least ids that have them; they join the same texts as all links do.

    Not every pair of a class is among them: a text is compared with its bucket's leader first, and texts of one class
    are not compared again. With `near_duplicate_classes`, which says what texts are equal, they show why texts are joined.
    """
    short_batches(docs.sparkSession)
    ranks = id_ranks(docs, id_col)
    keyed = _keyed(docs, id_col, text_col, ranks)
    texts = distinct_texts(keyed)
    _, met = find_classes(texts, keyed)
    ids = texts.select("rid", F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"))
    if ranks is not None:
        ids = ids.join(ranks, F.col("id") == F.col("_rank"), "left").select("rid", F.col("_id").alias("id"))
    links = met.filter(F.col("similarity") >= SIMILAR).join(ids.toDF("a", "id_a"), "a").join(ids.toDF("b", "id_b"), "b")
    return links.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
