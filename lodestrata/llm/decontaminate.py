"""Benchmark decontamination: rare n-gram seeds join passages with items, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters and digits. A seed is a few words that follow each other with at most one word put
in, left out or changed among them: three words of items of eight words or more, two of shorter ones, one of items of one
word. So a seed does not need a run that an edited copy may lack: where an alignment reaches half of an item's score,
either such words lie in it, or nearly every word has another put in behind it, which a wider pattern on the texts' side
meets. Both sides are hashed, whatever the gaps, and joined on the hash.

1. The n-grams of all items are a table. One pass over the corpus counts them.
2. Seeds are chosen by these counts. N-grams that the corpus lacks find nothing. One that would bring more than SHARE hits
   a word of the corpus is heavy, and left to the rarer ones of its stretch of the item, of which at least RARE stay.
3. A second pass gives the places of seeds, which are joined with the items. Hits of a text and an item fall into slots as
   long as the item; what a slot needs is its least and largest start, so a text with very many hits needs few rows.
4. Only the texts so found are sent on, once each, to their slots. The passage around each slot is cut out and aligned, if
   it shares enough words with the item to reach the threshold at all; the task that holds the text judges this first.

The corpus is read a fixed number of times, whatever the number of items. What tasks get beforehand is fields of bits, of
at most 2^MAX_BITS each, that tell n-grams and words which may be an item's; the joins are exact. Texts and items are known by their MD5, so copies
of a text are judged once.
The score is the best local alignment's, as a share of what the whole item would get: 1 is a copy, and each changed
word costs a little.

Defined results: null texts have no words. Items without words are ignored; of items with one id each counts, and the best
score is reported. Items of one and two words need SHORT_SCORE, and all that it admits are found. Repeated documents each
have their rows. Empty tables give empty results. Other columns are kept by `drop_contaminated` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import ALNUM, ODD, free_names, groups_of, materialise, mix64, short_batches, word_hashes

#: By kind of seed: words of an item up to which it has this kind, places of a seed's words in items, and in texts.
KINDS = (
    (1, ((0,),), ((0,),)),
    (7, ((0, 1), (0, 2)), ((0, 1), (0, 2))),
    (None, ((0, 1, 2), (0, 1, 3), (0, 2, 3)), ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))),
)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score that counts as contaminated.
THRESHOLD = 0.5
#: Words up to which an item is short, and the least score of such items where the threshold is lower: one gap in two words.
SHORT, SHORT_SCORE = 2, 0.75
#: Words of a stretch of an item, its rarest n-grams that are always seeds, and hits a word of the corpus that make one heavy.
STRETCH, RARE, SHARE = 6, 6, 1e-3
#: Characters of a text block, words of passages aligned together, and of passages judged together.
BLOCK, WORDS, JUDGED = 1_000_000, 32_768, 1 << 17
#: Slots of the table that tells which pairs of a batch may match, as a power of two.
TABLE_BITS = 20
#: Bits an n-gram in the field that tasks get, the most that it has (as a power of two), and those of a part that a task sets.
BITS, MAX_BITS, PART_BITS = 64, 29, 19


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts], ALNUM)


def grams(doc: np.ndarray, word: np.ndarray, places: tuple[int, ...], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the words at these places from each word on, where they stay in one text and all are `known`."""
    n = len(word) - places[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    same = doc[:n] == doc[places[-1] :]
    for j in places if known is not None else ():
        same &= known[j : j + n]
    at = np.flatnonzero(same)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in places:
        h = h * ODD + word[at + j]
    return at, mix64(h)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment score of each (item words, passage words), as a share of the item's own."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    for lo, hi in groups_of([len(pairs[i][1]) for i in order], WORDS):
        pick = order[lo:hi]
        m, n = max(len(pairs[i][0]) for i in pick), max(len(pairs[i][1]) for i in pick)
        x, y = np.zeros((len(pick), m), np.uint64), np.zeros((len(pick), n), np.uint64)  # no word has hash 0 in practice
        for k, i in enumerate(pick):
            x[k, : len(pairs[i][0])], y[k, : len(pairs[i][1])] = pairs[i]
        live = y != 0
        row, best = np.zeros((len(pick), n + 1), np.int32), np.zeros(len(pick), np.int32)
        slope = -GAP * np.arange(n + 1, dtype=np.int32)
        for i in range(m):
            hit = (x[:, i, None] == y) & live & (x[:, i, None] != 0)
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(hit, MATCH, MISMATCH), row[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the passage
            np.maximum(best, row.max(1), out=best)
        out[pick] = best / np.array([MATCH * len(pairs[i][0]) for i in pick])
    return out


class Field:
    """A field of 2^width bits, two of them set for each n-gram; n-grams with an unset one are none of these."""

    def __init__(self, bits: bytes, width: int):
        self.bits, self.width = bits, width

    def held(self, gram: np.ndarray) -> np.ndarray:
        """Where the n-grams may be some of the field's."""
        bits, low = np.frombuffer(self.bits, np.uint8), np.uint64((1 << self.width) - 1)
        at = np.arange(len(gram))
        for place in (lambda g: g >> np.uint64(64 - self.width), lambda g: g & low):
            p = place(gram[at])
            at = at[(bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return at


def field_of(table: DataFrame) -> Field | None:
    """The field of the column `gram`, set in parts by tasks; its size is bounded, and so is what comes to the driver."""
    own = table.select("gram").distinct()
    n = own.count()
    if not n:
        return None
    width = min(max(PART_BITS, (n * BITS).bit_length()), MAX_BITS)
    g = F.col("gram")
    places = own.select(F.explode(F.array(F.shiftrightunsigned(g, 64 - width), g.bitwiseAND(F.lit((1 << width) - 1)))).alias("place")).distinct()

    def set_bits(part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << PART_BITS, np.uint8)
        on[part["place"].to_numpy() & ((1 << PART_BITS) - 1)] = 1
        return pd.DataFrame({"part": [int(part["place"].iloc[0]) >> PART_BITS], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    size = 1 << (PART_BITS - 3)
    bits = bytearray(1 << (width - 3))
    for r in places.groupBy(F.shiftright("place", PART_BITS)).applyInPandas(set_bits, "part long, bits binary").toLocalIterator():
        bits[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return Field(bytes(bits), width)


def keyed(docs: DataFrame, text_col: str, key: str = "text_key", text: str = "t") -> DataFrame:
    """Texts with the key that copies share; null is empty."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(key_of(text_col).alias(key), t.alias(text))


def key_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


def item_grams(items: DataFrame) -> DataFrame:
    """(item_key, size, kind, stretch, offset, gram): of an item's equal n-grams one a quarter of the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, word = hashed_words(b["t"].tolist())
            edges = np.searchsorted(doc, np.arange(len(b) + 1))
            size = np.diff(edges)
            least = 1
            for kind, (most, patterns, _) in enumerate(KINDS):
                own = (size >= least) & (size <= (most or size))
                least = (most or 0) + 1
                for at, gram in (grams(doc, word, p) for p in patterns):
                    at, gram = at[own[doc[at]]], gram[own[doc[at]]]
                    offset = at - edges[doc[at]]
                    yield pd.DataFrame({"item_key": b["item_key"].to_numpy()[doc[at]], "size": size[doc[at]], "kind": kind, "stretch": offset // STRETCH, "offset": offset, "gram": gram.view(np.int64)})

    rows = items.mapInPandas(run, "item_key binary, size long, kind int, stretch long, offset long, gram long")
    quarter = F.expr("offset div greatest(size div 4, 1)")
    return rows.groupBy("item_key", "size", "kind", "gram", quarter.alias("quarter")).agg(F.min("offset").alias("offset"), F.min("stretch").alias("stretch")).drop("quarter")


def pair_hashes(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of a word in an item, known by a hash of its own."""
    return mix64(word + item * ODD)


def again(pair: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Hashes of a word in an item, found so many times before."""
    return np.where(times > 0, mix64(pair + times.astype(np.uint64) * ODD), pair)


def times_before(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key has stood in its row before."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])][: len(k)]
    at, out = np.arange(len(k)), np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def own_hash(keys: list[bytes]) -> np.ndarray:
    """The first half of each item's MD5."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def item_words(items: DataFrame) -> DataFrame:
    """(gram): the hashes of items' words, and of each word in its item, as often as it has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, word = hashed_words(b["t"].tolist())
            pair = pair_hashes(own_hash(b["item_key"].tolist())[doc], word)
            yield pd.DataFrame({"gram": np.r_[np.unique(word), again(pair, times_before(pair, doc))].view(np.int64)})

    return items.mapInPandas(run, "gram long")


def most_shared(item: np.ndarray, row: np.ndarray, word: np.ndarray, field: Field) -> np.ndarray:
    """Upper bound of the words that each passage can match with its item, from the field of the items' words; `row` and `word` are the passages' words."""
    pair = pair_hashes(item[row], word)
    at = field.held(pair)
    pair, row = pair[at], row[at]
    times = times_before(pair, row)
    more = np.flatnonzero(times > 0)
    lost = np.delete(more, field.held(again(pair[more], times[more])))
    return np.bincount(np.delete(row, lost), minlength=len(item))


def places_of(texts: list[str], kinds: list[int], field: Field, vocabulary: Field | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """By blocks of texts: text, place in it and n-gram where the field may have it, and the block's words."""
    for lo, hi in groups_of([len(t) for t in texts], BLOCK):
        doc, word = hashed_words(texts[lo:hi])
        first = np.searchsorted(doc, np.arange(hi - lo))
        known = None
        if vocabulary:
            known = np.zeros(len(word), dtype=bool)
            known[vocabulary.held(word)] = True
        text, places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for pattern in (p for k in kinds for p in KINDS[k][2]):
            at, gram = grams(doc, word, pattern, known)
            own = field.held(gram)
            text.append(doc[at[own]] + lo)
            places.append(at[own] - first[doc[at[own]]])
            found.append(gram[own])
        yield np.concatenate(text), np.concatenate(places), np.concatenate(found).view(np.int64), len(word)


def chosen_seeds(corpus: DataFrame, own: DataFrame, kinds: list[int], vocabulary: Broadcast | None = None) -> DataFrame:
    """The item n-grams that are seeds, by their counts in the whole corpus."""
    sc = corpus.sparkSession.sparkContext
    field = sc.broadcast(field_of(own))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, _, gram, n in places_of(b["t"].tolist(), kinds, field.value, vocabulary and vocabulary.value):
                g, times = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"gram": pd.array(g, "Int64"), "n": times})
                yield pd.DataFrame({"gram": pd.array([None], "Int64"), "n": [n]})  # the words

    counts = materialise(corpus.select("t").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    words = counts.filter("gram IS NULL").select("n").first()
    held = own.groupBy("gram").agg(F.count(F.lit(1)).alias("places"))
    hits = held.join(counts, "gram").select("gram", (F.col("n") * F.col("places")).alias("hits"))
    rarest = F.rank().over(Window.partitionBy("item_key", "kind", "stretch").orderBy("hits"))
    known = own.join(hits, "gram").withColumn("rarest", rarest)
    stay = (F.col("hits") <= SHARE * (words["n"] if words else 0)) | (F.col("rarest") <= RARE) | (F.col("kind") < len(KINDS) - 1)
    return materialise(known.filter(stay).select("item_key", "size", "offset", "gram"))


def slots_of(corpus: DataFrame, seeds: DataFrame, kinds: list[int], field: Field, vocabulary: Broadcast | None = None) -> DataFrame:
    """(text_key, item_key, slot) with the least and largest start of the item that its seeds name, and their number."""
    sent = corpus.sparkSession.sparkContext.broadcast(field)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("text_key")
            for text, at, gram, _ in places_of(b["t"].tolist(), kinds, sent.value, vocabulary and vocabulary.value):
                yield pd.DataFrame({"text_key": b["text_key"].to_numpy()[text], "at": at, "gram": gram})

    hits = corpus.mapInPandas(find, "text_key binary, at long, gram long").distinct()
    start = hits.join(seeds, "gram").withColumn("start", F.col("at") - F.col("offset"))
    return start.groupBy("text_key", "item_key", "size", F.floor(F.col("start") / F.col("size")).alias("slot")).agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"), F.count(F.lit(1)).alias("n_seeds")
    )


def least_share(size: np.ndarray, threshold: float) -> np.ndarray:
    """The least score of items of so many words. Each match gives MATCH and nothing else gives anything, so it is also the least share of words matched."""
    return np.where(size <= SHORT, max(threshold, SHORT_SCORE), threshold)


def passages_of(corpus: DataFrame, slots: DataFrame, threshold: float, vocabulary: Broadcast) -> DataFrame:
    """(text_key, item_key, n_seeds, words): the words around each slot, cut where its text is sent to, once a text; those that can't reach the threshold are left out."""
    # an alignment that reaches the threshold has at most 2 * (1 - threshold) gaps a word; a seed's place may be off by a quarter
    room = F.ceil(F.col("size") * (max(0.0, MATCH * (1 - threshold)) + 0.25)) + 2
    first, last = F.greatest(F.col("lo") - room, F.lit(0)), F.col("hi") + F.col("size") + room
    near = F.collect_list(F.struct("item_key", "size", "n_seeds", first.alias("first"), last.alias("last")))
    of_text = slots.groupBy("text_key").agg(near.alias("near"))
    texts = corpus.join(materialise(slots.select("text_key").distinct()), "text_key", "left_semi").groupBy("text_key").agg(F.first("t").alias("t"))
    rows = texts.join(of_text, "text_key").select("text_key", "t", *(F.col(f"near.{c}").alias(c) for c in ("item_key", "size", "n_seeds", "first", "last")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in groups_of([len(t) for t in b["t"]], BLOCK):
                part = b.iloc[lo:hi]
                doc, word = hashed_words(part["t"].tolist())
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                times = part["first"].map(len).to_numpy()
                row = np.repeat(np.arange(hi - lo), times)
                first, last, size, n_seeds, item = (np.concatenate(part[c].tolist()) for c in ("first", "last", "size", "n_seeds", "item_key"))
                first, last = edges[row] + first, np.minimum(edges[row] + last, edges[row + 1])
                n, own, least = np.maximum(last - first, 0), own_hash(item.tolist()), least_share(size, threshold) * size
                for x, y in groups_of(n.tolist(), JUDGED):
                    near = np.repeat(np.arange(y - x), n[x:y])
                    words = word[np.arange(len(near)) + np.repeat(first[x:y] - np.cumsum(n[x:y]) + n[x:y], n[x:y])]
                    able = x + np.flatnonzero(most_shared(own[x:y], near, words, vocabulary.value) >= least[x:y])
                    if len(able):
                        cuts = [word[f:e].tobytes() for f, e in zip(first[able], last[able], strict=True)]
                        yield pd.DataFrame({"text_key": part["text_key"].to_numpy()[row[able]], "item_key": item[able], "n_seeds": n_seeds[able], "words": cuts})

    return rows.mapInPandas(cut, "text_key binary, item_key binary, n_seeds long, words binary")


def most_matches(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Upper bound of the words that each passage can match with its item: those it shares, as often as both have them."""

    def counted(lists: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        key, first, times = np.unique(mix64(np.concatenate(lists) + row.astype(np.uint64) * ODD), return_index=True, return_counts=True)
        return key, row[first], times

    a, row, x = counted(items)
    b, _, y = counted(passages)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(row[i], weights=np.minimum(x[i], y[j]), minlength=len(items))


def may_match(items: list[bytes], passages: list[bytes]) -> np.ndarray:
    """Cheap upper bound of the same: an item's words whose slot in a table, dealt by pair and word, a word of its passage fills."""

    def slots(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)) // 8)
        return row, (np.frombuffer(b"".join(lists), np.uint64) + row.astype(np.uint64) * ODD) >> np.uint64(64 - TABLE_BITS)

    filled = np.zeros(1 << TABLE_BITS, dtype=bool)
    filled[slots(passages)[1]] = True
    row, slot = slots(items)
    return np.bincount(row[filled[slot]], minlength=len(items))


def scored(passages: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(text_key, item_key, score, n_seeds), the best passage of each pair whose score reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["item"].map(len).to_numpy(np.int64) // 8
            least = least_share(size, threshold)
            some = may_match(b["item"].tolist(), b["words"].tolist()) >= least * size
            b, size, least = b[some], size[some], least[some]
            own = [np.frombuffer(w, np.uint64) for w in b["item"]]
            near = [np.frombuffer(w, np.uint64) for w in b["words"]]
            able = np.flatnonzero(most_matches(own, near) >= least * size) if len(b) else np.empty(0, np.int64)
            score = align([(own[k], near[k]) for k in able])
            good = able[score >= least[able]]
            yield b.iloc[good][["text_key", "item_key"]].assign(score=score[score >= least[able]], n_seeds=b["n_seeds"].to_numpy()[good])

    rows = passages.join(items, "item_key").select("text_key", "item_key", "n_seeds", "words", "item")
    best = rows.mapInPandas(run, "text_key binary, item_key binary, score double, n_seeds long").groupBy("text_key", "item_key")
    return best.agg(F.max(F.struct("score", "n_seeds")).alias("best")).select("text_key", "item_key", "best.*")


def matches(docs: DataFrame, items: DataFrame, threshold: float, text_col: str) -> DataFrame | None:
    """(text_key, item_key, score, n_seeds) of distinct texts and items whose score reaches the threshold; None without items."""
    short_batches(docs.sparkSession)
    texts = items.distinct()
    own = materialise(item_grams(texts))
    kinds = sorted(r["kind"] for r in own.select("kind").distinct().collect())  # at most three
    corpus = keyed(docs, text_col)
    if not kinds:
        return None
    vocabulary = docs.sparkSession.sparkContext.broadcast(field_of(item_words(texts)))
    seeds = chosen_seeds(corpus, own, kinds, vocabulary)
    field = field_of(seeds)
    if field is None:
        return None
    slots = materialise(slots_of(corpus, seeds, kinds, field, vocabulary))
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_key": b["item_key"], "item": [hashed_words([t])[1].tobytes() for t in b["t"]]})

    items = materialise(texts.mapInPandas(words, "item_key binary, item binary"))  # its size says whether it is broadcast
    return materialise(scored(passages_of(corpus, slots, threshold, vocabulary), items, threshold))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(document, item, score, seeds) of all pairs whose score reaches the threshold; an item id named like the documents' is `item_<name>`."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    shown = f"item_{item_col}" if item_col.lower() == id_col.lower() else item_col
    found = matches(docs, keyed(benchmark, text_col, "item_key"), threshold, text_col)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kinds[0]}, `{shown}` {kinds[1]}, score double, n_seeds bigint")
    ids = benchmark.select(key_of(text_col).alias("_item_key"), F.col(f"`{item_col}`").alias("_item"))
    best = found.join(ids, F.col("item_key") == F.col("_item_key")).groupBy("text_key", "_item").agg(F.max(F.struct("score", "n_seeds")).alias("best"))
    rows = docs.select(key_of(text_col).alias("_text_key"), F.col(f"`{id_col}`").alias("_id"))
    pairs = rows.join(best, F.col("_text_key") == F.col("text_key"))
    return pairs.select(F.col("_id").alias(id_col), F.col("_item").alias(shown), "best.score", "best.n_seeds")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns."""
    found = matches(docs, keyed(benchmark, text_col, "item_key"), threshold, text_col)
    if found is None:
        return docs
    key, other = free_names(docs, "_text_key", "_bad_key")
    bad = found.select(F.col("text_key").alias(other)).distinct()
    return docs.withColumn(key, key_of(text_col)).join(bad, F.col(key) == F.col(other), "left_anti").drop(key)
