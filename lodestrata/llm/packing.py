"""Packing: shortest-pack-first over the length histogram.

Each document's ids (and its end id) are cut into whole sequences and a remainder, which one pass over the texts knows
without seeing any other document: a row per piece, with its length and the checksum of its ids. The histogram of
remainder lengths has at most as many rows as a sequence has tokens; only it reaches the driver. Lengths are placed
longest first. A length goes to the shortest open packs that still hold it, or opens new ones; packs of the same
filling are one pattern with a count, split when only part of them takes the next length. At the end, each length has
slots: so many pieces of it, at this offset of the packs of that pattern. Pieces get a rank among those of their
length, from counts of hash buckets, and the rank finds the slot.

Defined results: a null text is empty and still has its end id. Repeated rows are separate documents with equal ids,
each placed once. An empty table gives no pieces. Other columns are not read. Padding is what remains of each sequence,
save those filled to a power of two.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, short_batches

#: Entries of a worker's store of words, a full store starts anew; bytes of texts whose ids are made together.
STORE, GROUP = 200_000, 2_000_000
#: Hash buckets of a length, by which pieces are ranked: so many at least, and so many pieces in one at most.
BUCKETS, PER_BUCKET = 1024, 50_000
# The word split of the tokenizer file, where all characters are ASCII, Latin letters or white space.
LATIN = "a-zªµºÀ-ÖØ-öø-ƺ"
WORD = re.compile(f"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|(?:(?!'(?:s|t|re|ve|m|ll|d))[^\\s0-9{LATIN}])[^\\s0-9{LATIN}]*")
PLAIN = re.compile(f"[\\x21-\\x7e{LATIN}]*")
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
ODD = "[\x1c-\x1f]|<\\|"
# The tokenizer file's steps before its merges.
STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ["<|startoftext|>", "<|endoftext|>"],
]


def steps_of(tokenizer) -> list:
    """A tokenizer's normaliser, its split into words and its special tokens."""
    d = json.loads(tokenizer.to_str())
    return [d["normalizer"], d["pre_tokenizer"], [x["content"] for x in d["added_tokens"]]]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class IdBytes:
    """The ids of texts as little-endian unsigned 32-bit numbers, as the tokenizer file gives them.

    The file's steps (composed characters, lower case, word split, merges within a word) never look across white
    space, so ids are stored by word. Texts with special-token marks or odd separators, and chunks with
    characters beyond Latin, go through the tokenizer whole; so do all texts where a file has other steps.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known_steps = steps_of(self.tokenizer) == STEPS
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def fresh(self, w: str) -> bytes:
        spelt = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
        got = self.words[w] = struct.pack(f"<{len(t := self.model.tokenize(spelt))}I", *[x.id for x in t])
        return got

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        return [self.fresh(w) if x is None else x for w, x in zip(words, map(self.words.get, words), strict=True)]

    def chunk(self, c: str) -> bytes:
        low = c.lower() if c.isascii() else unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()
        return b"".join(self.of_words(WORD.findall(low))) if PLAIN.fullmatch(low) else self.whole(c)

    def parts(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these distinct chunks laid end to end, number of ids of each)."""
        if len(self.words) > STORE:
            self.words = {}
        simple = pc.match_substring_regex(distinct, SIMPLE)  # a word, perhaps with a stop: no split needed
        low = pc.utf8_lower(pc.if_else(simple, distinct, ""))
        coded = pc.ascii_rtrim(low, ".,").dictionary_encode()
        words = coded.dictionary.to_pylist()
        made = self.of_words([*words, ".", ","])
        core, last, none = coded.indices.to_numpy().copy(), len(words), len(made)
        tail = np.select([pc.ends_with(low, x).to_numpy(zero_copy_only=False) for x in (".", ",")], [last, last + 1], none)
        made.append(b"")
        for i in np.flatnonzero(~simple.to_numpy(zero_copy_only=False)):
            core[i] = len(made)
            made.append(self.chunk(distinct[i].as_py()))
        return laid_out(made, np.stack([core, tail], axis=1))

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, number of ids of each text)."""
        odd = np.ones(len(texts), dtype=bool)
        if self.known_steps:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        coded = split.flatten().dictionary_encode()
        made, size = self.parts(coded.dictionary)
        flat, n = gathered_parts(made, size, coded.indices.to_numpy())
        count = np.diff(np.r_[0, np.cumsum(n)][split.offsets.to_numpy() - split.offsets[0].as_py()])
        if odd.any():
            pieces = np.split(flat, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
            flat, count = np.concatenate(pieces), np.array([len(x) for x in pieces])
        return flat, count


def gathered_parts(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of these numbers laid end to end, the size of each), from all parts laid end to end."""
    n, first = size[code], (np.cumsum(size) - size)[code]
    ends = np.cumsum(n)
    return flat[np.arange(n.sum()) + np.repeat(first - ends + n, n)], n


def laid_out(made: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of rows that are each several of the parts in `made`."""
    size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
    flat, n = gathered_parts(np.frombuffer(b"".join(made), "<u4"), size, rows.ravel())
    return flat, n.reshape(rows.shape).sum(1)


@functools.lru_cache(1)
def coder(tokenizer_file: str) -> IdBytes:
    """One for all tasks of a worker, so that its stores last."""
    return IdBytes(tokenizer_file)


def pieces_of(docs: DataFrame, tokenizer_file: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: the document, where the piece starts, its length and checksum, the document's tokens."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, count = coder(tokenizer_file).ids(batch.column(1))
        tokens = count + 1
        ends = np.cumsum(tokens)
        ids = np.empty(len(flat) + len(tokens), dtype="<u4")
        last = np.zeros(len(ids), dtype=bool)
        last[ends - 1] = True
        ids[last], ids[~last] = end_id, flat
        pieces = -(-tokens // size)
        doc = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
        length = np.minimum(size, tokens[doc] - start)
        at = (ends - tokens)[doc] + start
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[doc]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, GROUP):
            yield cut(group)

    rows = docs.select(F.col(id_col).cast("string").alias(id_col), F.coalesce(text_col, F.lit("")).alias("t"))
    out = rows.mapInArrow(run, ", ".join([f"`{id_col}` string", *[f"{c} bigint" for c in names[1:]]]))
    return out.select(F.col(id_col).cast(kind).alias(id_col), *names[1:])


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (number of packs, lengths in them) that hold `counts` pieces of each length; longest lengths first."""
    patterns: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by tokens filled
    fills: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        made: list[tuple[int, int, list[int]]] = []
        while left:
            if fills and fills[0] + length <= size:  # the shortest pack that is open
                fill = fills[0]
                n, held = patterns[fill].pop()
                if not patterns[fill]:
                    del patterns[fill]
                    fills.pop(0)
                each = min((size - fill) // length, max(1, left // n))  # equal packs take equally many
                take = min(n, left // each)
                if take < n:
                    made.append((fill, n - take, held))
                made.append((fill + each * length, take, held + [length] * each))
                left -= take * each
            else:
                each = min(size // length, left)
                take = left // each
                made.append((each * length, take, [length] * each))
                left -= take * each
            if not fills or fills[0] + length > size or left == 0:
                for fill, n, held in made:
                    if fill not in patterns:
                        bisect.insort(fills, fill)
                    patterns[fill].append((n, held))
                made = []
        for fill, n, held in made:
            if fill not in patterns:
                bisect.insort(fills, fill)
            patterns[fill].append((n, held))
    return [p for fill in sorted(patterns, reverse=True) for p in patterns[fill]]


def slots_of(patterns: list[tuple[int, list[int]]]) -> dict[int, list[np.ndarray]]:
    """By length: first ranks, first sequences and offsets of its slots; a slot holds a piece in each pack of a pattern."""
    got: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for n, lengths in patterns:
        offset = 0
        for x in lengths:
            got[x].append((ranks[x], first, offset))
            ranks[x] += n
            offset += x
        first += n
    return {x: list(np.array(rows, dtype=np.int64).T) for x, rows in got.items()}


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset."""
    pieces = materialise(pieces_of(docs, tokenizer_file, size, end_id, id_col, text_col))
    buckets = max(BUCKETS, pieces.count() // PER_BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # bounded: `size` lengths at most
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(pack_histogram(counts, size))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a bucket at most
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(within)).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    keep = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    kind = pieces.schema[id_col].dataType
    schema = ", ".join([f"`{id_col}` string", *[f"{c} bigint" for c in [*keep[1:], "sequence_id", "offset"]]])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                ranks, firsts, offsets = slots[int(x)]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at], off[at] = firsts[k] + rank[at] - ranks[k], offsets[k]
            yield b[keep].assign(sequence_id=seq, offset=off)

    placed = ranked.select(F.col(id_col).cast("string").alias(id_col), *keep[1:], "rank").mapInPandas(place, schema)
    return placed.select(F.col(id_col).cast(kind).alias(id_col), *keep[1:], "sequence_id", "offset")
