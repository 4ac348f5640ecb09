"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. Templates are cut into pieces of at
most `PIECE` words. A piece of n words meets the blocks of the least width of `WIDTHS` that is 2n or more; blocks start
at every quarter of their width, so each passage of n words lies whole in one. A block meets a piece if it has at least
`THRESHOLD` of the piece's distinct words.

1. Order. The words of all templates are counted over the whole corpus; the rarest comes first.
2. Prefixes. A block that has `need` of a piece's words has one of the piece's first (size - need + 1), which are its
   rarest. Only blocks with such a word leave the scan, as the template words at their places.
3. Join. The words of these blocks meet the pieces' prefix words. The length filter asks that a block has `need` template
   words at all, the positional one that enough words are left on both sides behind the first common one. What
   remains is verified by the sets' overlap. A pair is made at its first common word only, so none comes twice.
4. Phrases are pieces that have to be held whole: their prefix is one word. In the blocks that have all their words the
   places where these stand consecutively are counted; each place belongs to one block.

Templates come in sets of bounded size, and the words and pieces of a set are sent to tasks. Words are compared by
64-bit hashes.

Defined results: a null text is empty and has no words, labels or places; its score is 0. Templates without words meet
nothing. Repeated rows each have their row. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import groups_of, materialise, short_batches, word_hashes

WIDTHS, PIECE, THRESHOLD = (16, 32, 64), 32, 0.8
#: Bytes of text whose words are hashed together; characters of templates that are sent to tasks at once.
BLOCK, TEMPLATE_CHARS = 1_000_000, 2_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IN_WORD = np.array([b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])

# Phrases and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Notices that licenses ask to be given, and openings of license texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gnu-gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gnu-gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z have lower forms


class Pieces:
    """The pieces of some templates and phrases; words are numbered as they come until `order` numbers them by count."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: float):
        self.rows: list[dict] = []
        for label, text in templates:
            words = WORD.findall(lowered(text).decode("utf-8", "surrogatepass"))
            n = math.ceil(len(words) / PIECE)
            for k in range(n):  # equal shares, so that no piece is short
                self.add(label, words[k * len(words) // n : (k + 1) * len(words) // n], threshold, False)
        for label, text in phrases:
            words = WORD.findall(lowered(text).decode("utf-8", "surrogatepass"))
            if len(words) > WIDTHS[0] // 4 + 1:
                raise ValueError(f"a phrase has at most {WIDTHS[0] // 4 + 1} words: {text}")
            self.add(label, words, 1.0, True)
        self.words = sorted({w for r in self.rows for w in r["words"]})
        self.hashes = word_hashes([w.encode("utf-8", "surrogatepass") for w in self.words], IN_WORD)[1]
        self.by_hash = np.argsort(self.hashes)

    def add(self, label: str, words: list[str], threshold: float, phrase: bool) -> None:
        if words:
            need = math.ceil(threshold * len(set(words)) - 1e-9)
            self.rows.append({"piece": len(self.rows), "label": label, "words": words, "need": max(need, 1), "phrase": phrase, "width": next(w for w in WIDTHS if w >= 2 * len(words))})

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed word, -1 for words that no template has."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes[self.by_hash], h), len(self.words) - 1)
        k = self.by_hash[at]
        return np.where(self.hashes[k] == h, k, -1)

    def order(self, counts: dict[int, int]) -> None:
        """Number the words by their counts, the rarest first, and find each piece's set and prefix."""
        ranked = sorted(range(len(self.words)), key=lambda k: (counts.get(k, 0), self.words[k]))
        rank = {self.words[k]: r for r, k in enumerate(ranked)}
        self.words, self.hashes = [self.words[k] for k in ranked], self.hashes[ranked]
        self.by_hash = np.argsort(self.hashes)
        self.prefix = {w: np.zeros(len(ranked) + 1, dtype=bool) for w in WIDTHS}  # the last stands for -1
        for r in self.rows:
            r["seq"] = [rank[w] for w in r["words"]]
            r["set"] = sorted(set(r["seq"]))
            r["prefix"] = r["set"][: len(r["set"]) - r["need"] + 1]
            self.prefix[r["width"]][r["prefix"]] = True

    def postings(self, spark) -> DataFrame:
        """A row for each word of each piece's prefix: its width, the word and its place, from 1, and the piece."""
        rows = [(r["width"], word, i + 1, r["piece"], r["label"], r["need"], r["set"], r["seq"], r["phrase"]) for r in self.rows for i, word in enumerate(r["prefix"])]
        return spark.createDataFrame(rows, "width int, word int, i int, piece int, label string, need int, own_words array<int>, seq array<int>, phrase boolean")


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of bounded size with (row, hash) of their words."""
    for b in batches:
        texts = [lowered(t) for t in b["t"]]
        for lo, hi in groups_of([len(t) for t in texts], BLOCK):
            yield b.iloc[lo:hi], *word_hashes(texts[lo:hi], IN_WORD)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("string").alias("own"), F.xxhash64(text).alias("key"), text.alias("t"))


def word_counts(rows: DataFrame, pieces: Pieces) -> dict[int, int]:
    """How often each template word stands in all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(pieces.words), dtype=np.int64)
        for _, _, h in _batches(batches):
            k = pieces.numbers(h)
            total += np.bincount(k[k >= 0], minlength=len(total))
        yield pd.DataFrame({"word": np.flatnonzero(total), "n": total[total > 0]})

    counts = rows.select("t").mapInPandas(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}  # at most one row a template word


def candidate_blocks(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """own, key, n_words and the blocks (width, start, words) that have a prefix word of their width; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, doc, h in _batches(batches):
            k = pieces.numbers(h)
            edges = np.searchsorted(doc, np.arange(len(b) + 1))
            found: list[list[dict]] = [[] for _ in range(len(b))]
            for width in WIDTHS:
                step = width // 4
                at = np.flatnonzero(pieces.prefix[width][k])
                d, place = doc[at], at - edges[doc[at]]
                start = ((place // step)[:, None] - np.arange(4)).ravel()  # the four blocks that have the place
                both = np.unique(np.stack([np.repeat(d, 4), start * step], axis=1)[start >= 0], axis=0)
                for i, s in both.tolist():
                    found[i].append({"width": width, "start": s, "words": k[edges[i] + s : min(edges[i] + s + width, edges[i + 1])].astype(np.int32)})
            yield pd.DataFrame({"own": b["own"].to_numpy(), "key": b["key"].to_numpy(), "n_words": np.diff(edges), "blocks": found})

    return materialise(rows.mapInPandas(run, "own string, key bigint, n_words bigint, blocks array<struct<width: int, start: bigint, words: array<int>>>"))


def met_pieces(made: DataFrame, pieces: Pieces) -> DataFrame:
    """own, key, start, n (words of the block), piece, label, phrase, containment and places of the pairs that meet.

    places: where a phrase begins in the text, of those places that belong to the block; empty for pieces of templates.
    """
    blocks = made.select("own", "key", F.explode("blocks").alias("b")).select("own", "key", "b.*").dropDuplicates(["own", "key", "width", "start"])
    blocks = blocks.withColumn("held", F.array_sort(F.array_distinct(F.filter("words", lambda w: w >= 0))))
    blocks = blocks.select("*", F.posexplode("held").alias("j", "word")).withColumn("j", F.col("j") + 1)
    pairs = blocks.join(F.broadcast(pieces.postings(made.sparkSession)), ["width", "word"])  # a set of pieces is of bounded size
    size, need = F.size("held"), F.col("need")
    pairs = pairs.filter((size >= need) & (F.col("j") <= size - need + 1))
    pairs = pairs.filter(1 + F.least(F.size("own_words") - F.col("i"), size - F.col("j")) >= need)
    pairs = pairs.filter(~F.arrays_overlap(F.slice("own_words", 1, F.col("i") - 1), F.slice("held", 1, F.col("j") - 1)))  # the first common word
    shared = F.size(F.array_intersect("own_words", "held"))
    pairs = pairs.withColumn("shared", shared).filter(F.col("shared") >= need)
    lengths = F.size("seq")
    first = F.sequence(F.lit(0), F.least(F.col("width") / 4, F.size("words")).cast("int") - 1)
    places = F.transform(F.filter(first, lambda p: F.slice("words", p + 1, lengths) == F.col("seq")), lambda p: p + F.col("start"))
    places = F.when(F.col("phrase"), places).otherwise(F.array().cast("array<bigint>"))
    met = pairs.select("own", "key", "start", F.size("words").alias("n"), "piece", "label", "phrase", (F.col("shared") / F.size("own_words")).alias("containment"), places.alias("places"))
    return met.filter(~F.col("phrase") | (F.size("places") > 0))


def _scanned(docs: DataFrame, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(own, key, n_words) of all rows, and what `met_pieces` gives for all sets of templates."""
    short_batches(docs.sparkSession)
    rows, each, met = _rows(docs, id_col, text_col), None, None
    for lo, hi in list(groups_of([len(t) for _, t in templates], TEMPLATE_CHARS)) or [(0, 0)]:
        pieces = Pieces(templates[lo:hi], phrases if lo == 0 else (), threshold)
        pieces.order(word_counts(rows, pieces))
        made = candidate_blocks(rows, pieces)
        each = made.select("own", "key", "n_words") if each is None else each
        met = met_pieces(made, pieces) if met is None else met.unionByName(met_pieces(made, pieces))
    return each, met


def license_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every block that meets a template, or holds a phrase: its label, first word and words, and the share of the piece's words."""
    _, met = _scanned(docs, templates, phrases, threshold, id_col, text_col)
    own = F.col("own").cast(docs.schema[id_col].dataType).alias(id_col)
    return met.select(own, "label", "phrase", F.col("start").alias("first_word"), F.col("n").alias("n_words"), "containment", "places")


def license_report(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, places of phrases, labels and the largest containment."""
    each, met = _scanned(docs, templates, phrases, threshold, id_col, text_col)
    found = met.groupBy("own", "key").agg(
        F.sum(F.size("places")).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"), F.array_sort(F.collect_set("label")).alias("all"),
        F.max("containment").alias("score"),
    )
    found = found.withColumnsRenamed({"own": "own_", "key": "key_"})
    rows = each.join(found, F.col("own").eqNullSafe(F.col("own_")) & (F.col("key") == F.col("key_")), "left")
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rows.select(
        F.col("own").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        listed("base").alias("base_labels"), listed("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
