"""Quality rules: base counts and repetition found by a suffix array over a document's words.

The suffixes of all texts of a block are sorted together by prefix doubling, words numbered by (document, word) so
that no match leaves its document; only suffixes that still tie are sorted again. The ranks kept at each doubling give
the longest common prefix of neighbours. The intervals of equal prefixes of at least `min_repeat` words are the
repeated substrings: a suffix's longest one is the larger of its two neighbouring values, and it is maximal where the
suffix one word earlier does not have a longer one that covers it. The union of their spans is the covered part. A text
is rejected where more than `max_covered` of its words are repeated, or where a single repeat is longer than
`max_longest` words, however long the text is. Repeats of `min_repeat` words lie within the base rule's repeated windows,
so `max_covered` acts only below that rule's share.

Defined results: null, empty and blank texts have no words, so the base rule rejects them. Repeated rows each keep a
row. Empty tables give empty results. Other columns are kept by `reject_low_quality` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import groups_of, map_rows, map_texts

# Fixed values of the contract.
BLANKS, SYMBOLS, WINDOW, LEAST_WORDS, REPEAT_PERCENT = " \t\n\x0b\x0c\r", "#*$%&|<>", 5, 10, 20
#: Characters of the texts whose suffixes are sorted together; a longer text stands alone.
BLOCK_CHARS = 1_000_000


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of `symbols`, and each position's rank by its first 1, 2, 4, ... symbols (equal ranks: equal prefixes)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0])
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)  # one a doubling is kept
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, k = [rank], 1
    place = np.arange(n)
    size = np.repeat(np.diff(np.r_[first, n]), np.diff(np.r_[first, n]))
    tied = place[size > 1]  # places in the order whose suffixes tie
    while len(tied) and k < n:
        at = order[tied]
        beyond = at + k
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        lead = rank[at]
        by = np.lexsort((second, lead))
        at, lead, second = at[by], lead[by], second[by]
        order[tied] = at
        new = np.r_[True, (np.diff(lead) != 0) | (np.diff(second) != 0)]
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(at)])
        rank = rank.copy()
        rank[at] = np.repeat(tied[start], sizes)
        levels.append(rank)
        tied = tied[np.repeat(sizes, sizes) > 1]
        k *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the order; 0 where surely below `least`."""
    n = len(order)
    got = np.zeros(n, dtype=np.int64)
    gate = levels[min(len(levels) - 1, max(0, least.bit_length() - 1))]
    near = np.flatnonzero(gate[order[1:]] == gate[order[:-1]]) + 1 if n > 1 else np.empty(0, dtype=np.int64)
    a, b = order[near - 1].copy(), order[near].copy()
    length = np.zeros(len(near), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        rank = levels[j]
        inside = (a < n) & (b < n)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        step = same.astype(np.int64) << j
        a, b, length = a + step, b + step, length + step
    got[near] = length
    return got


def repeats(symbols: np.ndarray, least: int) -> np.ndarray:
    """At each position the length of the longest substring there that occurs twice or more; 0 below `least`."""
    n = len(symbols)
    longest = np.zeros(n, dtype=np.int64)
    if n > 1:
        order, levels = suffix_levels(symbols)
        lcp = common_prefixes(order, levels, least)
        longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
        longest[longest < least] = 0
    return longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Positions inside the spans [i, i + lengths[i])."""
    at = np.flatnonzero(lengths)
    edge = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], min_repeat: int) -> dict[str, np.ndarray]:
    """The base counts and the repetition measures of each text."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
    }
    doc = np.repeat(np.arange(len(texts)), n_words)
    total = len(doc)
    if total:
        flat = np.empty(total, dtype=object)
        flat[:] = [w for ws in words for w in ws]
        codes, kinds = pd.factorize(flat)
        longest = repeats(doc * np.int64(len(kinds)) + codes, WINDOW)
    else:
        longest = np.empty(0, dtype=np.int64)
    windows = covered(np.where(longest >= WINDOW, WINDOW, 0))
    spans = np.where(longest >= min_repeat, longest, 0)
    count = lambda mask: np.bincount(doc, weights=mask, minlength=len(texts)).astype(np.int64)
    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, doc, spans)
    out |= {"n_repeat_words": count(windows), "repeat_covered": count(covered(spans)), "longest_repeat": top}
    maximal = spans > 0
    maximal[1:] &= ~((spans[:-1] > spans[1:]) & (doc[:-1] == doc[1:]))
    return out | {"n_maximal": count(maximal)}


def verdicts(m: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    n = m["n_words"]
    base_failed = (n < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * n)
    too_much = m["repeat_covered"] > max_covered * n
    too_long = m["longest_repeat"] > max_longest
    return base_failed, ~(base_failed | too_much | too_long)


def _measured(texts: list[str], min_repeat: int) -> dict[str, np.ndarray]:
    parts = [measure(texts[lo:hi], min_repeat) for lo, hi in groups_of([len(t) for t in texts], BLOCK_CHARS)] or [measure([], min_repeat)]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


#: Words of a repeat; the share of words that repeats may cover (less than REPEAT_PERCENT); the longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.12, 50


def quality_report(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict per document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["repeat_covered", "longest_repeat", "n_maximal"]
    columns = ", ".join([*[f"{c} bigint" for c in names], "base_failed boolean", "kept boolean", *[f"{c} bigint" for c in more]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _measured(b["t"].tolist(), min_repeat)
            failed, kept = verdicts(m, max_covered, max_longest)
            yield pd.DataFrame({id_col: b[id_col].to_numpy()} | {c: m[c] for c in names} | {"base_failed": failed, "kept": kept} | {c: m[c] for c in more})

    return map_texts(docs, run, columns, id_col, text_col)


def reject_low_quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""

    def change(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return b.filter(pa.array(verdicts(_measured(texts, min_repeat), max_covered, max_longest)[1]))

    return map_rows(docs, text_col, change)
