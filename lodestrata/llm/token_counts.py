"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie of distinct pre-tokens.

A pre-token is a maximal run of non-blank characters with the blank mark in front. The forward score at a node of the
trie of pre-tokens, the best sum of piece scores over the ways to cut the prefix that the node spells, depends on that
prefix alone. Visiting the distinct pre-tokens in sorted order walks the trie depth first: the scores of the shared
prefix stay on the stack, only the new characters are computed, and the terminal's token count is stored with the
pre-token. Texts then add up terminal counts. Nothing is shuffled: each task has a trie of what its batches hold.

The pieces come from a public vocabulary file; nothing is trained. A caller may give the log probabilities of the
pieces. Else those of the file count, if it has any; in a file of merges, whose scores are only an order, a piece of
rank r has the score -ln(r + 2) - 1, an estimate from rank by Zipf's law. A character that no piece covers is one
unknown token.

Defined results: null or blank texts have no pre-tokens and no tokens. Repeated rows each keep a row. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestrata.llm.common import groups_of, map_texts

MARK = "▁"
UNKNOWN = -30.0
#: Distinct pre-tokens whose terminal counts a task keeps; beyond it the store starts anew. Counts don't depend on it.
STORE = 400_000
#: Characters of the texts that share one trie.
TRIE_CHARS = 4_000_000


def unigram_scores(model_file: str) -> dict[str, float]:
    """Scores of the pieces of a public vocabulary: its own log probabilities, or an estimate from ranks where it has none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    given = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
    ranks = all(float(s).is_integer() for s in given.values())
    return {p: -math.log(r + 2) - 1 for r, p in enumerate(given)} if ranks else given


class TrieCounter:
    """Terminal token counts of pre-tokens; forward scores are computed once per shared prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.starts = {p[:n] for p in scores for n in range(1, len(p))}  # prefixes that some longer piece continues
        self.steps = 0

    def counts(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each of the sorted distinct words; ties of scores go to fewer tokens."""
        scores, starts, out, before = self.scores, self.starts, [], ""
        # best[i]: (score, -tokens) of the prefix of length i; reach[i]: starts of pieces that may go on beyond i
        best: list[tuple[float, int]] = [(0.0, 0)]
        reach: list[list[int]] = [[0]]
        for w in words:
            keep, most = 0, min(len(w), len(before))
            while keep < most and w[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], reach[keep + 1 :]
            for i in range(keep, len(w)):
                self.steps += 1
                s, n = best[i]
                top, go = (s + UNKNOWN, n - 1), []
                for j in reach[i]:
                    piece = w[j : i + 1]
                    if (v := scores.get(piece)) is not None:
                        s, n = best[j]
                        if (got := (s + v, n - 1)) > top:
                            top = got
                    if piece in starts:
                        go.append(j)
                go.append(i + 1)
                best.append(top)
                reach.append(go)
            out.append((-best[-1][1], best[-1][0]))
            before = w
        return out


def pre_tokens(text: str) -> list[str]:
    return text.split()


def token_counts(docs: DataFrame, model_file: str, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_pretokens, n_tokens, and the log score of its best segmentation; `scores`: the pieces' log probabilities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, store = TrieCounter(scores if scores is not None else unigram_scores(model_file)), {}

        def count(rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nonlocal store
            b = pd.concat(rows, ignore_index=True)
            for lo, hi in groups_of(b["t"].str.len().tolist(), TRIE_CHARS):
                texts = [pre_tokens(t) for t in b["t"].iloc[lo:hi]]
                new = set().union(*texts)
                if len(store) + len(new) > STORE:
                    store = {}
                new = sorted(w for w in new if w not in store)
                store.update(zip(new, trie.counts([MARK + w for w in new]), strict=True))
                got = [[store[w] for w in t] for t in texts]
                yield pd.DataFrame({
                    id_col: b[id_col].iloc[lo:hi].to_numpy(), "n_pretokens": [len(t) for t in texts],
                    "n_tokens": [sum(n for n, _ in g) for g in got], "score": [math.fsum(s for _, s in g) for g in got],
                })

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += int(b["t"].str.len().sum())
            if size >= TRIE_CHARS:
                yield from count(held)
                held, size = [], 0
        if held:
            yield from count(held)

    return map_texts(docs, run, "n_pretokens bigint, n_tokens bigint, score double", id_col, text_col)
