"""Language identification: a linear-chain conditional random field over the words of a text.

Each word has affix features (first and last one to three letters), letter bigrams and trigrams, and lexicon features
(it is a frequent word of one training language). Their weights give emission scores, learned transitions link
neighbours, and forward-backward gives each word its distribution over languages, so code-switched texts get a label
per word. A text's language is the one with the largest mean of its words' marginals, weighted by word length.

The fit reads whole texts of a bounded sample: `max_docs` training documents of `max_chars` characters at most, equally
many of each language and one at least, so that a rare one is learned too, chosen by a hash of their id; of rows with
one id and language the least text trains. Labelling covers every word of every document. Chains are cut at every
`CHAIN` words, so that all chains advance in step, and a long text is labelled in parts of whole chains.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows without a language don't train;
without any training row every text is `und`. Repeated rows each keep a row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, groups_of, map_texts, mix64

WORD = re.compile(r"[^\W\d_]+")
#: Hash buckets of features, words of a chain, characters labelled together, words of a language's lexicon.
BUCKETS, CHAIN, BLOCK_CHARS, LEXICON = 1 << 16, 64, 1_500_000, 400
#: Words of a text that are labelled at once: whole chains.
PART = CHAIN * 4096
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs of distinct words; features under BUCKETS are hashed, above it lexicon entries."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    out_w, out_f = [], []

    def add(at: np.ndarray, size: int, kind: int) -> None:
        key = np.full(len(at), kind, dtype=np.uint64)
        for j in range(size):
            key = key * np.uint64(1_114_111) + code[at + j]
        out_w.append(owner[at])
        out_f.append((mix64(key) % np.uint64(BUCKETS)).astype(np.int64))

    pos = np.arange(len(code))
    for n in (2, 3):
        add(pos[pos + n <= ends[owner]], n, n)
    for n in (1, 2, 3):
        long = sizes >= n
        add(starts[long] + 1, n, 10 + n)
        add(ends[long] - 1 - n, n, 20 + n)
    hit = [(i, BUCKETS + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if hit:
        out_w.append(np.array([i for i, _ in hit]))
        out_f.append(np.array([f for _, f in hit]))
    return np.concatenate(out_w), np.concatenate(out_f)


def chains(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each chain over the words of consecutive texts."""
    per = -(-n_words // CHAIN)
    text_start = np.cumsum(n_words) - n_words
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(text_start, per) + k * CHAIN
    return start, np.minimum(CHAIN, np.repeat(text_start + n_words, per) - start)


class ChainField:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS + n, n), dtype=np.float32)
        self.moves = np.zeros((n, n))

    def emissions(self, words: list[str]) -> np.ndarray:
        w, f = word_features(words, self.lexicon)
        return np.stack([np.bincount(w, weights=self.weights[f, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)

    def marginals(self, scores: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: each word's distribution, and the expected transitions summed over all chains."""
        n = scores.shape[1]
        most = int(length.max())
        at = start[:, None] + np.minimum(np.arange(most), length[:, None] - 1)
        live = np.arange(most) < length[:, None]
        e = np.exp(scores - scores.max(1, keepdims=True))[at]
        e[~live] = 1.0
        move = np.exp(self.moves - self.moves.max())
        ahead = np.empty_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, most):
            x = (ahead[:, t - 1] @ move) * e[:, t]
            x /= x.sum(1, keepdims=True)
            ahead[:, t] = np.where(live[:, t, None], x, ahead[:, t - 1])
        back, got, expected = np.ones((len(start), n)), np.empty_like(e), np.zeros((n, n))
        for t in range(most - 1, -1, -1):
            x = ahead[:, t] * back
            got[:, t] = x / x.sum(1, keepdims=True)
            if t:
                on = live[:, t]
                y = e[on, t] * back[on]
                pair = ahead[on, t - 1][:, :, None] * move * y[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                expected += pair.sum(0)
                x = y @ move.T
                back[on] = x / x.sum(1, keepdims=True)
        out = np.empty_like(scores)
        out[at[live]] = got[live]
        return out, expected

    def fit(self, texts: list[list[str]], gold: list[int], epochs: int = 3, batch_words: int = 20_000, rate: float = 0.3) -> ChainField:
        n, sums = len(self.languages), np.full((BUCKETS + len(self.languages), len(self.languages)), 1e-6, dtype=np.float32)
        for _ in range(epochs):
            for lo, hi in groups_of([len(t) for t in texts], batch_words):
                flat = [w for t in texts[lo:hi] for w in t]
                if not flat:
                    continue
                codes, kinds = pd.factorize(np.array(flat, dtype=object))
                w, f = word_features(list(kinds), self.lexicon)
                scores = np.stack([np.bincount(w, weights=self.weights[f, k], minlength=len(kinds)) for k in range(n)], axis=1)[codes]
                sizes = np.array([len(t) for t in texts[lo:hi]])
                start, length = chains(sizes)
                got, expected = self.marginals(scores, start, length)
                label = np.repeat(gold[lo:hi], sizes)
                got[np.arange(len(flat)), label] -= 1.0
                seen = np.zeros((n, n))
                np.add.at(seen, (label[start], label[start]), length - 1)
                self.moves = np.clip(self.moves - 0.5 * (expected - seen) / len(flat), -6, 6)
                by_kind = np.stack([np.bincount(codes, weights=got[:, k], minlength=len(kinds)) for k in range(n)], axis=1)
                used, back = np.unique(f, return_inverse=True)
                grad = np.stack([np.bincount(back, weights=by_kind[w, k], minlength=len(used)) for k in range(n)], axis=1) / len(flat) ** 0.5
                sums[used] += grad**2
                self.weights[used] -= rate * grad / np.sqrt(sums[used])
        return self


def learn_lexicon(texts: list[list[str]], gold: list[int], n: int) -> dict[str, int]:
    """Frequent words used mainly in one language, with that language."""
    counts = [Counter() for _ in range(n)]
    for t, g in zip(texts, gold, strict=True):
        counts[g].update(t)
    total, out = sum(counts, Counter()), {}
    for g, c in enumerate(counts):
        for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if k >= 5 and k >= 0.8 * total[w]:
                out[w] = g
    return out


def fit_languages(docs: DataFrame, max_docs: int = 1200, max_chars: int = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ChainField | None:
    """Fit on at most `max_docs` (or one a language) of the given documents that have a text and a language; None without any."""
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars)).select(id_col, text_col, lang_col)
    sizes = usable.groupBy(lang_col).agg(F.approx_count_distinct(id_col).alias("_of")).filter("_of > 0")  # a row a language
    found = sizes.count()
    if not found:
        return None
    each = max(1, max_docs // found)
    # the choice needs ids alone, so only the chosen documents' texts move; by its hash each language sends some of its
    # ids, however many it has, and surely more than are wanted
    ids = usable.select(id_col, lang_col, (F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) / (1 << 31)).alias("_hash")).dropna()
    some = ids.join(F.broadcast(sizes), lang_col).filter(F.col("_hash") * F.col("_of") < 4 * each + 16).select(id_col, lang_col, "_hash").distinct()
    first = F.row_number().over(Window.partitionBy(lang_col).orderBy("_hash", id_col))
    chosen = some.withColumn("_n", first).filter(F.col("_n") <= each).select(id_col, lang_col)
    rows = usable.join(F.broadcast(chosen), [id_col, lang_col]).groupBy(id_col, lang_col).agg(F.min(text_col).alias(text_col)).collect()
    rows.sort(key=lambda r: (str(r[id_col]), r[text_col], r[lang_col]))
    rows = [(words_of(r[text_col]), r[lang_col]) for r in rows]
    languages = sorted({g for t, g in rows if t})
    if not languages:
        return None
    texts, gold = [t for t, _ in rows if t], [languages.index(g) for t, g in rows if t]
    return ChainField(languages, learn_lexicon(texts, gold, len(languages))).fit(texts, gold)


def label_words(model: ChainField, texts: list[list[str]]) -> list[np.ndarray]:
    """The distribution over the model's languages of each word of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [np.empty((0, len(model.languages)))] * len(texts)
    codes, kinds = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    got, _ = model.marginals(model.emissions(list(kinds))[codes], *chains(sizes))
    return np.split(got, np.cumsum(sizes)[:-1])


def predict(model: ChainField | None, texts: list[str]) -> Iterator[tuple[str, float]]:
    for lo, hi in groups_of([len(t) for t in texts], BLOCK_CHARS):
        words = [words_of(t) for t in texts[lo:hi]]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        parts = [w[k : k + PART] for w in words for k in range(0, len(w), PART)] if model else []
        total = np.zeros((len(words), len(model.languages) if model else 1))
        whose = np.repeat(np.arange(len(words)), [-(-len(w) // PART) for w in words]).tolist()
        for a, b in groups_of([len(p) for p in parts], PART):
            for i, p, m in zip(whose[a:b], parts[a:b], label_words(model, parts[a:b]), strict=True):
                total[i] += np.fromiter(map(len, p), dtype=np.float64, count=len(p)) @ m
        for w, t in zip(words, total, strict=True):
            if not w or model is None:
                yield UNDETERMINED, 0.0
                continue
            share = t / sum(map(len, w))
            yield model.languages[int(share.argmax())], float(min(1.0, share.max()))


def identify(docs: DataFrame, model: ChainField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score, per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = list(predict(model, b["t"].tolist()))
            yield pd.DataFrame({id_col: b[id_col], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]})

    return map_texts(docs, run, "lang_pred string, score double", id_col, text_col)


def label_code_switches(docs: DataFrame, model: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: its position, the word, its language and the marginal of that language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            for lo, hi in groups_of([len(t) for t in texts], BLOCK_CHARS):
                words = [words_of(t) for t in texts[lo:hi]]
                got = np.concatenate(label_words(model, words))
                sizes = [len(w) for w in words]
                yield pd.DataFrame({
                    id_col: b[id_col].iloc[lo:hi].repeat(sizes).to_numpy(), "position": [i for n in sizes for i in range(n)], "word": [x for w in words for x in w],
                    "lang": np.array(model.languages, dtype=object)[got.argmax(1)], "score": got.max(1),
                })

    return map_texts(docs, run, "position bigint, word string, lang string, score double", id_col, text_col)


def identify_languages(docs: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Fit without the held-out fold (checksum of the id modulo `folds` is `held`), label all documents."""
    model = fit_languages(docs.filter(crc_mod(id_col, folds) != held), id_col=id_col)
    return identify(docs, model, id_col=id_col).select(id_col, (crc_mod(id_col, folds) == held).alias("held_out"), "lang_pred", "score")
