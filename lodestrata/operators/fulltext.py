"""Full-text search: an inverted index with positions, boolean and phrase queries, BM25 ranks.

The score of a text is the sum over the query's terms of max(ln((N - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 /
(f + 1.2 * (0.25 + 0.75 * D / avg D)): f occurrences in the text of D words, n of N texts with the term. A phrase and a
prefix are one term each, and a term of one column occurs in that column alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci, words
from lodestrata.operators.search import limited
from lodestrata.session import checkpoint

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NOT_WORD = r"[^\p{L}\p{N}]"


def index(docs: DataFrame, key: str, columns: list[str], also: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): postings (key, col, token, tf, positions); a text's length counts all its columns.

    also: columns that a key decides and that both tables keep.
    """
    own = [key, *(also or [])]
    parts = [docs.select(*own, F.lit(c).alias("col"), F.posexplode(words(F.col(c))).alias("pos", "token")) for c in columns]
    tokens = reduce(DataFrame.unionByName, parts)
    postings = tokens.groupBy(*own, "col", "token").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, tokens.groupBy(*own).agg(F.count("*").alias("n_words"))


def parse(query: str) -> list[dict]:
    """Terms of a query: words, "phrases", prefix*, col:word; ValueError for what isn't balanced or empty."""
    if query.count('"') % 2:
        raise ValueError("unbalanced quote")
    terms = []
    for col, phrase, word, star in re.findall(r'(?:(\w+):)?(?:"([^"]*)"|([^\s":*]+)(\*)?)', query):
        parts = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if parts:
            terms.append({"col": col or None, "words": parts, "prefix": bool(star)})
    if not terms:
        raise ValueError("empty query")
    return terms


def scores(postings: DataFrame, lengths: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score, n_terms) of the texts that hold any of the words. Statistics cover all texts."""
    tf = postings.filter(F.col("token").isin(*(terms or [""]))).groupBy(key, "token").agg(F.sum("tf").alias("f"))
    df = tf.groupBy("token").agg(F.count("*").alias("d"))  # a row a term
    st = lengths.agg(F.count("*").alias("nn"), F.avg("n_words").alias("a"))  # one row
    idf = F.greatest(F.ln((F.col("nn") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_words") / F.col("a")))
    hits = tf.join(F.broadcast(df), "token").join(lengths, key).join(F.broadcast(st))
    return hits.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))


def bm25(postings: DataFrame, lengths: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score) of the texts that hold all the words."""
    return scores(postings, lengths, key, terms).filter(F.col("n_terms") == len(set(terms))).select(key, "score")


def _occurrences(postings: DataFrame, key: str, term: dict) -> DataFrame:
    """(key, f): how often the words stand in a row in one column; a starred last word is a prefix."""
    own = postings if term["col"] is None else postings.filter(F.lower("col") == term["col"].lower())
    if len(term["words"]) == 1:
        word = term["words"][0]
        hit = own.filter(F.col("token").startswith(word) if term["prefix"] else F.col("token") == word)
        return hit.groupBy(key).agg(F.sum("tf").alias("f"))
    out = None
    for i, w in enumerate(term["words"]):
        last = term["prefix"] and i == len(term["words"]) - 1
        hit = own.filter(F.col("token").startswith(w) if last else F.col("token") == w)
        at = hit.select(key, "col", F.explode("positions").alias("p")).select(key, "col", (F.col("p") - i).alias("p")).distinct()
        out = at if out is None else out.join(at, [key, "col", "p"])
    return out.groupBy(key).agg(F.count("*").alias("f"))


def term_score(hits: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, score) of the texts that hold one term f times. Statistics cover all texts."""
    one = hits.agg(F.count("*").alias("d")).join(F.broadcast(lengths.agg(F.count("*").alias("nn"), F.avg("n_words").alias("a"))))  # one row each
    idf = F.greatest(F.ln((F.col("nn") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_words") / F.col("a")))
    return hits.join(lengths, key).join(F.broadcast(one)).select(key, part.alias("score"))


def match(docs: DataFrame, key: str, columns: list[str], query: str, limit: int | None = None, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All of the query's terms, best rank first; a query that can't be parsed falls back to containment.

    stored: postings and lengths that were written before; without them the texts are scanned. Only the postings of the
    query's words go on, in one selection for all of them.
    """
    try:
        terms = parse(query)
    except ValueError:
        hit = reduce(Column.__or__, [contains_ci(F.col(c), query) for c in columns])
        return limited(docs.filter(hit).select(key, F.lit(0.0).alias("score")).orderBy(key), limit)
    postings, lengths = stored or index(docs, key, columns)
    if stored is None:  # the query's words and the lengths come from one pass over the texts
        postings, lengths = selected(docs, key, columns, terms)
    ranked = None
    for t in terms:
        one = term_score(_occurrences(postings, key, t), lengths, key)
        ranked = one if ranked is None else ranked.join(one.withColumnRenamed("score", "more"), key).select(key, (F.col("score") + F.col("more")).alias("score"))
    return limited(ranked.orderBy(F.desc("score"), key), limit)


def selected(docs: DataFrame, key: str, columns: list[str], terms: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms' words, lengths of all texts), without exploding other words."""
    exact = sorted({w for t in terms for w in (t["words"][:-1] if t["prefix"] else t["words"])})
    starts = sorted({t["words"][-1] for t in terms if t["prefix"]})
    wanted = lambda w: reduce(Column.__or__, [w.startswith(x) for x in starts], w.isin(*exact) if exact else F.lit(False))
    made = docs.select(key, *[F.coalesce(words(F.col(c)), F.array().cast("array<string>")).alias(f"_{i}") for i, c in enumerate(columns)])
    numbered = lambda i: F.filter(F.transform(f"_{i}", lambda w, p: F.struct(p.alias("pos"), w.alias("token"))), lambda x: wanted(x["token"]))
    size = reduce(Column.__add__, [F.size(f"_{i}") for i in range(len(columns))])
    # one pass over the texts, of which only the wanted words and the lengths are kept
    made = checkpoint(made.select(key, size.cast("bigint").alias("n_words"), *[numbered(i).alias(f"_{i}") for i in range(len(columns))]))
    tokens = reduce(DataFrame.unionByName, [made.select(key, F.lit(c).alias("col"), F.explode(f"_{i}").alias("x")).select(key, "col", "x.*") for i, c in enumerate(columns)])
    postings = tokens.groupBy(key, "col", "token").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, made.select(key, "n_words").filter("n_words > 0")


def phrase_scan(docs: DataFrame, text: str, phrase: list[str]) -> DataFrame:
    """Texts with the words of a phrase in a row, without an index."""
    gap = f"{NOT_WORD}+"
    return docs.filter(F.col(text).rlike(f"(?i)(^|{NOT_WORD}){gap.join(map(re.escape, phrase))}({NOT_WORD}|$)"))
