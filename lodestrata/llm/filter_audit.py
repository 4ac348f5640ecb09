"""Filter interaction audit: what each filter removes in every order of the filters, and its fair share.

A document fails some of the filters, and a set of filters (a coalition) removes what fails any of them. All that the
audit says follows from how many documents each coalition removes: 32 numbers a part for five filters.

1. Failures. Each document's failures are bits of one number; documents of one part, failure number and outcome are
   counted, so what moves on is small.
2. Coalitions. Of each part, how many documents every coalition removes, in all and of each outcome.
3. Steps. In an order of the filters a step removes what the coalition up to it removes and the one before doesn't.
4. Shares. The Shapley value is the solution of a least-squares problem: additive shares that fit all coalitions, each
   weighted by the Shapley kernel, under the constraint that they sum to what all filters remove. The normal equations
   with the constraint are solved in rationals, once for each coalition; a part's shares are then whole-number
   combinations of its counts, exact when multiplied by the number of orders.

Equal texts are found by their SHA-256 and least id. The rows with that id are found by a join on both, so a group of
copies, however large, is spread over the tasks by its ids.

Defined results: a null text is empty, and an empty text has no words. A null source is the part ''. Of equal texts all
but those of the least id fail E; null ids come after all others and don't make each other fail. Repeated rows count each. A document with
several labels has an outcome if one of them does; labels of null ids belong to nobody. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise

#: The filters, each by one letter.
FILTERS = "ABCDE"
#: A word; limits of the filters: words, percent of distinct words, percent of capitals; symbols.
WORD, LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = r"[^\x20\x09-\x0D]+", 200, 50, 2, r"[#$%&*|]"


def solve(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of a x = b in rationals, by elimination; b may have several columns."""
    rows = [[*x, *y] for x, y in zip(a, b, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i]:
                rows[k] = [v - rows[k][i] * w for v, w in zip(rows[k], rows[i], strict=True)]
    return [r[len(a) :] for r in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n players the weight of every coalition's value in its Shapley value times n!; coalitions are bit sets.

    Minimise over the shares x the sum over coalitions S, but the empty and the full one, of
    kernel(S) * (value(S) - sum of x in S) ** 2, where the x sum to the value of all: normal equations with a multiplier.
    """
    full = (1 << n) - 1
    size = [s.bit_count() for s in range(full + 1)]
    kernel = [Fraction(n - 1, comb(n, k) * k * (n - k)) if 0 < k < n else Fraction(0) for k in size]
    player = range(n)
    normal = [[sum((kernel[s] for s in range(full) if s >> i & s >> j & 1), Fraction(0)) for j in player] + [Fraction(1)] for i in player]
    right = [[kernel[s] * (s >> i & 1) for s in range(full + 1)] for i in player]
    shares = solve([*normal, [Fraction(1)] * n + [Fraction(0)]], [*right, [Fraction(int(s == full)) for s in range(full + 1)]])[:n]
    scaled = [[v * factorial(n) for v in row] for row in shares]
    assert all(v.denominator == 1 for row in scaled for v in row)
    return [[int(v) for v in row] for row in scaled]


def coalition_counts(failed: DataFrame, n: int, outcomes: list[str]) -> DataFrame:
    """part, total and for `gone` and each outcome an array: what each coalition removes, by its bit set.

    failed: part, mask (the filters that a document fails, as bits), n (documents) and a column of counts an outcome.
    """
    by_mask = failed.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *outcomes)])

    def removed(count: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(count)).otherwise(0)) for s in range(1 << n)])

    return by_mask.groupBy("part").agg(F.sum("n").alias("total"), removed("n").alias("gone"), *[removed(c).alias(c) for c in outcomes])


def audit(failed: DataFrame, filters: str, outcomes: list[str]) -> DataFrame:
    """All orders of the filters, step by step, in each part: see `coalition_counts` for the rows that it takes."""
    n = len(filters)
    if not 1 <= n <= 6:
        raise ValueError("an audit of all orders takes one to six filters")
    counts = coalition_counts(failed, n, outcomes)
    shares = [sum((F.col("gone")[s] * w for s, w in enumerate(row) if w), F.lit(0)) for row in shapley_weights(n)] if n > 1 else [F.col("gone")[1]]
    orders = F.lit(["".join(p) for p in permutations(filters)])
    rows = counts.select("*", F.array(*shares).alias("shares"), F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def members(steps: Column) -> Column:
        """The bit set of the filters in the first steps."""
        place = [F.instr("filter_order", f) for f in filters]
        return sum((F.when(p <= steps, 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))

    place = F.instr(F.lit(filters), F.substr("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.select("*", members(F.col("step")).alias("after"), members(F.col("step") - 1).alias("before"), place.alias("place"))
    bit, full = F.element_at(F.lit([1 << i for i in range(n)]), F.col("place") + 1), (1 << n) - 1
    at = lambda column, s: F.col(column)[s]
    removed = at("gone", F.col("after")) - at("gone", F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("gone", F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (at("gone", bit) - removed).alias("redundant"),
        (at("gone", F.lit(full)) - at("gone", F.lit(full) - bit)).alias("unique_fails"),
        *[(at(c, F.col("after")) - at(c, F.col("before"))).alias(c) for c in outcomes],
        at("shares", F.col("place")).alias("shapley"),
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, part, the failures as bits of `mask` and the number of such rows, for the five filters on texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    n_capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    failed = (n_words < LEAST_WORDS, 100 * n_distinct < LEAST_DISTINCT * n_words, 100 * n_capitals > MOST_CAPITALS * F.length("text"), F.col("text").rlike(SYMBOLS))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    each = materialise(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = each.groupBy("digest").agg(F.min("id").alias("first_id")).withColumnRenamed("digest", "first_digest").withColumn("is_first", F.lit(True))
    counted = each.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    known = counted.join(first, (F.col("digest") == F.col("first_digest")) & F.col("id").eqNullSafe(F.col("first_id")), "left")
    return known.select("id", "part", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(1 << len(failed)), "n").toDF("id", "part", "mask", "n")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The audit of the five filters by source, with the good and the toxic documents that each step takes."""
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    failed = failures(docs, id_col, text_col, source_col)
    failed = failed.join(marks, F.col("id") == F.col("label_id"), "left")
    lost = [(F.col("n") * F.coalesce(mark, F.lit(0))).alias(f"{mark}_lost") for mark in ("good", "toxic")]
    return audit(failed.select("part", "mask", "n", *lost), FILTERS, ["good_lost", "toxic_lost"])
