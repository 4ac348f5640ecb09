"""Edit distances, name suggestions and the scoring of extended data types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci

# Endings that names add to a root, in the order in which they are tried; only the first is removed.
SUFFIXES = ("Id", "Ids", "No", "Num", "Number", "Name", "Account", "Amount", "Code", "Key", "Value")
# Confidences of equal names, of the root as a name, of equal roots, of containment, of a contained root;
# the similarity where the fuzzy band begins, its least confidence and its slope; the least root that is looked for.
EXACT, ROOT, ROOTS, CONTAINED, ROOT_CONTAINED = 1.0, 0.90, 0.85, 0.70, 0.60
SIMILAR, FUZZY, SLOPE, LEAST_ROOT = 0.55, 0.40, 0.8, 3


def distance(a: Column, b: Column | str) -> Column:
    """Levenshtein distance without regard to case."""
    return F.levenshtein(F.lower(a), F.lower(b if isinstance(b, Column) else F.lit(b)))


def similarity(a: Column, b: str) -> Column:
    longest = F.greatest(F.length(a), F.lit(len(b))).cast("double")
    return F.lit(1.0) - distance(a, b) / longest


def root_of(name: Column) -> Column:
    """The lower-cased name without the first ending of the list that it has; a name that is only an ending stays."""
    low = F.lower(name)
    cut = [F.when(low.endswith(x.lower()) & (F.length(low) > len(x)), F.substring(low, F.lit(1), F.length(low) - len(x))) for x in SUFFIXES]
    return F.coalesce(*cut, low)


def rank_by_distance(names: DataFrame, needle: str, col: str = "name", limit: int = 5) -> DataFrame:
    """The nearest distinct names, ties by name."""
    return names.select(col).distinct().withColumn("dist", distance(F.col(col), needle).cast("bigint")).orderBy("dist", col).limit(limit)


def suggest_names(objects: DataFrame, kind: str, needle: str, limit: int = 5, pool: int = 50) -> DataFrame:
    """Names of a kind that contain the needle, else those that contain its first three letters, nearest first."""
    own = objects.filter(F.col("kind") == kind).select("name").distinct()
    whole = own.filter(contains_ci(F.col("name"), needle)).withColumn("branch", F.lit(0))
    part = own.filter(contains_ci(F.col("name"), needle[:3])).withColumn("branch", F.lit(1))
    found = whole.orderBy("name").limit(pool).unionByName(part.orderBy("name").limit(pool))
    best = found.agg(F.min("branch").alias("best"))  # one row
    return found.join(F.broadcast(best), F.col("branch") == F.col("best")).select("name", distance(F.col("name"), needle).alias("dist")).orderBy("dist", F.lower("name"), "name").limit(limit)


def type_confidence(name: Column, field: str) -> Column:
    """Confidence that a field of this name has the type `name`: the first rung of the ladder that holds."""
    low, target = F.lower(name), F.lower(F.lit(field.strip()))
    root, own = root_of(F.lit(field.strip())), root_of(name)
    band = F.bround(F.lit(FUZZY) + (similarity(name, field.strip()) - SIMILAR) * SLOPE, 2)
    return (
        F.when(low == target, EXACT).when(low == root, ROOT).when(own == root, ROOTS)
        .when(target.contains(low) | low.contains(target), CONTAINED)
        .when((F.length(root) >= LEAST_ROOT) & (low.contains(root) | root.contains(low)), ROOT_CONTAINED)
        .when(similarity(name, field.strip()) >= SIMILAR, band).otherwise(0.0)
    )


def suggest_types(types: DataFrame, field: str, limit: int = 5, col: str = "name", least: float = FUZZY) -> DataFrame:
    """Types of least confidence `least` for a field name, best first; all types are scored. A blank name has none."""
    scored = types.select(col, type_confidence(F.col(col), field or "").alias("conf"))
    return scored.filter((F.col("conf") >= least) & F.lit(bool((field or "").strip()))).orderBy(F.desc("conf"), F.lower(col), col).limit(limit)


# ---------------------------------------------------------------- names for a table of needles


def _shortened(low: Column, most: int) -> Column:
    """Hashes of a text without any `most` or fewer of its characters, most being 1 or 2."""
    length = F.length(low)

    def without(i: Column, j: Column) -> Column:
        """Without the characters i < j, counted from 1; 0 is none."""
        left = F.when(i > 0, F.substring(low, F.lit(1), i - 1)).otherwise("")
        return F.xxhash64(F.concat(left, F.substring(low, i + 1, j - i - 1), F.substring(low, j + 1, length)))

    one = F.transform(F.sequence(F.lit(0), length), lambda j: without(F.lit(0), j))
    if most == 1:
        return F.array_distinct(one)
    first = F.when(length > 1, F.sequence(F.lit(1), length - 1)).otherwise(F.array().cast("array<int>"))
    two = F.flatten(F.transform(first, lambda i: F.transform(F.sequence(i + 1, length), lambda j: without(i, j))))
    return F.array_distinct(F.concat(one, two))


def near_pairs(names: DataFrame, needles: DataFrame, most: int, name_col: str, needle_col: str) -> DataFrame:
    """(needle, wanted, name, low) of the pairs that may be near, lower-cased too; all that are near are among them.

    An equi-join over deletions: texts at most `most` edits apart have a text in common that is left when each loses at
    most that many characters. What all names share, such as a beginning, is a part of every such text and joins none. Either
    side has hundreds of rows a name, which Spark's estimate does not know; it must not send one of them whole by way of
    the driver, so the join is a merge of both.
    """
    if most not in (1, 2):
        raise ValueError("deletions are made for distances of 1 and 2")
    own = names.select(F.col(name_col).alias("name")).dropna().distinct().withColumn("low", F.lower("name"))
    asked = needles.select(F.col(needle_col).alias("needle")).dropna().distinct().withColumn("wanted", F.lower("needle"))
    own, asked = own.select("*", F.explode(_shortened(F.col("low"), most)).alias("rest")), asked.select("*", F.explode(_shortened(F.col("wanted"), most)).alias("rest"))
    return asked.hint("merge").join(own, "rest").select("needle", "wanted", "name", "low").distinct()


def within_distance(names: DataFrame, needles: DataFrame, most: int = 2, name_col: str = "name", needle_col: str = "needle") -> DataFrame:
    """(needle, name, dist) of all pairs of distinct needles and names whose distance, without regard to case, is `most` or less."""
    pairs = near_pairs(names, needles, most, name_col, needle_col)
    return pairs.withColumn("dist", F.levenshtein("wanted", "low", most)).filter("dist >= 0").select("needle", "name", "dist")


def suggest_many(names: DataFrame, needles: DataFrame, most: int = 2, limit: int = 5, name_col: str = "name", needle_col: str = "needle") -> DataFrame:
    """The nearest names of each needle within a distance, with their rank: by distance, ties by name."""
    order = Window.partitionBy("needle").orderBy("dist", F.lower("name"), "name")
    return within_distance(names, needles, most, name_col, needle_col).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
