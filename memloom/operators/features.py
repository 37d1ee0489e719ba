"""Feature rows of candidate sources: vectors, their context, standardised numbers, missing flags, speaker one-hot, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.retrieval import unit

# The numeric features in order, each with the fields it is read from.
NUMERIC = {
    "position": ["position", "position_in_session"],
    "token_count": ["token_count"],
    "age_days": ["relative_time_days"],
    "retrieval_score": ["retrieval_score", "score"],
    "bm25_rank": ["bm25_rank"],
    "dense_rank": ["dense_rank"],
    "rrf_score": ["rrf_score", "retrieval_score", "score"],
    "cosine_similarity": ["cosine_similarity"],
}


def number(value: Column) -> Column:
    """A finite double, or null: of truth values, of text that is no number, of NaN and infinities."""
    parsed = value.try_cast("double")
    usable = (F.typeof(value) != "boolean") & ~value.cast("string").rlike(r"[dDfF]\s*$") & (F.abs(parsed) < F.lit(float("inf")))
    return F.when(usable, parsed)


def numbers(rows: DataFrame, now: str | None = None) -> Column:
    """Array of the numeric features, null where missing. The first field that holds a value counts; fields that ``rows`` lacks are null.

    Without an age in days, it is taken from ``now`` and ``time`` or ``session_datetime`` (timestamps).
    """
    have = set(rows.columns)
    first = lambda fields: F.coalesce(*(F.col(x) for x in fields if x in have)) if have & set(fields) else F.lit(None).cast("double")
    found = {name: number(first(fields)) for name, fields in NUMERIC.items()}
    then = [x for x in ("time", "session_datetime") if x in have]
    if now and then:
        seconds = F.unix_micros(F.col(now)) - F.unix_micros(first(then))
        found["age_days"] = F.coalesce(found["age_days"], seconds / F.lit(86400e6))
    return F.array(*found.values())


def vector_problem(vector: str, dimension: int) -> Column:
    """``missing`` or ``invalid`` (another size, a component that is null or not finite, length zero); null for a usable vector."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    some = F.exists(vector, lambda x: x != 0)
    return F.when(F.col(vector).isNull(), "missing").when((F.size(vector) != dimension) | ~finite | ~some, "invalid")


def _usable(vector: str, dimension: int, name: str) -> Column:
    """The unit vector; an unusable one raises, as its row must not train or be scored."""
    problem = vector_problem(vector, dimension)
    return F.when(problem.isNull(), unit(F.col(vector))).otherwise(F.raise_error(F.concat(problem, F.lit(f" {name}"))).cast("array<double>"))


def fit(rows: DataFrame) -> DataFrame:
    """One row: ``means``, ``scales`` (population deviation, at least 1e-6; 0 and 1 for a column without values) and sorted ``speakers``.

    ``rows``: numbers (array), speaker. Speakers are categories, a bounded set.
    """
    at = lambda i: F.get("numbers", F.lit(i))
    mean = [F.coalesce(F.avg(at(i)), F.lit(0.0)) for i in range(len(NUMERIC))]
    scale = [F.when(F.count(at(i)) > 0, F.greatest(F.stddev_pop(at(i)), F.lit(1e-6))).otherwise(1.0) for i in range(len(NUMERIC))]
    return rows.agg(F.array(*mean).alias("means"), F.array(*scale).alias("scales"), F.array_sort(F.collect_set(F.nullif("speaker", F.lit("")))).alias("speakers"))


def centroids(rows: DataFrame, dimension: int) -> DataFrame:
    """``unit, centroid``: the mean of each unit's ``v``, of length 1. Means are taken in parts before the shuffle, so large units are no hot keys."""
    means = rows.select("unit", F.posexplode("v").alias("at", "x")).groupBy("unit", "at").agg(F.avg("x").alias("x"))
    mean = means.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("mean")).select("unit", F.col("mean.x").alias("mean"))
    return mean.select("unit", _usable("mean", dimension, "query vector").alias("centroid"))


def transform(rows: DataFrame, fitted: DataFrame, dimension: int, budget: float = 4096.0, budget_scale: float = 4096.0) -> DataFrame:
    """Adds ``features`` (doubles, 4 dimension + 2 numbers + speakers + 2 long) to rows (unit, embedding, query_vector, numbers, speaker).

    In order: the vector v, its context c, v * c, |v - c|, numbers standardised (0 if missing), missing flags,
    one-hot of the speaker (place 0: unknown), budget. c is the query's vector, or the unit's centroid without one.
    Unusable vectors raise. Repeated rows give repeated rows; an empty table none.
    """
    v = rows.withColumn("v", _usable("embedding", dimension, "source vector"))
    placed = v.join(centroids(v, dimension), "unit")
    context = F.when(F.col("query_vector").isNull(), F.col("centroid")).otherwise(_usable("query_vector", dimension, "query vector"))
    # one row of known size: a scalar subquery, no join
    placed = placed.withColumn("c", context).withColumn("_fit", fitted.select(F.struct("means", "scales", "speakers")).scalar())
    standard = F.transform("numbers", lambda x, i: F.coalesce((x - F.get("_fit.means", i)) / F.get("_fit.scales", i), F.lit(0.0)))
    missing = F.transform("numbers", lambda x: F.when(x.isNull(), 1.0).otherwise(0.0))
    place = F.coalesce(F.array_position("_fit.speakers", F.col("speaker")), F.lit(0))
    one_hot = F.transform(F.sequence(F.lit(0), F.size("_fit.speakers")), lambda i: F.when(i == place, 1.0).otherwise(0.0))
    product, difference = F.zip_with("v", "c", lambda a, b: a * b), F.zip_with("v", "c", lambda a, b: F.abs(a - b))
    features = F.concat("v", "c", product, difference, standard, missing, one_hot, F.array(F.lit(budget / max(budget_scale, 1.0))))
    return placed.withColumn("features", features).drop("v", "c", "centroid", "_fit")
