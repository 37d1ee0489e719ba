"""Input rows of a compiler: for each question the candidate sources of its history, chosen without looking at the question, and the queries to come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.packing import admit


def frozen_vectors(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a retrieval cache knows of each history: ``sample_id, source_id, vector``, the last row's of each source, and ``sample_id, model``, the first that is given.

    ``cache``: sample_id, place (order of the rows), model (may be null), vectors (map of source id to vector, may be null).
    """
    each = cache.select("sample_id", "place", F.explode("vectors").alias("source_id", "vector"))
    vectors = each.groupBy("sample_id", "source_id").agg(F.max_by("vector", "place").alias("vector"))
    models = cache.where("model IS NOT NULL").groupBy("sample_id").agg(F.min_by("model", "place").alias("model"))
    return vectors, models


def history_sources(blocks: DataFrame, vectors: DataFrame, models: DataFrame, most: int, cap_tokens: int, input_limit: int) -> DataFrame:
    """``sample_id, id, source_id, text, token_count, vector, model``: the blocks of each history that its compiler sees, numbered from 1.

    ``blocks``: sample_id, turn_index, chunk_index, source_id, text, token_count, cost (of its part of a builder's input). In order of turn, chunk and id a block with a
    vector is taken while there are fewer than ``most`` and both sums stay within their caps; one that doesn't fit is passed over.
    """
    known = blocks.join(vectors, ["sample_id", "source_id"]).join(models, "sample_id").withColumn("one", F.lit(1))
    order = ["turn_index", "chunk_index", "source_id"]
    taken = admit(known, "sample_id", order, {"one": most, "token_count": cap_tokens, "cost": input_limit}).where("admitted").select("sample_id", *order)
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy(*order))  # at most ``most`` rows
    out = known.join(taken, ["sample_id", *order], "left_semi").withColumn("id", number)
    return out.select("sample_id", "id", "source_id", "text", "token_count", "vector", "model")


def compiler_rows(cache: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each row of the cache: ``sample_id, qa_id, question, sources, future_queries``.

    ``cache``: sample_id, qa_id, question; ``sources``: as of :func:`history_sources`; ``questions``: sample_id, qa_id, answer, category. The sources of a history are
    gathered once and joined to its questions. A question that the list lacks has no answer and category. A history without any source raises.
    """
    items = F.struct("id", "source_id", "text", "token_count", "vector")
    lists = sources.groupBy("sample_id").agg(F.array_sort(F.collect_list(items), lambda a, b: F.sign(a["id"] - b["id"]).cast("int")).alias("sources"))
    rows = cache.select("sample_id", "qa_id", F.coalesce("question", F.lit("")).alias("question")).join(questions, ["sample_id", "qa_id"], "left").join(lists, "sample_id", "left")
    missing = F.raise_error(F.concat(F.lit("no compiler sources selected for "), F.col("sample_id").cast("string"), F.lit(" / "), F.col("qa_id").cast("string")))
    whole = F.when(F.col("sources").isNull(), missing.cast(lists.schema["sources"].dataType)).otherwise(F.col("sources"))
    return rows.select("sample_id", "qa_id", "question", whole.alias("sources"), F.array(F.struct("question", "answer", "category")).alias("future_queries"))
