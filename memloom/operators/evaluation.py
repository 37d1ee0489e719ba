"""An evaluation of questions under several arms: which questions, what each arm sees, what is left to do, and paired results.

A run is a table of tasks (question, arm) minus those that a journal has completed. Results are appended a batch of tasks at a time, each by
Spark's commit of a whole job, so a run that ends in the middle leaves whole batches, and the next run does the rest once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.packing import admit
from memloom.operators.state import merge_journal

# The arms, in order.
ARMS = ("no_memory", "full_memory", "naive_rag", "rank_pack", "our")


def draw(key: Column, seed: int) -> Column:
    """A text to order by that is random to the eye and the same in every engine: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sampled(rows: DataFrame, most: int, key: str, seed: int, *strata: str) -> DataFrame:
    """``most`` rows of each stratum, or of all, without replacement: those whose draw by ``key`` comes first. Fewer rows stay all.

    Ranks are cut in every task before anything moves.
    """
    if not strata:
        return rows.orderBy(draw(F.col(key), seed), key).limit(most)
    order = Window.partitionBy(*strata).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def limited(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows in an order of several keys, numbered by ``place`` from 1; without a limit all rows, without number."""
    return rows if limit is None else rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def contexts(candidates: DataFrame, budget: int, most: int, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """``question, arm, sources, cost``: the ids of the sources that each arm reads, in order of their rank, and what they cost together.

    ``candidates``: question, source, rank (from 1; null: not retrieved), cost, chosen (by the selector). No memory reads nothing, the full memory and the plain
    retrieval all that was retrieved, rank packing whatever still fits in order of rank, our arm what was chosen. A question without candidates has empty contexts.
    An unknown or repeated arm raises ValueError.
    """
    if not arms or len(set(arms)) != len(arms) or any(a not in ARMS for a in arms):
        raise ValueError(f"arms must be different ones of {ARMS}")
    retrieved = F.col("rank").isNotNull()
    fits = admit(candidates.where(retrieved), "question", ["rank", "source"], {"cost": budget}).select("question", "source", F.col("admitted").alias("packed"))
    rows = candidates.join(fits, ["question", "source"], "left")
    reads = {"no_memory": F.lit(False), "full_memory": retrieved, "naive_rag": retrieved & (F.col("rank") <= most), "rank_pack": F.coalesce("packed", F.lit(False)), "our": F.coalesce("chosen", F.lit(False))}
    arm = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), reads[a].alias("reads")) for a in arms)))
    long = rows.select("question", "source", "rank", "cost", arm.alias("x")).select("question", "source", "rank", "cost", "x.*")
    item = F.when(F.col("reads"), F.struct(F.coalesce("rank", F.lit(1 << 60)).alias("rank"), "source"))
    out = long.groupBy("question", "arm").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.when(F.col("reads"), F.col("cost")).otherwise(0)).alias("cost"))
    return out.select("question", "arm", F.col("items.source").alias("sources"), "cost")


def tasks(questions: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Every question under every arm."""
    return questions.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))


def completed() -> Column:
    """Whether a journal row needs no other try: answered, no error, and all usage known."""
    return (F.col("status") == "ok") & F.col("error").isNull() & F.coalesce("usage_complete", F.lit(False))


def read_journal(session, path: str, schema: str) -> DataFrame:
    """All rows of a journal with ``try`` (the number of the run); a journal that isn't there has none."""
    try:
        return session.read.schema(f"{schema}, try long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return session.createDataFrame([], f"{schema}, try long")


def run(planned: DataFrame, keys: list[str], answer: Callable[[DataFrame], DataFrame], path: str, schema: str, number: int, batches: int = 8) -> int:
    """Answer the planned tasks that the journal at ``path`` hasn't completed, and append the rows. Returns how many batches had work.

    ``answer`` gives a row of ``schema`` for each task: keys, status, error, usage_complete and others. A batch holds the tasks of one hash, and is written as
    a whole or not at all; ``number`` tells the runs apart.
    """
    session, worked = planned.sparkSession, 0
    for b in range(batches):
        known = read_journal(session, path, schema).where(completed()).select(*keys).distinct()
        todo = planned.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == b).join(known, keys, "left_anti")
        if not todo.isEmpty():
            names = [field.name for field in session.createDataFrame([], schema).schema]
            answer(todo).select(*names).write.mode("append").parquet(f"{path}/try={number}")
            worked += 1
    return worked


def results(journal: DataFrame, keys: list[str]) -> DataFrame:
    """One row per task: its first completed one, else the last, with ``done``."""
    return merge_journal(journal, keys, "try", completed())


def paired_oracle(rows: DataFrame, keys: list[str], gold: str = "gold_oracle", full: str = "full_memory") -> DataFrame:
    """Per key: score and exact match of both arms, ``measured`` (neither call failed), and the tokens that the gold sources save.

    ``rows``: keys, arm, status, score, exact, tokens. A builder or agent error is no score of 0 but none at all, and takes its pair out; an empty memory is a measurement. A key
    that lacks an arm isn't measured.
    """
    known = ~F.col("status").isin("builder_error", "agent_error")
    one = lambda arm, x: F.max(F.when((F.col("arm") == arm) & known, F.col(x)))
    cost = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("tokens")))
    out = rows.groupBy(*keys).agg(one(gold, "score").alias("gold_score"), one(full, "score").alias("full_score"), one(gold, "exact").alias("gold_exact"), one(full, "exact").alias("full_exact"), cost(gold).alias("_g"), cost(full).alias("_f"))
    return out.withColumns({"measured": F.col("gold_score").isNotNull() & F.col("full_score").isNotNull(), "token_saving": F.when(F.col("_f") > 0, 1 - F.col("_g") / F.col("_f"))}).drop("_g", "_f")


def oracle_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs measured and unknown, and over the measured ones mean scores, exact matches and token saving (null without any)."""
    mean = lambda x: F.avg(F.when(F.col("measured"), F.col(x)))
    return pairs.agg(F.count_if("measured").alias("n"), F.count_if(~F.col("measured")).alias("unknown"), *(mean(x).alias(x) for x in ("gold_score", "full_score", "gold_exact", "full_exact", "token_saving")))
