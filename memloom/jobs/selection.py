"""The selector network over conversations: turns are sources with a vector of the embeddings table each. Weights come from a seed, as training is not part of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import approx_tokens
from memloom.operators import domain, policy, selector
from memloom.operators.retrieval import unit
from memloom.operators.structure import ARCHITECTURES
from memloom.sources.scratch import materialize
from memloom.sources.tables import table

BUDGET, WIDTH = 300, 4
INPUTS = 8


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of at most 64 turns: token costs, eight numbers, a vector (some have none) and a session of each turn."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), (F.col("turn") + 1).alias("id"), "role", approx_tokens(F.col("text")).alias("cost"), F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(600)).alias("vec_id"))
    usable = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    rows = turns.join(usable.select("vec_id", unit(F.col("embedding")).alias("vector")), "vec_id", "left")
    numbers = F.expr("concat(array(cost / 100D, id / 8D, if(role = 'user', 1D, 0D), 1D), transform(sequence(0, 3), k -> coalesce(get(vector, k), 0D)))")
    session = F.expr("if(id % 5 = 0, NULL, string((id - 1) div 3))")
    items = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "cost", numbers.alias("features"), "vector", session.alias("session")))).alias("x")).where(F.col("n") <= domain.MOST)
    return items.select("unit", "n", F.col("x.cost").alias("costs"), F.col("x.features").alias("features"), F.col("x.vector").alias("vectors"), F.col("x.session").alias("sessions"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    weights = selector.random_weights(INPUTS)
    units = materialize(_units(spark, sf_dir), "units")
    sets = policy.prefixes(units.select("unit", "n", "costs"), BUDGET)
    return units, sets, selector.action_logps(sets, units, weights, BUDGET), weights


def selector_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of ending with each reachable set."""
    _, sets, actions, _ = _scored(spark, sf_dir)
    return policy.sequence_logps(sets, actions).select("unit", "mask", F.round("logp", 6).alias("logp"))


def selector_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set and the architecture that a beam and the architecture head choose together."""
    units, sets, actions, weights = _scored(spark, sf_dir)
    top = policy.best_sets(policy.completions(actions, sets, WIDTH), WIDTH).join(sets.select("unit", "mask", "cost"), ["unit", "mask"])
    dearer = [f"if(cost + {9 * k} * bit_count(mask) <= {BUDGET}, '{name}', NULL)" for k, name in enumerate(ARCHITECTURES)]
    feasible = F.expr(f"array_compact(array({', '.join(dearer)}))")
    found = selector.with_architecture(top.withColumn("feasible", feasible), units, weights, BUDGET)
    best = policy.best_set(found.withColumn("_joint", F.round("joint", 9)), "_joint")
    return best.select("unit", "mask", "architecture", F.round("joint", 6).alias("joint"))


QUERIES = {"selector_logps": (selector_logps, None), "selector_joint": (selector_joint, None)}
