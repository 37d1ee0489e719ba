"""Candidate sets of sources as bit masks: products of support packages, context, reachability, bounds.

A unit has at most 64 sources, id i being bit i - 1; a larger one raises an error. Masks are never compared as numbers. Units hold a
bounded number of masks, and only masks go through shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: SQL of the sorted ids in a mask of a unit of n sources.
IDS = "filter(sequence(1, int(n)), i -> (shiftright({mask}, i - 1) & 1) = 1)"

#: SQL of the mask of all sources of a unit of n sources, and of n sources at most.
FULL = "if(n = 64, -1L, ~shiftleft(-1L, int(n)))"
CHECKED = "if(n > 64, raise_error(concat('a unit has at most 64 sources, unit ', unit, ' has ', n)), {value})"


#: Sources of a unit at most.
MOST = 64


def unit_status(units: DataFrame, full_costs: DataFrame, limit: int) -> DataFrame:
    """``unit, n, full_cost, status``: ``ok``, ``too_many_sources`` or ``over_input_limit``. Only units that are ok have a domain.

    ``full_costs``: unit, full_cost (of all sources together).
    """
    status = F.when(F.col("n") > MOST, "too_many_sources").when(F.col("full_cost") > limit, "over_input_limit").otherwise("ok")
    return units.select("unit", "n").join(full_costs, "unit").select("unit", "n", "full_cost", status.alias("status"))


def ids_of(mask: str) -> Column:
    """The sorted ids in a mask; the frame has ``n``."""
    return F.expr(IDS.format(mask=mask))


def bases(units: DataFrame) -> DataFrame:
    """``unit, n, base``: every union of one package per requirement, each once.

    ``units``: unit, n, ``requirements`` (array of arrays of package masks).
    """
    fold = f"aggregate({CHECKED.format(value='requirements')}, array(0L), (acc, packages) -> array_distinct(flatten(transform(acc, a -> transform(packages, m -> a | m)))))"
    return units.select("unit", "n", F.explode(F.expr(fold)).alias("base"))


def context(base_sets: DataFrame, sources: DataFrame, holds: str = "(shiftright(base, int(id - 1)) & 1) = 1") -> DataFrame:
    """Sources outside each base in order: of a session of the base first, nearest, best score, id.

    ``sources``: unit, id, session (null belongs to none), position, score. ``holds``: SQL of the condition that a base holds an id. Returns unit, n, base, id, place (from 1).
    """
    extras = base_sets.join(sources, "unit").where(f"NOT ({holds})")
    inside = base_sets.join(sources.select("unit", "id", "session", F.col("position").alias("at")), "unit").where(holds).drop("id", "n")
    near = extras.join(inside, ["unit", "base", "session"]).groupBy("unit", "base", "id").agg(F.min(F.abs(F.col("position") - F.col("at"))).alias("distance"))
    ranked = extras.join(near, ["unit", "base", "id"], "left")
    order = Window.partitionBy("unit", "base").orderBy(F.col("distance").isNull(), "distance", F.col("score").desc(), "id")
    return ranked.select("unit", "n", "base", "id", F.row_number().over(order).cast("long").alias("place"))


def candidates(base_sets: DataFrame, ordered: DataFrame, shortlist: int, units: DataFrame) -> DataFrame:
    """``unit, n, mask, kind, base``: the full set, each base with any subset of its first extras, and with all sources in no package.

    ``units``: unit, n, ``requirements``, as the bases were made from.
    A set that several ways make keeps the first: full, then bases by their ids, for each shortlist before outside.
    """
    full = base_sets.select("unit", "n").distinct().select("unit", "n", F.expr(FULL).alias("mask"), F.lit(1).alias("priority"), F.expr(FULL).alias("base"))
    bit = F.expr("shiftleft(1L, int(id - 1))")
    first = ordered.where(F.col("place") <= shortlist).groupBy("unit", "base").agg(F.array_sort(F.collect_list(bit)).alias("bits"))
    short = base_sets.join(first, ["unit", "base"], "left").withColumn("bits", F.coalesce("bits", F.expr("cast(array() AS array<bigint>)")))
    subs = F.explode(F.expr("sequence(0L, shiftleft(1L, size(bits)) - 1)")).alias("pick")
    picked = "aggregate(sequence(0, greatest(size(bits) - 1, 0)), base, (m, i) -> m | if((shiftright(pick, i) & 1) = 1, coalesce(get(bits, i), 0L), 0L))"
    short = short.select("unit", "n", "base", "bits", subs).select("unit", "n", F.expr(picked).alias("mask"), F.lit(2).alias("priority"), "base")
    support = units.select("unit", F.expr("aggregate(flatten(requirements), 0L, (s, m) -> s | m)").alias("support"))
    rest = F.expr(f"base | ({FULL} & ~support)")
    outside = base_sets.join(support, "unit").select("unit", "n", rest.alias("mask"), F.lit(3).alias("priority"), "base")
    made = full.unionByName(short).unionByName(outside).withColumn("base_ids", ids_of("base"))
    best = made.groupBy("unit", "n", "mask").agg(F.min(F.struct((F.col("priority") > 1).alias("partial"), "base_ids", "priority", "base")).alias("w"))
    return best.select("unit", "n", "mask", F.element_at(F.array(F.lit("full"), F.lit("shortlist"), F.lit("outside")), F.col("w.priority")).alias("kind"), F.col("w.base").alias("base"))


#: Surcharge of a set of one source, so that costs do not simply grow along a prefix.
SINGLE = 60


def with_cost(sets: DataFrame, costs: DataFrame, ids: str = IDS.format(mask="mask")) -> DataFrame:
    """Adds ``prefix_costs``, the cost of each prefix of the sorted ids, and ``cost`` (0 for the empty set).

    ``costs``: unit, ``costs`` (array by id). ``ids``: SQL of the sorted ids of a set.
    """
    steps = f"aggregate({ids}, named_struct('sum', 0L, 'all', cast(array() AS array<bigint>)), (s, i) -> named_struct('sum', s.sum + get(costs, int(i - 1)), 'all', array_append(s.all, s.sum + get(costs, int(i - 1)) + if(size(s.all) = 0, {SINGLE}L, 0L))), s -> s.all)"
    priced = sets.join(costs, "unit").withColumn("prefix_costs", F.expr(steps))
    return priced.withColumn("cost", F.coalesce(F.expr("get(prefix_costs, size(prefix_costs) - 1)"), F.lit(0))).drop("costs")


def reachable(budget: Column) -> Column:
    """Whether every prefix of the sorted ids costs at most the budget."""
    return F.forall("prefix_costs", lambda c: c <= budget)


def covers(mask: str = "mask") -> Column:
    """Whether a set holds a package of every requirement."""
    return F.expr(f"forall(requirements, packages -> exists(packages, m -> (m & {mask}) = m))")


def bounds(evaluated: DataFrame, *keys: str) -> DataFrame:
    """Cost bounds over reachable sets: ``cost, status`` (PASS, FAIL, UNKNOWN, or null for unseen).

    lower: cheapest set that may pass; upper: cheapest that does; gap and closed from both; null where there is none.
    """
    out = evaluated.groupBy(*keys).agg(
        F.min(F.when(F.coalesce(F.col("status") != "FAIL", F.lit(True)), F.col("cost"))).alias("lower"),
        F.min(F.when(F.col("status") == "PASS", F.col("cost"))).alias("upper"),
        F.count_if(F.col("status").isNull()).alias("unseen"),
        F.count_if(F.col("status") == "UNKNOWN").alias("unknown"),
    )
    return out.withColumns({"gap": F.col("upper") - F.col("lower"), "closed": F.coalesce(F.col("upper") == F.col("lower"), F.lit(False))})


def evaluation_order(sets: DataFrame, most: int, partial: str = f"mask <> {FULL}", ids: str = IDS.format(mask="mask")) -> DataFrame:
    """The first ``most`` sets of each unit with their ``place`` (from 1): the full set, then by cost, then by ids. ``partial``, ``ids``: SQL of whether a set is not the full one, and of its sorted ids."""
    order = Window.partitionBy("unit").orderBy(F.expr(partial), "cost", "_ids")
    placed = sets.withColumn("_ids", F.expr(ids)).withColumn("place", F.row_number().over(order).cast("long"))
    return placed.where(F.col("place") <= most).drop("_ids")


def architecture_choice(solutions: DataFrame, budget: int, *more: str) -> DataFrame:
    """``unit, mask, conservative_cost`` (the dearest architecture's) and ``feasible``, the architectures within the budget in order; the empty set is Flat only. ``more``: further columns that tell sets apart."""
    allowed = (F.col("cost") <= budget) & ((F.col("mask") != 0) | (F.col("architecture") == "Flat"))
    return solutions.groupBy("unit", "mask", *more).agg(F.max("cost").alias("conservative_cost"), F.array_sort(F.collect_set(F.when(allowed, F.col("architecture")))).alias("feasible"))


def utility_of(status: Column) -> Column:
    """1 for PASS, 0 for UNKNOWN, -1 for FAIL; any other status raises."""
    return F.when(status == "PASS", 1.0).when(status == "UNKNOWN", 0.0).when(status == "FAIL", -1.0).otherwise(F.raise_error(F.lit("unknown status")).cast("double"))


def architecture_gain(solutions: DataFrame, *more: str) -> DataFrame:
    """``unit, mask, gain``: utility of a set's best architecture over that of Flat. ``more``: further columns that tell sets apart."""
    rows = solutions.withColumn("_u", utility_of(F.col("status")))
    return rows.groupBy("unit", "mask", *more).agg((F.max("_u") - F.max(F.when(F.col("architecture") == "Flat", F.col("_u")))).alias("gain"))


def first_of_archives(solutions: DataFrame) -> DataFrame:
    """One row for each (unit, architecture, mask): of the first ``archive`` that holds it."""
    others = [c for c in solutions.columns if c not in ("unit", "architecture", "mask")]
    best = solutions.groupBy("unit", "architecture", "mask").agg(F.min_by(F.struct(*others), "archive").alias("row"))
    return best.select("unit", "architecture", "mask", "row.*")


def label_check(rows: DataFrame, *keys: str) -> DataFrame:
    """Per training row: its labels, those that are no verified PASS, and whether it is usable: some labels, all verified. ``rows``: keys, status, label (boolean)."""
    bad = F.col("label") & F.coalesce(F.col("status") != "PASS", F.lit(True))
    out = rows.groupBy(*keys).agg(F.count_if("label").alias("labels"), F.count_if(bad).alias("unverified"))
    return out.withColumn("usable", (F.col("labels") > 0) & (F.col("unverified") == 0))


def train_selection(checked: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The first ``limit`` usable rows of :func:`label_check` in an order of several keys, all of them without a limit.

    A row with a label that isn't verified raises where it stands before the last row that is taken; rows without labels are passed over. Keys of the order tell rows apart.
    """
    key = F.struct(*order)
    taken = checked.where("usable").orderBy(*order)
    taken = taken if limit is None else taken.limit(limit)
    last = taken.agg(F.max(key).alias("_last"), F.count(F.lit(1)).alias("_n"))
    bad = checked.where("unverified > 0").agg(F.min(key).alias("_bad"))
    reached = F.col("_bad").isNotNull() & (F.lit(limit is None) | (F.col("_n") < F.lit(limit or 0)) | (F.col("_bad") < F.col("_last")))
    wrong = F.when(reached, F.raise_error(F.concat(F.lit("training labels lack verified audits: "), F.to_json("_bad"))).cast("boolean")).otherwise(F.lit(True))
    fine = last.join(bad).select(wrong.alias("_fine"))  # one row each
    return taken.join(F.broadcast(fine)).where("_fine").drop("_fine")
