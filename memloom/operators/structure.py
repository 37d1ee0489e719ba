"""Memory structures over the selected sources of a unit: chain, tree, graph, cluster, and their checks.

Input: ``unit, id`` (from 1, unique in the unit) and ``session`` (may be null). Null sessions equal each other here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _following(column: str):
    """The value of the next node of the unit."""
    return F.lead(column).over(Window.partitionBy("unit").orderBy("id"))


def chain(nodes: DataFrame) -> DataFrame:
    """An edge from each node to the next one."""
    return nodes.select("unit", F.col("id").alias("parent"), _following("id").alias("child")).where("child IS NOT NULL")


def tree(nodes: DataFrame) -> DataFrame:
    """An edge to each node but the first, from the nearest earlier node of its session, else from the first node."""
    before = F.lag("id").over(Window.partitionBy("unit", "session").orderBy("id"))
    root = F.min("id").over(Window.partitionBy("unit"))
    return nodes.select("unit", F.coalesce(before, root).alias("parent"), F.col("id").alias("child")).where("parent <> child")


def graph(nodes: DataFrame) -> DataFrame:
    """An edge between neighbours in id order that are of one session."""
    following = nodes.select("unit", F.col("id").alias("parent"), _following("id").alias("child"), "session", _following("session").alias("next_session"))
    return following.where("child IS NOT NULL AND session <=> next_session").select("unit", "parent", "child")


def cluster(nodes: DataFrame) -> DataFrame:
    """The ids of each session, sessions in order of their name as a string."""
    named = nodes.withColumn("name", F.coalesce(F.nullif(F.col("session").cast("string"), F.lit("")), F.lit("__unknown__")))
    groups = named.groupBy("unit", "name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("name")).cast("long")
    return groups.select("unit", place.alias("group_index"), "name", "ids")


def tree_reasons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Why the edges of a unit are no tree over its nodes, in order; an empty array if they are one.

    Edges run from smaller to larger ids in every structure made here, so a unit with one root and
    one parent for every other node has no cycle; an edge that does not is a reason of its own.
    """
    per_node = nodes.join(edges.select("unit", F.col("child").alias("id"), "parent"), ["unit", "id"], "left")
    per_node = per_node.groupBy("unit", "id").agg(F.count("parent").alias("parents"), F.max(F.col("parent") >= F.col("id")).alias("backward"))
    counts = per_node.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("parents").alias("edges"), F.count_if(F.col("parents") == 0).alias("roots"), F.max("parents").alias("most"), F.coalesce(F.bool_or("backward"), F.lit(False)).alias("backward"))
    reason = lambda bad, name: F.when(bad, F.lit(name))
    reasons = F.array_compact(F.array(reason(F.col("most") > 1, "several parents"), reason(F.col("edges") != F.col("n") - 1, "edge count"), reason(F.col("roots") != 1, "roots"), reason(F.col("backward"), "backward edge")))
    return counts.select("unit", reasons.alias("reasons"))


# The architectures of a structure.
ARCHITECTURES = ("Flat", "Chain", "Tree", "Graph", "Cluster")


def reasons(structures: DataFrame) -> DataFrame:
    """Adds ``reasons``: why a structure is not one of its architecture over its sources, each once in a fixed order; empty if it is.

    ``structures``: architecture, sources (array of ids, at most 64), nodes, edges (array of parent and child; a null end is no
    number), groups (array of arrays), declared (the architecture that the structure itself names, null for the same). Nodes
    and edges may be anything; a walk along parents takes as many steps as there are sources at most. Edges may also be arrays of numbers: those that
    aren't pairs are invalid.
    """
    given = structures.schema["edges"].dataType
    lists = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.ArrayType)
    pairs = "transform(filter(edges, e -> coalesce(size(e), 0) = 2), e -> named_struct('parent', e[0], 'child', e[1]))"
    structures = structures.withColumns({"_all": F.coalesce(F.size("edges"), F.lit(0)), "_given": F.col("edges")})
    if lists:
        structures = structures.withColumn("edges", F.expr(pairs))
    out = structures.withColumns({
        "_s": F.array_sort(F.array_distinct("sources")), "_n": F.expr("coalesce(nodes, cast(array() AS array<int>))"), "_g": F.expr("coalesce(groups, cast(array() AS array<array<int>>))"),
        "_e": F.expr("filter(coalesce(edges, cast(array() AS array<struct<parent: int, child: int>>)), e -> e.parent IS NOT NULL AND e.child IS NOT NULL)"),
    })
    children = "transform(_e, e -> e.child)"
    # of several parents the last one counts
    parent = "element_at(filter(_e, e -> e.child = {x}), -1).parent"
    # a walk that still has a parent after as many steps as there are sources goes in a circle
    walk = f"aggregate(_s, {{x}}, (x, _) -> if(size(filter(_e, e -> e.child = x)) > 0, {parent.format(x='x')}, NULL))"
    chain = "transform(sequence(1, size(_s) - 1), i -> named_struct('parent', get(_s, i - 1), 'child', get(_s, i)))"
    members = "flatten(transform(_g, g -> array_distinct(filter(g, x -> x IS NOT NULL))))"
    checks = [
        ("structure_nodes_not_integer", "exists(_n, x -> x IS NULL)"),
        ("structure_nodes_do_not_match_sources", "array_sort(array_distinct(filter(_n, x -> x IS NOT NULL))) <> _s"),
        ("structure_nodes_duplicate", "size(array_distinct(_n)) < size(_n)"),
        ("structure_architecture_mismatch", "coalesce(declared, architecture) <> architecture"),
        ("edge_invalid", "coalesce(size(edges), 0) < _all"),
        ("edge_not_integer", "size(_e) < size(edges)"),
        ("edge_self_loop", "exists(_e, e -> e.parent = e.child)"),
        ("edge_out_of_sources", "exists(_e, e -> NOT array_contains(_s, e.parent) OR NOT array_contains(_s, e.child))"),
        ("duplicate_edges", "size(array_distinct(_e)) < size(_e)"),
        ("flat_has_edges", "architecture = 'Flat' AND _all > 0"),
        ("chain_edges_not_ordered", f"architecture = 'Chain' AND _e <> if(size(_s) > 1, {chain}, cast(array() AS array<struct<parent: int, child: int>>))"),
        ("tree_multiple_parents", f"architecture = 'Tree' AND size(array_distinct({children})) < size(_e)"),
        ("tree_must_have_one_root", "architecture = 'Tree' AND size(_s) > 0 AND size(_e) <> size(_s) - 1"),
        ("tree_root_count", f"architecture = 'Tree' AND size(array_except(_s, {children})) <> if(size(_s) > 0, 1, 0)"),
        ("tree_cycle", f"architecture = 'Tree' AND exists(_s, x -> {walk.format(x='x')} IS NOT NULL AND size(filter(_e, e -> e.child = {walk.format(x='x')})) > 0)"),
        ("cluster_group_not_integer", "architecture = 'Cluster' AND exists(_g, g -> exists(g, x -> x IS NULL))"),
        ("cluster_empty_group", "architecture = 'Cluster' AND exists(_g, g -> size(g) = 0)"),
        ("cluster_groups_overlap", f"architecture = 'Cluster' AND size(array_distinct({members})) < size({members})"),
        ("cluster_groups_do_not_cover_sources", f"architecture = 'Cluster' AND array_sort(array_distinct({members})) <> _s"),
        ("non_cluster_group_mismatch", "architecture <> 'Cluster' AND size(_g) > 0 AND _g[0] <> _s"),
    ]
    every = F.array_compact(F.array(*(F.expr(f"CASE WHEN {condition} THEN '{name}' END") for name, condition in checks)))
    known = F.when(F.col("architecture").isin(*ARCHITECTURES), every).otherwise(F.raise_error(F.lit("unknown architecture")).cast("array<string>"))
    return out.withColumns({"reasons": known, "edges": F.col("_given")}).drop("_s", "_n", "_g", "_e", "_all", "_given")
