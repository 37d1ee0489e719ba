"""Screening before costly builds: salience of source units, gates of candidate sets, topic blocks, and what a choice was worth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from memloom.operators.features import vector_problem
from memloom.operators.retrieval import unit
from memloom.sources.scratch import drop, materialize


#: Units of a block, and (term, session) pairs of a block of sessions: a task holds one of each.
UNITS, HELD = 16_384, 4_000_000
#: Words whose frequency is known to every task at most.
FREQUENT = 1 << 17


def _hashed(words: str) -> Column:
    """The distinct hashes of an array of strings, none for null."""
    return F.array_distinct(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w)))


def _counted(units: pa.Table, held: pa.Table) -> pa.Table:
    """``batch, id, strength`` of the units of a block: the sessions of a block that hold one of their terms, their own left out."""
    if not units.num_rows or not held.num_rows:
        return units.select(["batch", "id"]).append_column("strength", pa.array(np.zeros(units.num_rows, np.int64)))
    flat = lambda column: (column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]))
    order = np.argsort(names := held["term"].to_numpy(), kind="stable")
    names = names[order]
    sessions, ends = flat(held["sessions"])
    known, place = np.unique(sessions, return_inverse=True)
    terms, at = flat(units["terms"])
    found = np.minimum(np.searchsorted(names, terms), len(names) - 1)
    row = np.where(names[found] == terms, order[found], -1)
    own = units["session"].to_numpy()
    mine = np.minimum(np.searchsorted(known, own), len(known) - 1)
    mark, out = np.zeros(len(known), bool), np.zeros(units.num_rows, np.int64)
    for u in range(units.num_rows):
        rows = row[at[u] : at[u + 1]]
        for r in rows[rows >= 0]:
            mark[place[ends[r] : ends[r + 1]]] = True
        out[u] = np.count_nonzero(mark) - (known[mine[u]] == own[u] and mark[mine[u]])
        mark[:] = False
    return units.select(["batch", "id"]).append_column("strength", pa.array(out))


def strengths(units: DataFrame) -> DataFrame:
    """Adds ``strength``: the other sessions of the batch that hold one of a unit's terms.

    ``units``: batch, session, id, terms (array of strings, or of their hashes). Terms and sessions go as hashes. Units of a batch are dealt into blocks and its sessions into blocks of a bounded number of
    (term, session) pairs; each pair of blocks is a task's work, which returns a row a unit: what moves grows with the terms of units, never with the sessions that hold them.
    """
    hashed = units.select("batch", "id", F.xxhash64("session").alias("session"), (F.col("terms") if units.schema["terms"].dataType.elementType == LongType() else _hashed("terms")).alias("terms"))
    pairs = hashed.select("batch", "session", F.explode("terms").alias("term")).distinct()
    sizes = hashed.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / F.lit(UNITS)).cast("int").alias("_q"), F.ceil((F.sum(F.size("terms")) + 1) / F.lit(HELD)).cast("int").alias("_s"))
    sizes = materialize(sizes, "sizes")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = pairs.join(sizes, "batch").withColumn("s", F.pmod("session", F.col("_s")).cast("int")).groupBy("batch", "s", "term", "_q", "_s").agg(F.collect_list("session").alias("sessions"))
    held = held.where((F.size("sessions") > 1) | (F.col("_s") > 1)).select("batch", blocks("_q").alias("q"), "s", "term", "sessions")
    dealt = hashed.join(sizes, "batch").withColumn("q", F.pmod(F.xxhash64("id"), F.col("_q")).cast("int")).select("batch", "q", blocks("_s").alias("s"), "id", "session", "terms")
    kind = f"batch {units.schema['batch'].dataType.simpleString()}, id {units.schema['id'].dataType.simpleString()}, strength long"
    counted = dealt.groupBy("batch", "q", "s").cogroup(held.toDF(*held.columns).groupBy("batch", "q", "s")).applyInArrow(_counted, kind)
    found = counted.groupBy("batch", "id").agg(F.sum("strength").alias("strength"))
    return units.join(found, ["batch", "id"], "left").withColumn("strength", F.coalesce("strength", F.lit(0)).cast("long"))


def frequent_words(sets: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The words (hashes, ascending) that most of the ``set``s hold, about ``most`` and not more, and the place of each from 1, the rarest first.

    Words are counted by powers of their frequency first, so that no task sends more of them than are wanted.
    """
    size = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    rows = sets.select(F.explode("set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(rows.withColumn("size", size), "frequencies")
    sizes = sorted(rows.groupBy("size").count().collect(), reverse=True)  # a few hundred at most
    total = np.cumsum([r["count"] for r in sizes])
    taken = [r.size for r, n in zip(sizes, total, strict=True) if n <= most]
    found = rows.where(F.col("size") >= min(taken)).select("word", "n").collect() if taken else []  # ``most`` at most
    drop(rows)
    words, n = np.array([r.word for r in found], np.int64), np.array([r.n for r in found], np.int64)
    place = np.empty(len(words), np.int32)
    place[np.lexsort((words, n))] = np.arange(1, len(words) + 1)
    order = np.argsort(words)
    return words[order], place[order]


def with_prefixes(sets: DataFrame, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``sets`` (``set``: sorted word hashes) with ``n``, ``prefix`` and ``parity`` instead of ``set``.

    Of two sets as similar as ``similarity`` the first words of each, in any one order of all words, must share one: ``prefix``. The order has the words first that aren't
    frequent, then the others, the rarest first. ``parity``: for each of 256 classes of words whether the set holds an odd number; two sets differ in as many words at least as in classes.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequent)
    others = [c for c in sets.columns if c != "set"]

    def run(batches):
        words, places = shared.value
        for batch in batches:
            column = batch.column(batch.schema.names.index("set"))
            flat, n = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy()
            row, rank = np.repeat(np.arange(len(n)), n), np.zeros(len(flat), np.int32)
            if len(words):
                found = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                rank = np.where(words[found] == flat, places[found], 0)
            order = np.lexsort((flat, rank, row))
            # so many words of a set may be missing in the other one, and one more is surely shared
            length = np.where(n > 0, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1, 0)
            starts = np.cumsum(n) - n
            first = np.arange(len(flat)) - np.repeat(starts, n) < np.repeat(length, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat[order][first]))
            odd = (np.bincount(row * 256 + (flat & 255), minlength=256 * len(n)) & 1).astype(bool)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 4, pa.int32()), pa.array(np.packbits(odd.reshape(len(n), 256), axis=1).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in others), pa.array(n.astype(np.int32)), prefix, parity], names=[*others, "n", "prefix", "parity"])

    kind = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in others)
    return sets.mapInArrow(run, f"{kind}, n int, prefix array<long>, parity array<long>")


def _with_sets(units: DataFrame) -> DataFrame:
    """Adds ``set``: the sorted hashes of a unit's words."""
    return units.withColumn("set", F.array_sort(_hashed("words")))


def near_copies(units: DataFrame, similarity: float) -> DataFrame:
    """``batch, id`` of units that are near copies of an earlier one (by ``time``, then id) of their batch: the Jaccard similarity of their ``words`` is at least ``similarity``.

    ``units``: batch, id, time, words (array of strings). Two units without words are copies. Only word hashes move: units of equal word sets are one class; of two classes as
    similar as that the first words of each must share one (prefix filter), the smaller has at least that share of the larger's words (length filter), and few classes of words
    may differ (parity filter). Pairs that any filter refuses leave no join; the sets of the others are fetched.
    """
    sets = _with_sets(units).select("batch", "time", "id", "set")
    marked = with_prefixes(sets.withColumn("class", F.xxhash64("set")), similarity, frequent_words(sets))
    return _near_copies(materialize(marked, "marked"), sets, similarity)


def _near_copies(marked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Near copies among the rows of ``marked`` (batch, time, id, class, n, prefix, parity). ``sets``: batch, id, set of these and maybe others."""
    first = marked.groupBy("batch", "class").agg(F.min(F.struct("time", "id")).alias("first"), *(F.any_value(c).alias(c) for c in ("n", "prefix", "parity")))
    first = materialize(first, "classes")
    bits = [F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(4)]
    keyed = first.select("batch", "class", "n", *bits, F.explode("prefix").alias("word"))
    a, b = keyed.alias("a"), keyed.alias("b")
    size = F.col("a.n") + F.col("b.n")
    apart = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(1, 4)), F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))))
    alike = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-9) & (apart <= size * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)
    meet = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.class") < F.col("b.class")) & alike)
    pairs = materialize(meet.select(F.col("a.batch").alias("batch"), F.col("a.class").alias("x"), F.col("b.class").alias("y")).distinct(), "pairs")
    wanted = pairs.select("batch", F.explode(F.array("x", "y")).alias("class")).distinct().join(first.select("batch", "class", "first"), ["batch", "class"])
    # rows that repeat an id may hold other words: those of the class are taken
    whole = sets.join(wanted.select("batch", "class", "first", F.col("first.id").alias("id")), ["batch", "id"]).where(F.xxhash64("set") == F.col("class"))
    whole = materialize(whole.groupBy("batch", "class").agg(F.any_value("set").alias("set"), F.any_value("first").alias("first")), "sets")
    side = lambda x: whole.select("batch", F.col("class").alias(x), F.col("set").alias(f"{x}_set"), F.col("first").alias(f"{x}_first"))
    both = pairs.join(side("x"), ["batch", "x"]).join(side("y"), ["batch", "y"])
    shared = F.size(F.array_intersect("x_set", "y_set"))
    close = both.where(shared >= similarity * (F.size("x_set") + F.size("y_set") - shared) - 1e-9)
    close = materialize(close.select("batch", "x", "y", "x_first", "y_first"), "close")
    drop(pairs, whole)
    other = close.select("batch", F.col("x").alias("class"), F.col("y_first").alias("other")).unionByName(close.select("batch", F.col("y").alias("class"), F.col("x_first").alias("other")))
    earliest = other.unionByName(first.select("batch", "class", F.col("first").alias("other"))).groupBy("batch", "class").agg(F.min("other").alias("other"))
    return marked.select("batch", "time", "id", "class").join(earliest, ["batch", "class"]).where(F.col("other") < F.struct("time", "id")).select("batch", "id")


def salient(units: DataFrame, most: int, similarity: float | None = None) -> DataFrame:
    """The ``most`` units of each batch that go on: ``batch, session, id, time, strength``, chosen without a query.

    Of units of equal ``text`` (by SHA-256) in a batch the earliest stays; with ``similarity`` near copies of an earlier unit go, too (``units`` then has ``words``). Each session's strongest unit comes first, then the others by
    strength, then by ``time`` and id. A smaller batch goes on whole. Texts and words are read where they are needed, and never shuffled.
    """
    rows = units.withColumns({"_text": F.unhex(F.sha2("text", 256)), "terms": _hashed("terms")})
    names = ["batch", "session", "id", "time", "terms", "_text"]
    if similarity is None:
        marked, sets = rows.select(*names), None
    else:
        sets = _with_sets(units).select("batch", "id", "set")
        marked = with_prefixes(_with_sets(rows).select(*names, "set", F.xxhash64("set").alias("class")), similarity, frequent_words(sets))
    earliest = Window.partitionBy("batch", "_text").orderBy("time", "id")
    left = materialize(marked.withColumn("_n", F.row_number().over(earliest)).where("_n = 1").drop("_n", "_text"), "left")
    kept = left.select("batch", "session", "id", "time", "terms")
    if similarity is not None:
        kept = materialize(kept.join(_near_copies(left, sets, similarity), ["batch", "id"], "left_anti"), "kept")
        drop(left)
    once = strengths(kept)
    order = [F.col("strength").desc(), F.col("time"), F.col("id")]
    best = once.drop("terms").withColumn("_s", F.row_number().over(Window.partitionBy("batch", "session").orderBy(*order)) > 1)
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy("_s", *order))).where(F.col("_n") <= most).drop("_n", "_s")


def gate(covers: Column, cost: Column, budget: int, proxy: Column, least: float, status: Column, reachable: Column) -> Column:
    """The gate that ends a candidate (set, architecture), or ``admitted``.

    First what costs nothing: a need without a package, then the budget; then the mean of the proxy queries under the plainest
    build; last the full audit and the prefixes. An audit without a verdict is unknown.
    """
    verdict = F.lower(F.coalesce(status, F.lit("UNKNOWN")))
    return (
        F.when(~covers, "need").when(cost > budget, "budget").when(proxy < least, "proxy").when(verdict != "pass", verdict)
        .when(~reachable, "unreachable").otherwise("admitted")
    )


def replayed(gated: DataFrame, queries: int, proxies: int, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Per key: candidates, those admitted, those that a proxy lost, and evaluations without and with the gates.

    ``gated``: keys, mask, architecture, gate, would_pass (boolean: admitted without the proxy). A set is probed once, built Flat,
    if one of its architectures passes the free gates; its full audit under Flat takes the probe's answers over. ``more``: further columns that tell sets apart.
    """
    full = ~F.col("gate").isin("need", "budget", "proxy")
    sets = gated.groupBy(*keys, "mask", *more).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("gate").isin("need", "budget")).alias("probed"),
        F.count_if(full).alias("full"), F.count_if(full & (F.col("architecture") == "Flat")).alias("flat"), F.count_if(F.col("gate") == "admitted").alias("admitted"),
        F.count_if((F.col("gate") == "proxy") & F.col("would_pass")).alias("lost"),
    )
    cost = F.when(F.col("probed") > 0, proxies).otherwise(0) + F.col("full") * queries - F.when(F.col("flat") > 0, proxies).otherwise(0)
    return sets.groupBy(*keys).agg(
        F.sum("pairs").alias("candidates"), F.sum("admitted").alias("admitted"), F.sum("lost").alias("lost"),
        (F.sum("pairs") * queries).alias("evaluations_all"), F.sum(cost).cast("long").alias("evaluations_gated"),
    )


def first_choice(chosen: DataFrame, archive: DataFrame, *more: str) -> DataFrame:
    """Adds to the chosen solution of each unit ``successful`` (size of its archive), ``passed``, and ``excess``: relative cost over the cheapest, if it passed.

    ``chosen``: unit, mask, architecture. ``archive``: the passing solutions with cost. ``more``: further columns that tell sets apart.
    """
    best = archive.groupBy("unit").agg(F.min("cost").alias("_best"), F.count(F.lit(1)).alias("successful"))
    hit = archive.groupBy("unit", "mask", *more, "architecture").agg(F.min("cost").alias("_cost"))
    out = chosen.join(hit, ["unit", "mask", *more, "architecture"], "left").join(best, "unit", "left")
    excess = (F.col("_cost") - F.col("_best")) / F.greatest("_best", F.lit(1))
    return out.withColumns({"successful": F.coalesce("successful", F.lit(0)), "passed": F.col("_cost").isNotNull(), "excess": excess}).drop("_best", "_cost")


def topic_blocks(rows: DataFrame, dimension: int, k: int, seed: int = 7) -> DataFrame:
    """Adds ``block`` to rows (id, embedding): k-means over unit vectors. A block is named after its smallest id.

    Vectors that are missing or invalid get no block. No given number of blocks is sure to be filled; an empty table gives no rows.
    """
    usable = rows.where(vector_problem("embedding", dimension).isNull()).withColumn("_v", array_to_vector(unit(F.col("embedding"))))
    rest = rows.where(vector_problem("embedding", dimension).isNotNull())
    none = F.lit(None).cast(rows.schema["id"].dataType)
    if usable.isEmpty():
        return rest.withColumn("block", none)
    model = KMeans(featuresCol="_v", predictionCol="_k", k=k, seed=seed, maxIter=20).fit(usable)
    placed = model.transform(usable).drop("_v")
    names = placed.groupBy("_k").agg(F.min("id").alias("block"))
    return placed.join(F.broadcast(names), "_k").drop("_k").unionByName(rest.withColumn("block", none))
