"""Edge cases whose semantics are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.operators import blocks, certify, domain, packing, policy, retrieval, state, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunks_of_196_words_at_256_tokens(spark):
    text = " ".join(f"w{i}" for i in range(197))
    assert [len(x.split()) for x in one(spark, t.budget_chunks(F.lit(text), 256))] == [196, 1]
    assert one(spark, t.budget_chunks(F.lit(""), 256)) == [""]


def test_token_counts_and_scores(spark):
    assert one(spark, t.approx_tokens(F.lit(""))) == 1
    assert one(spark, t.lexical_score(F.lit("..."), F.lit("a b"))) == 0
    assert one(spark, t.normalize_answer(F.lit("The cat, and a Dog!"))) == "cat dog"
    assert one(spark, t.token_f1(F.lit("x x y"), F.lit("x y y"))) == pytest.approx(2 / 3)
    assert one(spark, t.exact_match(F.lit("red red blue"), F.lit("Blue red."))) == 1.0
    assert one(spark, t.multi_answer_f1(F.lit("red, blue"), F.lit("blue, green"))) == 0.5
    assert one(spark, t.multi_answer_f1(F.lit(""), F.lit("blue"))) == 0
    assert one(spark, t.category_score(F.lit(5), F.lit("It is Not Mentioned here"), F.lit(""))) == 1
    assert one(spark, t.category_score(F.lit(3), F.lit("red"), F.lit("red; because"))) == 1
    with pytest.raises(Exception, match="category"):
        one(spark, t.category_score(F.lit(9), F.lit("x"), F.lit("x")))


def test_evidence_is_canonical(spark):
    assert one(spark, blocks.canonical_evidence(F.lit("D01:003; D2:5 D:2:5"))) == ["D1:3", "D2:5"]


def test_an_item_that_fits_after_one_that_does_not_is_taken(spark):
    items = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 4, 1])], "u int, at int, cost long")
    got = {r["at"]: r.admitted for r in packing.admit(items, "u", ["at"], {"cost": 10}).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_repeated_query_tokens_count_twice_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(10, "red fox"), (9, "red fox"), (3, "blue")], "source_id long, text string")
    once = retrieval.bm25(spark.createDataFrame([(1, "red")], "question_id long, text string"), docs)
    twice = retrieval.bm25(spark.createDataFrame([(1, "red red")], "question_id long, text string"), docs)
    a, b = ({r.source_id: r.score for r in x.collect()} for x in (once, twice))
    assert b[9] == pytest.approx(2 * a[9])
    assert [r.source_id for r in retrieval.top_k(once, 5, "question_id").orderBy("rank").collect()] == [10, 9]  # "10" < "9"


@pytest.mark.parametrize(("size", "itself"), [(2048, True), (5, False)])
def test_blocks_of_questions_find_what_pairs_do_and_make_no_row_a_pair(spark, monkeypatch, size, itself):
    import random

    random.seed(6)
    monkeypatch.setattr(retrieval, "BLOCK", size)
    text = lambda: " ".join(f"w{int(random.paretovariate(0.7)) % 90}" for _ in range(random.randint(0, 25)))
    rows = [(s, 100 * s + i, text()) for s in range(3) for i in range(40)]
    rows += [(s, i + 50, t) for s, i, t in rows[::4]] + [(3, 400, "alone"), (3, 401, ""), (4, 500, None)]
    docs = spark.createDataFrame(rows, "sample int, source_id long, text string").repartition(3)
    asked = docs.where("source_id % 3 = 0 OR sample > 2").withColumnRenamed("source_id", "question_id")
    top = lambda blocks: {tuple(r) for r in retrieval.bm25_top_k(asked, docs, 4, "sample", itself=itself, blocks=blocks).select("sample", "question_id", "source_id", "rank", F.round("score", 6)).collect()}
    found = top(True)
    assert found == top(False) and len(found) > 200
    best = retrieval.bm25_blocks(asked, docs, 4, "sample", itself=itself)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan
    assert all(" q#" in x.split(")")[0] for x in plan.split("hashpartitioning(sample#")[1:])  # never by the sample alone
    words = docs.withColumn("source_id", F.concat(F.lit("d"), "source_id")), asked.withColumn("question_id", F.concat(F.lit("d"), "question_id"))
    named = retrieval.bm25_top_k(words[1], words[0], 4, "sample", itself=itself, blocks=True).select("sample", "question_id", "source_id", "rank")
    assert {tuple(r) for r in named.collect()} == {(s, f"d{q}", f"d{d}", rank) for s, q, d, rank, _ in found}
    whole = lambda blocks: {tuple(r) for r in retrieval.bm25_top_k(asked.drop("sample"), docs.drop("sample"), 2, blocks=blocks).select("question_id", "source_id", "rank").collect()}
    assert whole(True) == whole(False)


def test_recall_without_evidence_is_one(spark):
    asked = spark.createDataFrame([(1,), (2,)], "question_id long")
    evidence = spark.createDataFrame([(1, 5), (1, 6)], "question_id long, source_id long")
    found = spark.createDataFrame([(1, 5)], "question_id long, source_id long")
    assert {r.question_id: r.recall for r in retrieval.recall(evidence, found, asked).collect()} == {1: 0.5, 2: 1.0}


def test_null_sessions_are_equal_in_structures_and_never_near_in_context(spark):
    nodes = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, None)], "unit int, id int, session int")
    assert [(r.parent, r.child) for r in structure.tree(nodes).orderBy("child").collect()] == [(1, 2), (1, 3)]
    assert structure.graph(nodes).count() == 0
    assert [r.name for r in structure.cluster(nodes).orderBy("group_index").collect()] == ["7", "__unknown__"]
    base = spark.createDataFrame([(1, 3, 1)], "unit int, n int, base long")
    sources = spark.createDataFrame([(1, 1, None, 0, 0), (1, 2, None, 1, 5), (1, 3, None, 2, 9)], "unit int, id int, session int, position int, score int")
    assert [r.id for r in domain.context(base, sources).orderBy("place").collect()] == [3, 2]  # by score: nobody is near


def test_clusters_sort_names_as_strings(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 10)], "unit int, id int, session int")
    assert [r.name for r in structure.cluster(nodes).orderBy("group_index").collect()] == ["10", "2"]


def test_a_set_is_unreachable_if_a_prefix_is(spark):
    sets = spark.createDataFrame([(1, 2, 3), (1, 2, 0)], "unit int, n int, mask long")
    costs = spark.createDataFrame([(1, [50, 10])], "unit int, costs array<long>")
    priced = domain.with_cost(sets, costs)
    got = {r.mask: (r.cost, r.ok) for r in priced.select("mask", "cost", domain.reachable(F.lit(100)).alias("ok")).collect()}
    assert got == {3: (60, False), 0: (0, True)}  # the first source alone costs 50 and the surcharge


def test_audits_and_guarded_totals(spark):
    assert one(spark, certify.worst(F.lit("PASS"), F.lit("UNKNOWN"), F.lit("FAIL"))) == "FAIL"
    assert one(spark, certify.worst(F.lit("PASS"), F.lit("UNKNOWN"))) == "UNKNOWN"
    rows = spark.createDataFrame([(1, 5), (1, None), (2, 3)], "k int, v long")
    assert {r.k: r.s for r in rows.groupBy("k").agg(certify.guarded_sum(F.col("v")).alias("s")).collect()} == {1: None, 2: 3}
    assert rows.where("k = 9").agg(certify.guarded_sum(F.col("v")).alias("s")).first().s == 0


def test_journal_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 4, 0), ("b", 5, 0)], "k string, at int, ok int")
    got = {r.k: r["at"] for r in state.merge_journal(rows, ["k"], "at", F.col("ok") == 1).collect()}
    assert got == {"a": 2, "b": 5}
    got = {r.k: (r.place, r.ok, r.version) for r in state.upsert(rows, "k", "at", "ok").collect()}
    assert got == {"a": (1, 0, 3), "b": (4, 0, 2)}


@pytest.mark.parametrize("shortlist", [0, 2, 8])
def test_candidates_are_those_of_the_reference(spark, shortlist):
    n, requirements, scores = 7, [[0b1, 0b10], [0b110, 0b1000]], [3, 1, 4, 1, 5, 9, 2]
    units = spark.createDataFrame([(1, n, requirements)], "unit long, n long, requirements array<array<long>>")
    sources = spark.createDataFrame([(1, i + 1, None, i, x) for i, x in enumerate(scores)], "unit long, id long, session long, position long, score long")
    bases = domain.bases(units)
    got = {r.mask: (r.kind, r.base) for r in domain.candidates(bases, domain.context(bases, sources), shortlist, units).collect()}
    full, outside = 0b1111111, 0b1110000
    expected = {full: ("full", full)}
    ids = lambda mask: [i + 1 for i in range(n) if mask >> i & 1]
    made = sorted({a | b for a in requirements[0] for b in requirements[1]}, key=ids)
    extras = {b: sorted((i for i in range(n) if not b >> i & 1), key=lambda i: (-scores[i], i))[:shortlist] for b in made}
    for b in made:
        for pick in range(1 << len(extras[b])):
            expected.setdefault(b | sum(1 << i for k, i in enumerate(extras[b]) if pick >> k & 1), ("shortlist", b))
        expected.setdefault(b | outside, ("outside", b))
    assert got == expected


def test_units_of_63_and_64_sources_and_an_error_above(spark):
    schema = "unit long, n long, requirements array<array<long>>"
    units = spark.createDataFrame([(1, 63, [[1]]), (2, 64, [[1], [-(1 << 63)]])], schema)
    sources = spark.createDataFrame([(u, i, None, i, 0) for u, n in ((1, 63), (2, 64)) for i in range(1, n + 1)], "unit long, id long, session long, position long, score long")
    bases = domain.bases(units)
    rows = domain.candidates(bases, domain.context(bases, sources), 1, units).withColumn("ids", domain.ids_of("mask")).collect()
    assert {(r.unit, r.kind, tuple(r.ids)) for r in rows if r.kind == "full"} == {(1, "full", tuple(range(1, 64))), (2, "full", tuple(range(1, 65)))}
    assert {(r.unit, tuple(r.ids)) for r in rows if r.kind == "shortlist"} == {(1, (1,)), (1, (1, 2)), (2, (1, 64)), (2, (1, 2, 64))}
    with pytest.raises(Exception, match="at most 64"):
        domain.bases(spark.createDataFrame([(1, 65, [[1]])], schema)).collect()
    with pytest.raises(Exception, match="at most 64"):
        policy.prefixes(spark.createDataFrame([(1, 65, [9] * 65)], "unit long, n long, costs array<long>"), 10).collect()


def test_prefixes_of_64_sources_grow_under_the_budget_and_the_beam_goes_to_the_end(spark):
    schema = "unit long, n long, costs array<long>"
    sets = policy.prefixes(spark.createDataFrame([(1, 64, [10] * 64)], schema), 20)
    assert sets.count() == sets.select("mask").distinct().count() == 1 + 64 + 64 * 63 // 2
    actions = policy.action_logps(sets, F.lit(0.0), F.lit(0.0))
    assert policy.sequence_logps(sets, actions).agg(F.sum(F.exp("logp")).alias("x")).first().x == pytest.approx(1)
    sets = policy.prefixes(spark.createDataFrame([(1, 10, [1] * 10)], schema), 10).persist()
    actions = policy.action_logps(sets, F.expr("-10D * id"), F.lit(-200.0)).persist()
    assert policy.beam(actions, sets, width=1).first().mask == 1023
