"""Blocked nearest vectors and mean overlaps against all pairs."""

import numpy as np
import pytest

from memloom.operators import dense, retrieval


@pytest.mark.parametrize("block, itself", [(7, False), (4096, True)])
def test_blocks_give_the_same_best_as_all_pairs(spark, block, itself):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.standard_normal(5) if i % 3 else np.ones(5)  # many equal vectors: ties
        rows.append(("ab"[i % 10 == 0], i, [float(x) for x in v / np.linalg.norm(v)]))
    rows += [("c", 900, [1.0, 0.0])]
    sources = spark.createDataFrame(rows, "label string, source_id long, unit array<double>").repartition(3)
    asked = sources.where("source_id % 4 = 0").withColumnRenamed("source_id", "question_id")
    k = 4
    got = retrieval.top_k(dense.block_top_k(asked, sources, "label", k, itself, block), k, "question_id")
    want = set()
    for label, q, u in rows:
        if q % 4 == 0:
            found = sorted((-round(float(np.dot(u, v)), 9), str(s), s) for g, s, v in rows if g == label and (itself or s != q))[:k]
            want |= {(q, s, -score, rank) for rank, (score, _, s) in enumerate(found, 1)}
    assert {(r.question_id, r.source_id, r.score, r["rank"]) for r in got.collect()} == want


def test_mean_overlap_counts_pairs_that_share_nothing(spark):
    rows = [(1, 1, 10), (1, 1, 11), (1, 2, 11), (1, 2, 12), (1, 2, 12), (1, 3, 99), (2, 4, 10), (3, 5, 1), (3, 6, 1)]
    got = retrieval.mean_overlap(spark.createDataFrame(rows, "history long, question_id long, source_id long"), "history").collect()
    assert {r.history: (r.questions, r.pairs, r.mean_jaccard and round(r.mean_jaccard, 9)) for r in got} == {1: (3, 3, round(1 / 9, 9)), 2: (1, 0, None), 3: (2, 1, 1.0)}
