"""Nearest vectors by blocks: groups of any size, partial top k where the products are made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 4096


def _blocked(rows: DataFrame, group: str, key: str, own: str, other: str, sizes: DataFrame, most: int) -> DataFrame:
    """``rows`` with their block ``own``, once for each block ``other`` of the other side. ``sizes``: group, n_own, n_other."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(most))).cast("int")
    placed = rows.join(sizes.withColumnsRenamed({f"n_{own}": "_n", f"n_{other}": "_m"}), group).withColumn(own, F.pmod(F.xxhash64(key), blocks("_n")).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), blocks("_m") - 1))).drop("_n", "_m")


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _best(k: int, itself: bool):
    def best(questions: pa.Table, sources: pa.Table) -> pa.Table:
        out = []
        if questions.num_rows and sources.num_rows:
            ids, asked = sources["source_id"].to_pylist(), questions["question_id"].to_pylist()
            names = np.array([str(x) for x in ids])
            scores = np.round(_matrix(questions["unit"], len(asked)) @ _matrix(sources["unit"], len(ids)).T, 9)
            for row, question in zip(scores, asked, strict=True):
                if not itself:
                    row = np.where(np.array([x == question for x in ids]), -np.inf, row)
                at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                at = at[np.lexsort((names[at], -row[at]))][:k]
                out += [(question, ids[i], float(row[i])) for i in at if row[i] > -np.inf]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"question_id": pa.array(columns[0], pa.int64()), "source_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return best


def block_top_k(questions: DataFrame, sources: DataFrame, group: str, k: int, itself: bool = False, block: int = BLOCK) -> DataFrame:
    """``question_id, source_id, score``: for each question at least its k best sources of its group by dot product, each block's own k.

    ``questions``: group, question_id, ``unit`` (array of doubles); ``sources``: group, source_id, unit; ids are longs and all vectors of a group have one length.
    Questions and sources of a group are dealt into blocks, and each pair of blocks is one task's product of two matrices; it returns k rows a question,
    not a row a pair. Scores are rounded to 9 places, equal ones in order of the id as a string. ``itself``: a source may answer its own question.
    """
    n = lambda rows, name: rows.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    sizes = n(questions, "n_q").join(n(sources, "n_s"), group)
    q = _blocked(questions.select(group, "question_id", "unit"), group, "question_id", "q", "s", sizes, block)
    s = _blocked(sources.select(group, "source_id", "unit"), group, "source_id", "s", "q", sizes, block)
    s = s.toDF(*s.columns)  # columns of its own: both sides may come of one table
    pairs = q.groupBy(group, "q", "s").cogroup(s.groupBy(group, "q", "s"))
    return pairs.applyInArrow(_best(k, itself), "question_id long, source_id long, score double")
