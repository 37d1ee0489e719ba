"""Ranking: BM25, dense cosine, reciprocal-rank fusion and recall.

Ranks break ties by the source id as a string. All of it is joins and aggregates: texts are tokenised
once, tokens that no question asks for go before any shuffle, a question is scored against the
documents that share a token with it only, and top k per question is a ranking window that Spark cuts
inside each task before the shuffle. Where fewer than k documents share a token, others follow with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import lexical_tokens
from memloom.sources.scratch import materialize

# Okapi parameters, and the fusion constant.
K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys, token, frequency, length`` of every document; ``docs`` has ``keys`` and ``text``."""
    tokens = docs.select(*keys, lexical_tokens(F.col("text")).alias("tokens"))
    return tokens.select(*keys, F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy(*keys, "length", "token").agg(F.count(F.lit(1)).alias("frequency"))


def document_frequency(found: DataFrame, *sample: str) -> DataFrame:
    """In how many documents each token stands, within each sample."""
    return found.groupBy(*sample, "token").agg(F.count(F.lit(1)).alias("df"))


def bm25(questions: DataFrame, docs: DataFrame, *sample: str, question_id: str = "question_id", source_id: str = "source_id") -> DataFrame:
    """Scores of the documents that share a token with a question, within the question's sample.

    ``questions``: sample, question_id, text. ``docs``: sample, source_id, text. A token that a question
    repeats counts each time. Returns sample, question_id, source_id, score.
    """
    if not sample:  # the whole corpus is one sample
        one = lambda frame: frame.withColumn("_sample", F.lit(0))
        return bm25(one(questions), one(docs), "_sample", question_id=question_id, source_id=source_id).drop("_sample")
    asked, found = _weights(questions, docs, *sample, question_id=question_id, source_id=source_id)
    pairs = found.join(asked, [*sample, "token"])
    return pairs.groupBy(*sample, question_id, source_id).agg(F.sum(F.col("repeats") * F.col("idf") * F.col("frequency") * F.lit(K1 + 1) / (F.col("frequency") + _scale())).alias("score"))


def _scale() -> Column:
    return F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("length") / F.greatest("avg_length", F.lit(1e-9)))


def _weights(questions: DataFrame, docs: DataFrame, *sample: str, question_id: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """``sample, question_id, token, repeats, idf, avg_length`` of the questions, and ``sample, source_id, token, frequency, length`` of the documents, of tokens that both have."""
    asked = materialize(postings(questions, *sample, question_id).select(*sample, question_id, "token", F.col("frequency").alias("repeats")), "asked")
    counts = materialize(asked_postings(docs, asked.select(*sample, "token").distinct(), *sample, source_id=source_id), "postings")
    lengths = counts.groupBy(*sample, source_id).agg(F.max("length").alias("length"))
    stats = lengths.groupBy(*sample).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    found = counts.where("token IS NOT NULL")
    # questions are few beside documents: where they are small Spark broadcasts them, and no token is a shuffle key
    weighed = materialize(asked.join(document_frequency(found, *sample), [*sample, "token"]).join(stats, list(sample)), "weighed")
    n, df = F.col("n_docs"), F.col("df")
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return weighed.withColumn("idf", idf), found


#: Questions and documents of a block.
BLOCK = 2048


def _best(k: int, itself: bool, sample: tuple[str, ...], question_id: str, source_id: str):
    def best(questions: pa.Table, docs: pa.Table) -> pa.Table:
        asked, ids = questions[question_id].to_numpy(zero_copy_only=False), docs[source_id].to_numpy(zero_copy_only=False)
        rows, sources, scores = [], [], []
        if len(asked) and len(ids):
            names = np.array([str(x) for x in ids.tolist()])
            flat = lambda column: (column.combine_chunks().flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]))
            items, at = flat(docs["items"])
            value = items.field("value").to_numpy(zero_copy_only=False)
            known, token = np.unique(items.field("token").to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(token, kind="stable")
            doc, value = np.repeat(np.arange(len(ids)), np.diff(at))[order], value[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(known)))])
            items, at = flat(questions["items"])
            wanted, weight = items.field("token").to_numpy(zero_copy_only=False), items.field("value").to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
            place = np.where(known[place] == wanted, place, -1) if len(known) else np.full(len(wanted), -1)
            for q, question in enumerate(asked.tolist()):
                tokens, own = place[at[q] : at[q + 1]], weight[at[q] : at[q + 1]]
                tokens, own = tokens[tokens >= 0], own[tokens >= 0]
                size = starts[tokens + 1] - starts[tokens]
                ends = np.cumsum(size)
                if not len(ends):
                    continue
                use = np.repeat(starts[tokens] - (ends - size), size) + np.arange(ends[-1])
                row = np.bincount(doc[use], np.repeat(own, size) * value[use], minlength=len(ids))
                met = row > 0
                if not itself:
                    met &= ids != question
                row = np.where(met, np.round(row, 9), -np.inf)
                hit = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                hit = hit[np.lexsort((names[hit], -row[hit]))][:k]
                hit = hit[row[hit] > -np.inf]
                rows.append(np.full(len(hit), q))
                sources.append(hit)
                scores.append(row[hit])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        rows = pa.array(join(rows, np.int64))
        columns = [questions[c].take(rows) for c in (*sample, question_id)] + [docs[source_id].take(pa.array(join(sources, np.int64))), pa.array(join(scores, np.float64))]
        return pa.table(columns, names=[*sample, question_id, source_id, "score"])

    return best


def bm25_blocks(questions: DataFrame, docs: DataFrame, k: int, *sample: str, itself: bool = True, question_id: str = "question_id", source_id: str = "source_id") -> DataFrame:
    """``sample, question_id, source_id, score``: for each question at least its k best documents of those that share a token with it, each block's own k.

    For many long questions, nearly all of which share a token with nearly all documents. Questions and documents of a sample are dealt into blocks, and each pair of blocks is
    one task's work; a row a question and document is never made. Tokens go as hashes, scores are rounded to 9 places, equal ones in order of the id as a string.
    """
    asked, found = _weights(questions, docs, *sample, question_id=question_id, source_id=source_id)
    item = lambda value: F.collect_list(F.struct(F.xxhash64("token").alias("token"), value.alias("value"))).alias("items")
    q = asked.groupBy(*sample, question_id).agg(item(F.col("repeats") * F.col("idf")))
    # tables of a row a sample are stored, so that their size is known: a join on the sample alone would deal all documents of a sample to one task
    average = materialize(asked.groupBy(*sample).agg(F.max("avg_length").alias("avg_length")), "averages")
    d = found.join(average, list(sample)).groupBy(*sample, source_id).agg(item(F.col("frequency") * F.lit(K1 + 1) / (F.col("frequency") + _scale())))
    # tokens in one order: equal documents get equal sums
    q, d = (materialize(x.withColumn("items", F.array_sort("items")), name) for x, name in ((q, "questions"), (d, "documents")))
    blocks = lambda rows, name: rows.groupBy(*sample).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
    sizes = materialize(blocks(q, "_q").join(blocks(d, "_d"), list(sample)), "sizes")
    placed = lambda rows, key, own, other: rows.join(sizes, list(sample)).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"_{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1))).drop("_q", "_d")
    left, right = placed(q, question_id, "q", "d"), placed(d, source_id, "d", "q")
    kind = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for x, c in (*((q, c) for c in sample), (q, question_id), (d, source_id)))
    return left.groupBy(*sample, "q", "d").cogroup(right.groupBy(*sample, "q", "d")).applyInArrow(_best(k, itself, sample, question_id, source_id), f"{kind}, score double")


def asked_postings(docs: DataFrame, vocabulary: DataFrame, *sample: str, source_id: str = "source_id") -> DataFrame:
    """``sample, source_id, length, token, frequency`` of the tokens of ``vocabulary`` (sample, token) in each document.

    Every document has a row: its other tokens are counted together under a null token. That happens inside the
    task that reads the document when the vocabulary is small enough for Spark to broadcast.
    """
    tokens = docs.select(*sample, source_id, lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    rows = tokens.select(*sample, source_id, F.size("tokens").alias("length"), F.explode_outer("tokens").alias("_token"))
    known = vocabulary.withColumnRenamed("token", "_token").withColumn("_asked", F.lit(True))
    rows = rows.join(known, [*sample, "_token"], "left").withColumn("token", F.when(F.col("_asked"), F.col("_token")))
    return rows.groupBy(*sample, source_id, "length", "token").agg(F.count(F.lit(1)).alias("frequency"))


def bm25_top_k(questions: DataFrame, docs: DataFrame, k: int, *sample: str, itself: bool = True, blocks: bool = False, question_id: str = "question_id", source_id: str = "source_id") -> DataFrame:
    """The k best documents of each question of its sample, those with score 0 included. ``itself``: a document may answer its own question. ``blocks``: questions are many and long, see :func:`bm25_blocks`.

    The first k + 1 unscored documents are among the first 2 k + 1 of the sample in order of the id as a string.
    """
    if not sample:
        one = lambda frame: frame.withColumn("_sample", F.lit(0))
        return bm25_top_k(one(questions), one(docs), k, "_sample", itself=itself, blocks=blocks, question_id=question_id, source_id=source_id).drop("_sample")
    other = F.lit(True) if itself else F.col(question_id) != F.col(source_id)
    names = {"question_id": question_id, "source_id": source_id}
    scored = bm25_blocks(questions, docs, k, *sample, itself=itself, **names) if blocks else bm25(questions, docs, *sample, **names).where(other)
    top = materialize(top_k(scored, k, *sample, question_id, source_id=source_id), "bm25")
    order = Window.partitionBy(*sample).orderBy(F.col(source_id).cast("string"))
    first = docs.select(*sample, source_id).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * k + 1).drop("_r")
    few = questions.select(*sample, question_id).join(top.groupBy(*sample, question_id).agg(F.count(F.lit(1)).alias("_n")), [*sample, question_id], "left").where(F.coalesce("_n", F.lit(0)) < k)
    more = few.drop("_n").join(first, list(sample)).where(other).join(top, [*sample, question_id, source_id], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(top.drop("rank").unionByName(more), k, *sample, question_id, source_id=source_id)


def top_k(scored: DataFrame, k: int, *question: str, source_id: str = "source_id", score: str = "score") -> DataFrame:
    """The k best sources of each question with their ``rank`` (long, from 1); scores are rounded to 9 places first."""
    scored = scored.withColumn(score, F.round(score, 9))
    order = Window.partitionBy(*question).orderBy(F.col(score).desc(), F.col(source_id).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda n, v: n + v)


def unit(a: Column) -> Column:
    """A float array in double precision, divided by its length."""
    double = F.transform(a, lambda x: x.cast("double"))
    # the length is bound to a variable: written inside the division it would be worked out for every component
    lengths = F.array(F.sqrt(dot(double, double)))
    return F.get(F.transform(lengths, lambda n: F.transform(double, lambda x: x / n)), F.lit(0))


def fuse(first: DataFrame, second: DataFrame, k: int, *question: str, source_id: str = "source_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (question, source_id, rank), cut to k."""
    part = lambda x: x.select(*question, source_id, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
    fused = part(first).unionByName(part(second)).groupBy(*question, source_id).agg(F.sum("part").alias("score"))
    return top_k(fused, k, *question, source_id=source_id)


def recall(evidence: DataFrame, found: DataFrame, questions: DataFrame, question_id: str = "question_id", source_id: str = "source_id") -> DataFrame:
    """Share of each question's evidence that was found; 1 for a question without evidence."""
    hits = evidence.join(found.select(question_id, source_id).distinct().withColumn("hit", F.lit(1)), [question_id, source_id], "left")
    shares = hits.groupBy(question_id).agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return questions.select(question_id).join(shares, question_id, "left").select(question_id, F.coalesce("share", F.lit(1.0)).alias("recall"))


def mean_overlap(retrieved: DataFrame, history: str, question: str = "question_id", source: str = "source_id") -> DataFrame:
    """``history, questions, pairs, mean_jaccard``: mean Jaccard similarity of what two questions of a history retrieve, over all its pairs.

    Pairs without a shared source count as 0 and are never made; only pairs that share one are, by source within the history. Null for a single question.
    """
    rows = retrieved.select(history, question, source).distinct()
    sizes = rows.groupBy(history, question).agg(F.count(F.lit(1)).alias("n"))
    a = rows.join(sizes, [history, question]).withColumnsRenamed({question: "_a", "n": "_na"})
    b = rows.join(sizes, [history, question]).withColumnsRenamed({question: "_b", "n": "_nb"})
    shared = a.join(b, [history, source]).where("_a < _b").groupBy(history, "_a", "_b", "_na", "_nb").agg(F.count(F.lit(1)).alias("_k"))
    sums = shared.groupBy(history).agg(F.sum(F.col("_k") / (F.col("_na") + F.col("_nb") - F.col("_k"))).alias("_sum"))
    counts = sizes.groupBy(history).agg(F.count(F.lit(1)).alias("questions")).withColumn("pairs", (F.col("questions") * (F.col("questions") - 1) / 2).cast("long"))
    return counts.join(sums, history, "left").withColumn("mean_jaccard", F.when(F.col("pairs") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("pairs"))).drop("_sum")
