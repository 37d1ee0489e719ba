"""The training-corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import line_dedup, ngram_jaccard, ordinal_quality, packing, quality_rules
from memloom.llm.columns import set_aside
from memloom.llm.queries import byte_bpe
from memloom.sources.scratch import materialize
from memloom.sources.tables import spread, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is high enough."""
    return ordinal_quality.kept_documents(spread(docs), table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a rule of the table rejects."""
    return quality_rules.kept_documents(spread(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that nothing but repeated lines made up go."""
    clear, back = set_aside(spread(docs), ["n_dropped_lines"])
    out = line_dedup.dedup_lines(clear)
    out = out.where("n_dropped_lines = 0 OR text RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return ngram_jaccard.one_of_each_group(spread(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences of 1024 tokens."""
    return packing.pack(spread(docs), byte_bpe(), end_id=0, capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_deduplication),
    ("packing", sequence_packing),
]

#: SQL expresses neither the classifier nor the tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
