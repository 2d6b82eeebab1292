"""A training corpus from documents: toxic documents go, repeated lines go, one document of each group of near copies
stays, sources are mixed to their target weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, line_dedup, mixing, set_join, toxicity
from terravane.session import durable


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores 0.5 or more go; it learns from the labels beside the documents.

    Null and empty texts score as texts without units; rows are judged one by one, so repeated rows share their fate, and
    a null id is a row like others. Other columns stay as they are. Empty tables stay empty."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, one whose lines all go with an empty text.

    A null text becomes the empty text it counts as. Columns that are named like the operator's own (n_lines, n_dropped,
    keep) keep their values. n_chars, where there is one, is the length of what is left. Empty tables stay empty."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "n_dropped", "keep")}
    clean = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    clean = clean.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach one another by links the one with the smallest id stays.

    Documents without words link with nothing and stay. Rows without an id stay, and so do all rows that share the kept id.
    Other columns stay as they are. Empty tables stay empty."""
    return set_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold what the mix takes of them.

    A document of which the mix takes nothing goes; one without words stays as it is. Null is a source of its own, the last.
    Rows alike in id, source and text are given the same words. Empty tables stay empty."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests and whether decoding gives the text back.

    A null text counts as empty and has no ids; every row gives one row, repeated ones and those without an id too."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: The first stage is a trained model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)  # each stage starts from a written table
    return docs
