"""A training corpus from documents: rules, near copies, personal data, mix, tokens.

Each stage gets the rows that the one before it kept, as a table that was written and is read again.

Defined cases, for every stage but the last: all columns of the input come out under their names with their values, but
for text and n_chars, which personal data changes; columns that are named like an operator's results are no exception.
Null and empty texts fail the quality rules and so leave at the first stage; rows without a doc_id are rows like others;
rows that repeat go to one of each in the second stage; very long texts are worked on whole; ties are settled by the
operators as they say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import jaccard, mixing, pieces, pii, quality
from strandlake.llm.common import written

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules keep."""
    return quality.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.clean_rows(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target; a document that is taken twice is there twice."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether decoding them gives its text again."""
    done = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    again = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", again.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", tokens),
]

#: The pieces of a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
