"""A corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate class stays, and
what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, read
from haulspark.llm.line_dedup import dedup_lines
from haulspark.llm.ngram_join import one_of_each
from haulspark.llm.packing import pack
from haulspark.llm.toxicity import reject_toxic

#: Not expressible in SQL as a whole: the first stage learns a classifier.  tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored 0.5 or more are rejected."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that more than a tenth of a source's documents have are dropped; n_chars follows."""
    out = dedup_lines(docs, "source", "text").withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: five-word shingles, similarity of 0.8 or more; the smallest doc_id of each class stays."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
