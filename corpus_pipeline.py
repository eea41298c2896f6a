"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents; each works on all rows its predecessor kept. Null and repeated ids are rows of their own, further columns go along
whatever their names, texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, exact, jaccard, mixing, registry, scratch
from tallyforge.llm import toxicity as toxic
from tallyforge.llm.rows import keyed, restored
from tallyforge.plans.tables import table

#: A document whose score reaches this goes.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored below TOXIC, by a network that learns from the labelled rows outside the held-out fold.

    A null or empty text is scored as one empty window. Where the labels know one class only, its share is every score.
    """
    docs, ids = keyed(docs)
    labels = table(spark, sf_dir, "labels").where(registry.remainder(4) != 2)
    if ids is not None:
        # a label holds for every row of its id
        labels = labels.join(ids, F.col("doc_id") == F.col("id")).select(F.col("row").alias("doc_id"), "toxic")
    scores = toxic.score(docs, labels, F.lit(True))
    return restored(docs.join(scores.where(F.col("score") < TOXIC).select("doc_id"), "doc_id", "left_semi").select(*docs.columns), ids)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of texts equal but for white space. Null texts equal the empty one; of rows with one id the first by content stays."""
    docs, ids = keyed(docs)
    kept = exact.dedup(docs, exact.halves(docs)).where("kept").select("doc_id")
    return restored(docs.join(kept, "doc_id", "left_semi").select(*docs.columns), ids)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more. A text without words links with nothing and stays."""
    docs, ids = keyed(docs)
    kept = jaccard.jaccard_join(docs, k=5, num=80, den=100).where("component_id = doc_id").select("doc_id")
    return restored(docs.join(kept, "doc_id", "left_semi").select(*docs.columns), ids)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each use of a document's words, n_chars set anew. A text without words has none to give; a null source is one of its own, last."""
    docs, ids = keyed(docs)
    rows, _ = mixing.mix_plan(docs)
    return restored(mixing.mixed_texts(docs, rows), ids)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row and the digest of what they decode to. A null text is the empty one, without tokens."""
    import public_tokenizers

    rows = bpe.coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("tokens", tokens)]

#: Toxicity and mixing have no SQL: tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
