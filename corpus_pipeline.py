"""From documents to packed training sequences, stage by stage."""

from pyspark.sql import DataFrame, SparkSession

from salesflow.llm import op2_repeats, op3_secrets, op8_jaccard, op9_quality, op10_packing
from salesflow.llm.common import Stored, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence verdict keep. Null and short texts go."""
    return op9_quality.keep(docs, op9_quality.learn(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles: the one of the smallest
    doc_id. Rows without shingles or without an id stay; of repeated rows one stays."""
    return op8_jaccard.one_of_each(docs, 5, 80, Stored(spark, "jaccard"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 400 bytes and passages of 51 words that
    also start elsewhere; a document of which nothing is left goes."""
    return op2_repeats.remove(docs, Stored(spark, "repeats"), least_words=op2_repeats.PASSAGE_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts redacted."""
    return op3_secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return op10_packing.packed_documents(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn histograms, index byte strings and encode in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order; each result is written and read again."""
    docs, stored = documents(spark, sf_dir), Stored(spark, "corpus")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
