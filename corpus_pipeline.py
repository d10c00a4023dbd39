"""The corpus pipeline: documents through five of the training-data operators, each stage on all the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import bpe, decontaminate, jaccard, quality, suffix_dedup
from usagelens.llm.common import checkpoint, fresh, numbered, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go.

    Null and empty texts are scored by their statistics; equal texts fare alike; null and repeated ids are scored like any row, and don't
    train. Without labels, or with one kind only, all rows share one score. All columns are kept. An empty table stays empty.
    """
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on five-word shingles the first by id stays (null ids first; of equal ids the one of the least text).

    Rows are told apart by a number of their own, so repeated or null ids lose no row of another group. Texts without words stay.
    """
    rows, key, _ = numbered(docs, "doc_id", "text")
    groups = jaccard.jaccard_components(rows.select(key, "text"), n=5, num=80, den=100, id=key)
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(fresh(rows, "_gone")))
    return rows.join(gone, rows[key] == gone[gone.columns[0]], "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occurred before are cut out of the texts.

    Null texts stay null, and every row stays. Before is by id; where ids are null or repeat, by (id, nulls first; text), so of equal rows all but
    one are cut empty. ``n_chars`` follows the text where it was cut. All columns are kept. An empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all words of a shorter one, go.

    Each row is judged by its own text, whatever its id. Null and empty texts have no words and stay, as all do without a benchmark. All columns are
    kept. An empty table stays empty.
    """
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids, with digests of the ids and of the decoded text: one row for each row, by its id alone.

    Null and empty texts have no tokens and decode to ''. Repeated and null ids stay as they are. An empty table gives an empty one.
    """
    return bpe.digest(bpe.encode(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The first stage is a trained model and the last a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result but the last is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
