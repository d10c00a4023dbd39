"""Quality classifier: a factorisation machine over hashed words, structure statistics and text size.

Learnt on the driver from a bounded sample of labelled rows (``TRAIN_ROWS``), never from held-out ids; every
row of the input is scored, in linear time by the sum-of-squares identity. Inputs are the text alone.

Defined cases: null and empty texts are scored by their statistics; equal texts score alike. Without labels,
or with labels of one kind only, all rows get the share of good labels (0.5 without any). Rows with a null id
are scored. Filters keep all columns; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from usagelens.llm.common import lean, table
from usagelens.llm.features import FactorisationMachine, held_out, sparse_of, training_rows

TRAIN_ROWS = 12_000
RANK = 8
THRESHOLD = 0.3


class Constant:
    def __init__(self, share: float):
        self.share = share

    def predict(self, x, extra=None) -> np.ndarray:
        return np.full(len(x.start) - 1, self.share)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text"):
    x, y, _ = training_rows(docs, labels, [column], rows, 0, True, id, text)
    if len(np.unique(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    return FactorisationMachine(RANK).fit(x, y[:, 0])


def scored(docs: DataFrame, model, text: str = "text", output: str = "score") -> DataFrame:
    """The rows with the model's score; an input column of that name is replaced."""
    docs = docs.drop(output)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.predict(x) for _, _, x in sparse_of(batch.column(at), 0, True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, output])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))


def kept(docs: DataFrame, model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, as they are."""
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.predict(x) for _, _, x in sparse_of(batch.column(at), 0, True)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold if scores else [], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
