"""Toxicity by a chain of linear classifiers.

The categories are predicted in turn; each model reads the hashed words and word beginnings of the text, its
structure statistics and the probabilities of the earlier categories. Of the words and beginnings, a model
reads those that its training rows tie to the category beyond chance (``CHI_SQUARE``), or the many neutral
words of a long text would drown one telling word. For training those are out of fold:
each fold's come from models that haven't seen it. The tables label two things, so the chain has two links:
low quality, then toxic. Models are learnt on the driver from at most ``TRAIN_ROWS`` labelled rows that aren't
held out; every row is scored. Words count by presence, so one insult counts alike in a text of any length.

Defined cases: null and empty texts are scored by their statistics; equal texts score alike. A category
without labels, or with one kind only, gets its share of positives (0 without any) for all rows. Extra
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from usagelens.llm.common import lean, table
from usagelens.llm.features import FactorisationMachine, Sparse, only, sparse_of, take, telling, training_rows

TRAIN_ROWS = 12_000
BEGINNINGS = 6
FOLDS = 5
CHI_SQUARE = 24.0
THRESHOLD = 0.5


class Link:
    """A linear model over the telling features."""

    def fit(self, x: Sparse, y: np.ndarray, earlier: np.ndarray) -> Link:
        self.keep = telling(x, y, CHI_SQUARE)
        self.model = FactorisationMachine(0, epochs=30, rate=0.2, l2=1e-5, extra=earlier.shape[1]).fit(only(x, self.keep), y, earlier)
        return self

    def predict(self, x: Sparse, earlier: np.ndarray) -> np.ndarray:
        return self.model.predict(only(x, self.keep), earlier)


class Chain:
    def __init__(self, names: list[str]):
        self.names, self.models = names, []

    def fit(self, x: Sparse, y: np.ndarray, folds: np.ndarray) -> Chain:
        earlier = np.zeros((len(y), 0), np.float32)
        for j in range(len(self.names)):
            if len(np.unique(y[:, j])) < 2:
                self.models.append(float(y[:, j].mean()) if len(y) else 0.0)
                out = np.full(len(y), self.models[-1])
            else:
                out = np.zeros(len(y))
                for f in range(FOLDS):
                    own, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
                    if len(own) and len(rest):
                        out[own] = Link().fit(take(x, rest), y[rest, j], earlier[rest]).predict(take(x, own), earlier[own])
                self.models.append(Link().fit(x, y[:, j], earlier))
            earlier = np.column_stack([earlier, out]).astype(np.float32)
        return self

    def predict(self, x: Sparse) -> np.ndarray:
        n = len(x.start) - 1
        out = np.zeros((n, 0), np.float32)
        for m in self.models:
            out = np.column_stack([out, np.full(n, m) if isinstance(m, float) else m.predict(x, out)]).astype(np.float32)
        return out.astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text") -> Chain:
    """``categories``: name and SQL expression over the labels (0 or 1), in the order of the chain."""
    labels = labels.select(id, *[F.expr(e).cast("int").alias(n) for n, e in categories.items()])
    x, y, folds = training_rows(docs, labels, list(categories), rows, BEGINNINGS, False, id, text)
    return Chain(list(categories)).fit(x, y, folds)


def scored(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a probability for each category)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in sparse_of(batch.column(1), BEGINNINGS, False):
                p = sent.value.predict(x)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[pa.array(p[:, j]) for j in range(p.shape[1])]], ["id", *chain_names])

    chain_names = list(chain.names)
    schema = T.StructType([docs.schema["id"], *[T.StructField(n, T.DoubleType()) for n in chain_names]])
    return docs.mapInArrow(lean(run), schema).withColumnRenamed("id", id)


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    out = scored(docs, chain)
    return out.select("doc_id", F.col("low_quality").alias("p_low_quality"), F.col("toxic").alias("p_toxic"), (F.col("toxic") >= THRESHOLD).cast("int").alias("toxic"))
