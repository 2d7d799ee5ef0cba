"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import fold, read, small_batches
from emberlog.llm.words import SYMBOL, Words, distinct, hashed, mix, seeds

BITS = 20
#: The model learns from at most so many labelled documents, those with the smallest hash of their id.
MAX_TRAIN = 12_000
FOLDS = 5
_PAIR = seeds(8, 101)


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and document numbers of the unigrams, bigrams and skip-grams (one or two words left out) of some words."""
    shift, h, doc = np.uint64(64 - bits), words.hash, words.doc
    slots, docs = [mix(h) >> shift], [doc]
    with np.errstate(over="ignore"):
        for gap in (1, 2, 3):
            same = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(h) > gap else np.zeros(0, np.int64)
            slots.append(mix(h[same] * _PAIR[0] + h[same + gap] * _PAIR[gap]) >> shift)
            docs.append(doc[same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(docs)


@dataclass
class Sparse:
    """A model as it is broadcast: a bias and the weights that L1 left."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.slots] = self.weights
        return w


def ftrl(
    examples: list[tuple[np.ndarray, float]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01, epochs: int = 8
) -> Sparse:
    """Weights after some passes over (slots, label) in the order given. Each coordinate has its own learning rate.

    alpha and l1 were chosen on rows whose id hash leaves 1, learning from those that leave 2, 3 or 4; rows that leave 0
    weren't looked at.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        x = z[at]
        cut = np.where(at == bias, 0.0, l1)
        return -np.sign(x) * np.maximum(np.abs(x) - cut, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for slots, label in examples:
            at = np.append(slots, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange((1 << bits) + 1))
    kept = np.flatnonzero(w[:-1])
    return Sparse(kept, w[kept], float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Sparse | None:
    """Learn from at most max_train labelled documents outside the held-out fold; None if there is none.

    The bounded sample is learnt from in one task; only the weights that L1 left come to the driver, 2^BITS at most.
    Labels with null ids or null labels are left out; of labels that disagree the largest counts. Each row of a repeated
    id is an example. Null texts are examples without features.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = F.xxhash64("id")
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), FOLDS) != 0))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(order, "id")
        .limit(max_train)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most max_train labels
    sample = sample.repartition(1).sortWithinPartitions(order, "id", "text").select("text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[np.ndarray, float]] = []
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for words in hashed(batch.column("text"), lower=True, separator=SYMBOL):
                slots, doc = features(words)
                keys = distinct((doc << BITS) | slots)
                cuts = np.searchsorted(keys >> BITS, np.arange(words.lo, words.hi + 1))
                found = (keys & ((1 << BITS) - 1)).astype(np.int32)
                examples += [(found[a:b], label[d]) for d, a, b in zip(range(words.lo, words.hi), cuts, cuts[1:])]
        if examples:
            model = ftrl(examples)
            yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *model.slots.tolist()], pa.int64()), "weight": pa.array([model.bias, *model.weights.tolist()])})

    found = sample.mapInArrow(learn, "slot long, weight double").toPandas()
    if not len(found):
        return None
    kept = found[found["slot"] >= 0].sort_values("slot")
    return Sparse(kept["slot"].to_numpy(), kept["weight"].to_numpy(), float(found.loc[found["slot"] < 0, "weight"].iloc[0]))


def score(docs: DataFrame, model: Sparse | None, text_col: str = "text") -> DataFrame:
    """docs with a column `toxicity` in 0..1 appended (replacing one of that name).

    Null and empty texts score by the bias alone. Without a model every document scores 0. Long texts are scored whole:
    a feature counts once however often it occurs. Repeated rows score alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    sent = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.dense()
        for batch in batches:
            total = np.full(batch.num_rows, sent.value.bias)
            for words in hashed(batch.column(text_col), lower=True, separator=SYMBOL):
                slots, doc = features(words)
                hit = w[slots] != 0
                keys = distinct((doc[hit] << BITS) | slots[hit])
                total += np.bincount(keys >> BITS, w[keys & ((1 << BITS) - 1)], minlength=batch.num_rows)
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(apply, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
