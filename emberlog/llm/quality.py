"""Quality: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import fold, read, small_batches, written
from emberlog.llm.words import BLANK, Words, hashed, ngrams, split

FOLDS, HELD_OUT = 3, 1
STATISTICS = (
    "bytes", "words", "word_bytes", "word_spread", "distinct_words", "top_word", "distinct_pairs", "repeats",
    "symbols", "digits", "capitals", "stops", "bare_symbols", "line_words", "distinct_lines", "multibyte",
)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_SYMBOL = ~(_ALNUM | _STOP | BLANK)
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log-odds of a share, kept finite."""
    p = x / np.maximum(of, 1)
    return np.log((p + 0.002) / (1 - np.minimum(p, 1) + 0.002))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by document, and how often its commonest comes."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(words: Words) -> np.ndarray:
    """Transformed statistics of documents lo..hi, one row each."""
    n = words.hi - words.lo
    doc = words.doc - words.lo
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask))[words.ends])
    size = np.diff(words.ends).astype(float)
    total = np.bincount(doc, minlength=n).astype(float)
    length = (words.last - words.first).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(total, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / np.maximum(total, 1) - mean**2, 0))
    distinct, top = _distinct(doc, words.hash, n)
    pair, at = ngrams(words, 2)
    pairs, _ = _distinct(doc[at], pair, n)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1]))
    letters = np.append(0, np.cumsum(_ALNUM[words.data])) if len(words.data) else np.zeros(1)
    bare = (letters[words.last] - letters[words.first]) == 0 if len(words.first) else np.zeros(0, bool)
    lines = split(words.data, words.ends, 0, n, _BREAK)
    line_n = np.bincount(lines.doc, minlength=n).astype(float)
    line_distinct, _ = _distinct(lines.doc, lines.hash, n)
    data = words.data
    return np.column_stack([
        np.log1p(size), np.log1p(total), np.log1p(mean), np.log1p(spread), _share(distinct, total), _share(top, total), _share(pairs, np.maximum(total - 1, 1)),
        _share(np.bincount(doc[again], minlength=n).astype(float), total), _share(count(_SYMBOL[data]), size), _share(count(_DIGIT[data]), size),
        _share(count(_CAPITAL[data]), total), _share(count(_STOP[data]), total), _share(np.bincount(doc, bare, n), total), np.log1p(total / np.maximum(line_n, 1)),
        _share(line_distinct, line_n), _share(count(data >= 128), size),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the transformed statistics of each whole text; null texts have those of the empty text."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(words) for words in hashed(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, "id long, x array<double>")


@dataclass
class Discriminant:
    """Class means and the inverse Cholesky factors of their shrunk covariances, made once."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b = (c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants))
        return b - a


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = 0.1) -> Discriminant | None:
    """Fit on every labelled row outside the held-out fold; None unless both classes are there.

    Class counts, sums and sums of products are added up by Spark; the driver gets two rows for each pair of statistics.
    A covariance is shrunk towards the pooled one, and that towards its diagonal.
    """
    d = len(STATISTICS)
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id"), FOLDS) != HELD_OUT))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    rows = stats.join(marks, "id").select("label", F.concat(F.array(F.lit(1.0)), "x").alias("x"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 1)
            for c in (0, 1):
                total[c] += x[label == c].T @ x[label == c]
        k = np.arange(total.size)
        yield pa.RecordBatch.from_pydict({"k": k, "v": total.ravel()})

    sums = rows.mapInArrow(products, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros(2 * (d + 1) ** 2)
    for k, v in sums.collect():  # 2 (d + 1)^2 rows
        total[k] = v
    total = total.reshape(2, d + 1, d + 1)
    counts = total[:, 0, 0]
    if not counts.all():
        return None
    means = [total[c, 0, 1:] / counts[c] for c in (0, 1)]
    covs = [total[c, 1:, 1:] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (covs[0] * counts[0] + covs[1] * counts[1]) / counts.sum()
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    factors, constants = [], []
    for c in (0, 1):
        lower = np.linalg.cholesky((1 - shrink) * covs[c] + shrink * pooled)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(counts[c] / counts.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, constants)


def classify(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """id and score in 0..1; without a model every document scores 1, so that nothing is thrown away."""
    if model is None:
        return stats.select("id", F.lit(1.0).alias("score"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            p = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], ["id", "score"])

    return stats.mapInArrow(apply, "id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(document_statistics(read(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, read(spark, sf_dir, "labels"))
    return classify(stats, model).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
