"""Regularised quadratic discriminant over transformed document statistics.

Every text gives the counts below, which become rates and then logarithms, so
that each class is near a Gaussian. Spark sums the first and second moments of
both classes over all labelled training rows; the class covariances are
shrunk towards the pooled one and towards its diagonal, and their Cholesky
factors are computed once and sent to the tasks. The score is the logistic of
the difference of the two log densities (squared Mahalanobis distance and log
determinant, both from the factors) and of the log class shares.

Defined cases: null text counts as empty and is scored like any; rows of
``labels`` with a null id or label are left out, repeated ones count each; with
no training row of one class, every score is the share of label 1 (one half with
none at all). Language, source and ids never enter. Repeated rows score alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, codes, fresh, per_text, settled, slices, spans, table
from .quality_rules import text_stats

FOLDS = 5
THRESHOLD = 0.3
TO_POOLED = 0.1
TO_DIAGONAL = 0.05


def _bytes_of(*parts) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p)] = True
    return out


UPPER, LOWER, DIGIT = _bytes_of(range(65, 91)), _bytes_of(range(97, 123)), _bytes_of(range(48, 58))
MARKS, STOPS, BANG = _bytes_of(b"#*$%&|<>~^_=+@\\/{}[]"), _bytes_of(b".,;:"), _bytes_of(b"!?")
FEATURES = ("words", "word length", "word length spread", "upper", "digits", "marks", "stops", "bangs", "beyond ascii", "lines", "repeated lines", "repeated words", "distinct words", "short words", "marked words")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a slice."""
    n = len(offsets) - 1
    stats = text_stats(data, offsets)
    inside = ~IS_SPACE[data]
    start, end = spans(inside, offsets)
    owner = np.repeat(np.arange(n), stats["n_words"])
    size = (end - start).astype(float)
    words = np.maximum(stats["n_words"], 1).astype(float)
    count = lambda values: np.bincount(owner, values, n)
    rate = lambda table: per_text(table[data], offsets) / np.maximum(chars, 1)
    chars = per_text(inside, offsets).astype(float)
    mean = count(size) / words
    spread = np.sqrt(np.maximum(count(size**2) / words - mean**2, 0))
    new = ~pd.Series(codes(data, start, end) * n + owner).duplicated().to_numpy()
    marks_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((MARKS | BANG)[data], out=marks_before[1:])
    lines = per_text(data == 10, offsets) + 1
    beyond = np.zeros(256, bool)
    beyond[128:] = True
    small = lambda x: np.log(x + 0.003)
    out = [
        np.log1p(stats["n_words"]), np.log1p(mean), np.log1p(spread), small(rate(UPPER)), small(rate(DIGIT)), small(rate(MARKS)), small(rate(STOPS)), small(rate(BANG)), small(rate(beyond)),
        np.log1p(words / lines), small(stats["n_dup_lines"] / lines), small(stats["n_repeat_words"] / words), np.log(count(new) / words + 0.05), small(count(size <= 3) / words),
        small(count(marks_before[end] > marks_before[start]) / words),
    ]
    return np.stack(out, 1)


def with_features(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    at, kept = source.columns.index("text"), [source.columns.index(c) for c in keep]
    d = len(FEATURES)

    def run(batches):
        for batch in batches:
            rows = [features(data, offsets) for _, _, data, offsets in slices(batch.column(at))]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, d, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), lists], [*keep, name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.DoubleType()))]))


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _moments(batches):
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    c, at = np.divmod(np.arange(sums.size), sums.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at), pa.array(sums.ravel())], ["class", "at", "value"])


def moments(rows: DataFrame) -> np.ndarray:
    """Count, sums and product sums of each class: two lines of fixed length, whatever the input's size."""
    total = rows.mapInArrow(_moments, "class long, at long, value double").groupBy("class", "at").agg(F.sum("value").alias("value"))
    d = len(FEATURES)
    out = np.zeros((2, 1 + d + d * d))
    for r in total.collect():
        out[r["class"], r["at"]] = r["value"]
    return out


class Discriminant:
    def __init__(self, sums: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL):
        d, n = len(FEATURES), sums[:, 0]
        self.share = n[1] / n.sum() if n.sum() else 0.5
        self.factors = []
        if min(n) == 0:
            return
        means = sums[:, 1 : 1 + d] / n[:, None]
        scatter = [sums[c, 1 + d :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / n.sum()
        for c in (0, 1):
            own = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
            own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
            lower = np.linalg.cholesky(own)
            self.factors.append((means[c], np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum(), np.log(n[c] / n.sum())))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        low, high = (log_share - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - 0.5 * log_det for mean, inverse, log_det, log_share in self.factors)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def fitted(rows: DataFrame, labels: DataFrame, feature: str = "feature") -> Discriminant:
    """Fit on all labelled rows outside the held-out fold."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
    own = own.where(remainder(F.col("label_id")) != 0)
    return Discriminant(moments(rows.join(own, rows["doc_id"] == own["label_id"]).select(feature, "label")))


def scored(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score``, the likelihood of label 1."""
    (feature,) = fresh(docs, "feature")
    rows = settled(with_features(docs, list(dict.fromkeys([*keep, "doc_id"])), feature))
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, labels, feature))
    at, kept = rows.columns.index(feature), [rows.columns.index(c) for c in keep]
    d = len(FEATURES)

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(model.value(x))], [*keep, "score"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
