"""Quality classifier: regularised quadratic discriminant.

Document statistics are made into log-ratios; each class has a mean and a
covariance shrunk towards its diagonal and a pooled scale; the score is the
logistic of the difference of the two Mahalanobis log-densities, made with the
Cholesky factors kept in the model.  It is fitted on at most ``PER_CLASS``
labelled documents of class 0 and 1, picked by a hash of the id.

Null text counts as empty and is scored like any text; rows with equal ids are
scored alike; labels that are null or neither 0 nor 1 are left out; without
both labels every score is 0.5; an empty table gives an empty result; other
columns are not read, whatever their names.  A text longer than a slice is
scored alone, over its whole length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices
from .rules_cascade import Statistics, per_document

PER_CLASS = (4000, 4000)
SHRINK = 0.1
THRESHOLD = 0.7
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:'\"()-")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each document of a slice."""
    s = Statistics(data, offsets)
    n = s.n_words.astype(float)
    chars = s["word_chars"].astype(float)
    lines, again, upper, lower = s["n_lines"], s["n_dup_lines"], s["upper"], s["lower"]
    digits = per_document((data >= 48) & (data <= 57), offsets)
    ratio = lambda a, b, e=0.01: np.log((a + e) / (b + 1))
    return np.column_stack(
        [
            np.log1p(n),
            np.log((chars + 5) / (n + 1)),
            ratio(s["n_symbols"], n),
            ratio(per_document(_BANG[data], offsets), n),
            ratio(per_document(_MARK[data], offsets), n, 0.1),
            ratio(again, lines),
            ratio(s["n_repeat_words"], n),
            (s["distinct_words"] + 1) / (n + 1),
            (upper + 1) / (upper + lower + 2),
            ratio(digits, chars),
            (s["worded"] + 1) / (n + 1),
            np.log((lines + 1) / (n + 1)),
        ]
    )


@dataclass(frozen=True)
class Model:
    """Of class 0 and class 1: mean, inverse Cholesky factor, log-density constant; centre and scale of the features."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Model | None:
    """None without rows of both classes.

    shrink goes to the diagonal; as much again goes to the overall scale, with
    which a statistic that never varies in a class keeps a finite density.
    """
    if not (y == 0).any() or not (y == 1).any():
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - centre) / scale
    means, factors, constants = [], [], []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own, rowvar=False, bias=True) if len(own) > 1 else np.zeros((z.shape[1],) * 2)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + shrink * shrink * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(len(own) / len(z)) - np.log(np.diag(lower)).sum()))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(constants))


def pick_labelled(labels: DataFrame, id_col: str, label_col: str, per_class: tuple[int, int], held_out) -> DataFrame:
    """At most about per_class ids of labels 0 and 1, of rows not held out, by a hash of the id."""
    rows = labels.filter(~held_out & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_003))
    keep = F.lit(False)
    for k in (0, 1):
        keep = keep | ((F.col("_label") == k) & (spread < int(1_000_003 * min(1.0, per_class[k] / max(1, sizes.get(k, 0))))))
    return rows.filter(keep).groupBy(id_col).agg(F.max("_label").alias("_label")).limit(4 * sum(per_class))


def train(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """Fit on the labelled sample; what reaches the driver is its feature rows."""
    picked = pick_labelled(labels, id_col, label_col, per_class, held_out)

    def rows(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(0)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(low, high - low)], names=["x", "y"])

    # picked holds at most 4 * sum(per_class) rows
    sample = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(text_col, "_label").mapInArrow(rows, "x array<double>, y int").collect()
    sample = sorted((tuple(r[0]), r[1]) for r in sample)
    if not sample:
        return None
    return fit(np.array([r[0] for r in sample]), np.array([r[1] for r in sample]))


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score and predicted of every document."""
    docs = docs.select(id_col, text_col)

    def rows(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                score = model.score(features(data, offsets)) if model else np.full(high - low, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.mapInArrow(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
