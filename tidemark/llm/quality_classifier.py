"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import sigmoid
from .common import held_out
from .docstats import FEATURES, FIT_ROWS, features, labelled, per_document

#: Weight of the diagonal of the pooled covariance in each class covariance.
SHRINKAGE = 0.1
#: A document is called good from this score on.
GOOD_FROM = 0.7
LEAST_OF_LABEL = 10


def transform(x: np.ndarray) -> np.ndarray:
    """Rates on a scale on which their spread is nearly even: square roots, but for what is logarithmic already."""
    plain = [FEATURES.index(name) for name in ("log_words", "mean_word", "distinct", "words_a_line")]
    out = np.sqrt(x)
    out[:, plain] = x[:, plain]
    return out


@dataclass
class Discriminant:
    """Class means and the inverse Cholesky factors of the class covariances, made once."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    offsets: list[float]
    gain: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of label 1 less that of label 0."""
        z = (transform(x) - self.centre) / self.scale
        density = [offset - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, offset in zip(self.means, self.whiten, self.offsets)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.gain * _squash(self.margin(x)) + self.shift)


def _squash(margin: np.ndarray) -> np.ndarray:
    """Margins grow without bound far from both classes; their size there carries no more evidence."""
    return np.sign(margin) * np.log1p(np.abs(margin))


def discriminant(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit the class densities on four fifths of the rows and the slope and shift of the score on the rest."""
    own = np.arange(len(y)) % 5 != 4
    raw = transform(x)
    centre, scale = raw[own].mean(axis=0), raw[own].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (raw - centre) / scale
    groups = [z[own & (y == k)] for k in (0, 1)]
    pooled = np.diag(sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / own.sum()) + 1e-3 * np.eye(z.shape[1])
    means, whiten, offsets = [], [], []
    for g in groups:
        factor = np.linalg.cholesky((1 - shrinkage) * np.cov(g, rowvar=False, bias=True) + shrinkage * pooled)
        means.append(g.mean(axis=0))
        whiten.append(np.linalg.inv(factor))
        offsets.append(float(np.log(len(g) / own.sum()) - np.log(np.diag(factor)).sum()))
    out = Discriminant(centre, scale, means, whiten, offsets)
    out.gain, out.shift = _calibrate(_squash(out.margin(x[~own])), y[~own])
    return out


def _calibrate(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps."""
    design, w = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(design @ w)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w = w - 0.5 * np.linalg.solve(hessian, design.T @ (p - y) + 1e-2 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Discriminant | None:
    """The classifier for a sample of at most ``limit`` labelled rows, or None if too few rows of a label are known."""
    x, y = labelled(docs, labels, limit)
    return discriminant(x, y) if min(y.sum(), len(y) - y.sum()) >= LEAST_OF_LABEL else None


def classify(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores; a null
    doc_id is not held out. Without enough labels (also for empty tables) every score is 0.5. No shuffle.
    """
    model = fit(docs, labels, limit)

    def work(c: dict[str, np.ndarray]) -> list[np.ndarray]:
        x = features(c)
        return [model.score(x) if model else np.full(len(x), 0.5)]

    scored = per_document(docs, ["doc_id"], [T.StructField("score", T.DoubleType())], work)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).cast("int").alias("predicted")
    )
