"""Quality rules: fixed rules on whole-text counts, then boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting
from .docstats import COUNTS, FEATURES, FIT_ROWS, features, labelled, per_document

#: Fixed values of the base rules.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Features that may only lower the score as they grow.
FALLING = ("symbols", "dup_lines", "repeats", "exclamations", "bars")
#: Of the good documents of the validation part, this share must pass the trees.
KEEP_GOOD = 0.998
#: A model needs this many rows of each label.
LEAST_OF_LABEL = 10


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[boosting.Trees, float] | None:
    """Trees and the least score that they pass, or None if too few rows of a label are known.

    Four fifths of the sample grow the trees; the rest sets the cut, at most 0.5, so that KEEP_GOOD of its
    good documents pass.
    """
    x, y = labelled(docs, labels, limit)
    if min(y.sum(), len(y) - y.sum()) < LEAST_OF_LABEL:
        return None
    part = np.arange(len(y)) % 5 == 4
    trees = boosting.fit(x[~part], y[~part], {FEATURES.index(name): -1 for name in FALLING})
    good = trees.score(x[part & (y > 0)])
    return trees, float(min(0.5, np.quantile(good, 1 - KEEP_GOOD, method="lower"))) if len(good) else 0.5


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], limit: int = FIT_ROWS, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every document with its counts, base_failed, tree_score and kept, each named with ``prefix``.

    Null text has no words, so that it fails the base rules; so do empty texts. Repeated rows get
    equal verdicts. A very long text is a run of its own. Without enough labels (also for empty tables) the base rules alone decide and tree_score
    is 1. Rows are judged where they are read, without a shuffle.
    """
    model = fit(docs, labels, limit)
    kinds = {name: T.LongType() for name in COUNTS[:5]} | {"base_failed": T.BooleanType(), "tree_score": T.DoubleType(), "kept": T.BooleanType()}
    made = [T.StructField(prefix + name, kind) for name, kind in kinds.items()]

    def work(c: dict[str, np.ndarray]) -> list[np.ndarray]:
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"])
        score = model[0].score(features(c)) if model else np.ones(len(failed))
        return [*(c[name] for name in COUNTS[:5]), failed, score, ~failed & (score >= (model[1] if model else 0.5))]

    return per_document(docs, keep, made, work)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null and empty texts go, as they have no words; repeated rows stay or go together; an empty table gives none.
    """
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return judge(docs, labels, docs.columns, prefix=prefix).filter(f"`{prefix}kept`").select(*docs.columns)
