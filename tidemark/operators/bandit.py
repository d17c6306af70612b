"""Best-arm selection with a Gaussian kernel prior: posterior bounds of all arms, and the next batch.

What was observed of an experiment is small and is solved once; its arms may be many, and each is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Outcomes of one experiment, and queries that all rows are compared with, at most.
MOST_SEEN, MOST_QUERIES = 2000, 5000
#: Parts that the arms of an experiment are ordered in.
PARTS = 64


@dataclass(frozen=True)
class Settings:
    """Width of the kernel, noise, prior deviation and mean, first and next width of the bounds, picks a round."""

    gamma: float = 1.0
    sigma: float = 164.0
    eta: float = 164.0
    mean: float = 947.0
    beta: float = 5.0
    epsilon: float = 0.5
    picks: int = 48


def beta_of_round(settings: Settings, round_: int) -> float:
    beta = settings.beta
    for _ in range(round_):
        beta = float(np.around(beta * settings.epsilon, 4))
    return beta


def kernel(points: np.ndarray, gamma: float) -> np.ndarray:
    square = (points**2).sum(axis=1)
    return np.exp(-gamma * np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))


def posterior(k: np.ndarray, seen: np.ndarray, outcome: np.ndarray, sigma: float, eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every arm given centred outcomes of the arms ``seen``, by the dual form."""
    prior = eta**2 * k
    if not len(seen):
        return np.zeros(len(k)), np.diag(prior).copy()
    cross = prior[:, seen]
    solved = np.linalg.solve(cross[seen] + sigma**2 * np.eye(len(seen)), np.column_stack([outcome, cross.T]))
    return cross @ solved[:, 0], np.diag(prior) - (cross * solved[:, 1:].T).sum(axis=1)


def bounds(mean: np.ndarray, variance: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    half = beta * np.sqrt(np.maximum(variance, 0))
    return np.around(mean + half, 4), np.around(mean - half, 4)


def gaps(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each arm: the greatest upper bound of all others less its own lower bound."""
    top = np.argmax(upper)
    others = np.full(len(upper), upper[top])
    others[top] = np.delete(upper, top).max(initial=-np.inf)
    return others - lower


def choose(upper: np.ndarray, lower: np.ndarray, picks: int) -> tuple[list[int], int]:
    """The arms of a batch in order of choice, and the first proposal.

    Each time the candidate with the least gap meets the other candidate with the greatest upper
    bound, and the wider interval of the two is picked and leaves; ties take the first arm.
    """
    free = np.ones(len(upper), dtype=bool)
    gap, width = gaps(upper, lower), upper - lower
    out, proposal = [], -1
    for k in range(min(picks, len(upper))):
        best = int(np.argmin(np.where(free, gap, np.inf)))
        rivals = free.copy()
        rivals[best] = False
        rival = int(np.argmax(np.where(rivals, upper, -np.inf)))
        pick = best if width[best] >= width[rival] else rival
        proposal = best if k == 0 else proposal
        out.append(pick)
        free[pick] = False
    return out, proposal


def _first_of(df: DataFrame, keys: list[str], order: list[Column], id_: str, most: int) -> DataFrame:
    """The first ``most`` rows of every key; first those of parts of a key, so that no task orders all rows of one."""
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(id_), F.lit(PARTS)))
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).filter(F.col("__n") <= most)
    return inside.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= most).drop("__part", "__n")


def candidates(bounds: DataFrame, experiment: str, picks: int) -> DataFrame:
    """The arms among which the next batch of every experiment is: the ``picks`` least gaps and the ``picks`` + 1 greatest upper bounds.

    Each pick takes one arm out, which is the one with the least gap or one with a greatest bound beside it: whatever was picked before, the next
    least gap is among the first ``picks``, the greatest bound of the others among one more. The two greatest bounds, from which all gaps follow, are in it.
    """
    gap = greatest_other(bounds.select(experiment, "arm_id", "upper", "lower"), "upper", "arm_id", [experiment], "__other").withColumn("__gap", F.col("__other") - F.col("lower"))
    least = _first_of(gap, [experiment], [F.asc_nulls_last("__gap"), F.asc("arm_id")], "arm_id", picks)
    top = _first_of(gap, [experiment], [F.desc("upper"), F.asc("arm_id")], "arm_id", picks + 1)
    return least.union(top).select(experiment, "arm_id", "upper", "lower").distinct()


def choose_batches(bounds: DataFrame, experiment: str, picks: int) -> DataFrame:
    """experiment, arm_id and place of the next batch of every experiment; ``bounds`` has experiment, arm_id, upper and lower.

    Arms are taken in order of arm_id where bounds are equal. Of an experiment with any number of arms 2 ``picks`` + 1 rows are looked at together.
    """
    kind = dict(bounds.dtypes)[experiment]

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("arm_id")
        picked, _ = choose(own["upper"].to_numpy(float), own["lower"].to_numpy(float), picks)
        return pd.DataFrame({experiment: key[0], "arm_id": own["arm_id"].to_numpy()[picked], "place": range(len(picked))})

    return candidates(bounds, experiment, picks).groupBy(experiment).applyInPandas(one, f"`{experiment}` {kind}, arm_id long, place long")


def posterior_of(seen: DataFrame, settings: Settings, experiment: str) -> DataFrame:
    """experiment, points, weights and inverse of each experiment's outcomes: what the posterior of any arm follows from.

    ``seen`` has experiment, arm_id, the array point and outcome. Only what was observed meets in one task: MOST_SEEN outcomes of an experiment at most, which is checked.
    """
    kind = dict(seen.dtypes)[experiment]

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        if len(own) > MOST_SEEN:
            raise ValueError(f"an experiment has more than {MOST_SEEN} outcomes")
        own = own.sort_values("arm_id")
        points = np.stack(own["point"].to_numpy()).astype(float)
        inverse = np.linalg.inv(settings.eta**2 * kernel(points, settings.gamma) + settings.sigma**2 * np.eye(len(own)))
        weights = inverse @ (own["outcome"].to_numpy(float) - settings.mean)
        return pd.DataFrame({experiment: [key[0]], "points": [points.ravel()], "weights": [weights], "inverse": [inverse.ravel()]})

    return seen.select(experiment, "arm_id", "point", "outcome").groupBy(experiment).applyInPandas(one, f"`{experiment}` {kind}, points array<double>, weights array<double>, inverse array<double>")


def arm_bounds(arms: DataFrame, seen: DataFrame, settings: Settings, round_: int, experiment: str = "experiment") -> DataFrame:
    """experiment, arm_id, upper, lower and mean of every arm after a round; ``arms`` has experiment, arm_id and the array point.

    Arms are many tasks' work: each meets its experiment's outcomes, not the other arms. Without outcomes an arm has the prior's bounds.
    """
    known = posterior_of(seen, settings, experiment).withColumnRenamed(experiment, "__experiment")
    joined = arms.select(experiment, "arm_id", "point").join(known, F.col(experiment).eqNullSafe(F.col("__experiment")), "left").drop("__experiment")
    beta = beta_of_round(settings, round_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            upper, lower = np.empty(len(batch)), np.empty(len(batch))
            for _, rows in batch.groupby(experiment, dropna=False).indices.items():
                part = batch.iloc[rows]
                points = np.stack(part["point"].to_numpy()).astype(float)
                mean, variance = np.zeros(len(part)), np.full(len(part), settings.eta**2)
                first = part.iloc[0]
                if first["weights"] is not None:
                    old = np.asarray(first["points"]).reshape(len(first["weights"]), -1)
                    apart = (points**2).sum(axis=1)[:, None] + (old**2).sum(axis=1) - 2 * points @ old.T
                    cross = settings.eta**2 * np.exp(-settings.gamma * np.maximum(apart, 0))
                    mean = cross @ np.asarray(first["weights"])
                    variance = variance - ((cross @ np.asarray(first["inverse"]).reshape(len(old), len(old))) * cross).sum(axis=1)
                upper[rows], lower[rows] = bounds(mean, variance, beta)
            out = batch[[experiment, "arm_id"]].copy()
            yield out.assign(upper=upper + settings.mean, lower=lower + settings.mean, mean=(upper + lower) / 2 + settings.mean)

    kind = dict(arms.dtypes)[experiment]
    return joined.mapInPandas(run, f"`{experiment}` {kind}, arm_id long, upper double, lower double, mean double")


def kernel_to(points: DataFrame, id_: str, queries: DataFrame, query_id: str, vector: str, gamma: float) -> DataFrame:
    """Kernel value of every row against each of a stated set of queries, MOST_QUERIES at most, which is checked; both have ``vector``."""
    if queries.count() > MOST_QUERIES:
        raise ValueError(f"there are more than {MOST_QUERIES} queries")
    asked = F.broadcast(queries.select(F.col(query_id).alias("j"), F.col(vector).alias("__b")))
    square = F.aggregate(F.zip_with("__a", "__b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return points.select(F.col(id_).alias("i"), F.col(vector).alias("__a")).crossJoin(asked).select("i", "j", F.exp(-gamma * square).alias("k"))


def greatest_other(df: DataFrame, value: str, id_: str, keys: list[str], out: str = "other") -> DataFrame:
    """``df`` with the greatest value among the other rows of the key, null if there is none.

    The two greatest values of a key come from aggregations, so that no task sorts a key's rows. Ids are numbers.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("__first"), F.max_by(id_, F.struct(F.col(value).alias("v"), (-F.col(id_)).alias("i"))).alias("__best"))
    second = df.join(top, keys).filter(F.col(id_) != F.col("__best")).groupBy(*keys).agg(F.max(value).alias("__second"))
    both = df.join(top.join(second, keys, "left"), keys)
    return both.select(*df.columns, F.when(F.col(id_) == F.col("__best"), F.col("__second")).otherwise(F.col("__first")).alias(out))
