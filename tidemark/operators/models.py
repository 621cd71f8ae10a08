"""Small prediction models: fitted on the driver from bounded aggregates, applied as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OUT_OF_RANGE = 3.0


@dataclass(frozen=True)
class Logistic:
    """A logistic model on standardised features."""

    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float

    def column(self, features: Sequence[Column], clamp: float | None = None) -> Column:
        """The predicted rate; with ``clamp`` standardised values are held within it."""
        z = F.lit(self.intercept)
        for x, m, s, c in zip(features, self.means, self.scales, self.coefficients, strict=True):
            own = (x - m) / s
            if clamp is not None:
                own = F.least(F.greatest(own, F.lit(-clamp)), F.lit(clamp))
            z = z + c * own
        return 1 / (1 + F.exp(-z))

    def guarded(self, features: Sequence[Column], sample: Column, baseline: float, prior: float = 30.0) -> Column:
        """The prediction with values beyond three deviations held, shrunk to the baseline in small samples."""
        weight = sample / (sample + prior)
        return weight * self.column(features, OUT_OF_RANGE) + (1 - weight) * baseline


def fit_logistic(x: Sequence[Sequence[float]], successes: Sequence[float], sizes: Sequence[float], l2: float = 0.01, rate: float = 0.5, steps: int = 2000) -> Logistic:
    """Weighted gradient descent over grouped rows: each has features, successes and a size."""
    a, y, n = np.asarray(x, float), np.asarray(successes, float), np.asarray(sizes, float)
    means = np.average(a, axis=0, weights=n)
    scales = np.sqrt(np.average((a - means) ** 2, axis=0, weights=n))
    scales[scales == 0] = 1.0
    z = (a - means) / scales
    w, total = np.zeros(a.shape[1]), n.sum()
    p0 = min(max(y.sum() / total, 1e-6), 1 - 1e-6)
    b = math.log(p0 / (1 - p0))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        r = (n * p - y) / total
        w -= rate * (z.T @ r + l2 * w)
        b -= rate * r.sum()
    return Logistic(means.tolist(), scales.tolist(), w.tolist(), float(b))


# The weights of the heuristic for contextual bookings.
HEURISTIC = {
    "base": 0.005,
    "destination": 0.08,
    "eligible": 0.04,
    "intent": 0.025,
    "condition": 0.02,
}
DESTINATION_SIGNAL = {"destination_match_user_rate": 0.7, "destination_match_event_rate": 0.3}
INTENT_SIGNAL = {"hotel_detail_view_user_rate": 0.30, "funnel_recovery_user_rate": 0.25, "booking_start_user_rate": 0.20, "benefit_user_rate": 0.15, "promotion_response_user_rate": 0.10}


def heuristic_rate(features: dict[str, Column], destination_required: bool) -> Column:
    """An uncalibrated booking rate from a candidate's signal rates."""
    mixed = lambda weights: sum((w * features[k] for k, w in weights.items()), F.lit(0.0))
    where = mixed(DESTINATION_SIGNAL)
    rate = HEURISTIC["base"] + HEURISTIC["destination"] * where + HEURISTIC["eligible"] * features["eligible_destination_match_user_rate"] + HEURISTIC["intent"] * mixed(INTENT_SIGNAL) + HEURISTIC["condition"] * features["promotion_condition_match"]
    if destination_required:
        rate = F.when(where <= 0, rate * 0.2).otherwise(rate)
    return F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))


def calibrate_threshold(accepted: Sequence[float], rejected: Sequence[float], minimum_margin: float = 0.0) -> tuple[float, float]:
    """A similarity threshold in the middle between accepted and rejected anchors, those at the boundary included, and the margin between them.

    A margin below the minimum is an error, as are missing anchors.
    """
    if not accepted or not rejected:
        raise ValueError("anchors of both kinds are needed")
    low, high = max(rejected), min(accepted)
    if high - low < minimum_margin:
        raise ValueError(f"margin {high - low:.6f} is below {minimum_margin:.6f}")
    return (low + high) / 2, high - low
