"""Identifiers, gates and verdicts: small decisions on the driver."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(value: Any) -> str:
    """SHA-256 of a value's canonical JSON, so that equal specifications have equal hashes."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stable_id(prefix: str, *parts: str) -> str:
    """A name-based id: the same for the same parts."""
    return f"{prefix}_{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(parts)).hex}"


def request_fingerprint(run: str, design: str, days: int | None) -> str:
    """Of an assignment request, so that a repeated one is known."""
    return canonical_hash({"promotion_run_id": run, "experiment_design_fingerprint": design, "expires_in_days": days})


def input_fingerprint(bindings: Sequence[Mapping[str, Any]]) -> str:
    """Of the audiences that an assignment reads, in whatever order they are given."""
    return canonical_hash({"audience_bindings": sorted(map(dict, bindings), key=lambda b: (str(b.get("segment_id")), str(b.get("audience_snapshot_id"))))})


def execution_id(run: str, request: str) -> str:
    return "assign_exec_" + canonical_hash({"promotion_run_id": run, "request_fingerprint": request})[:48]


def unit_ids(run: Column, user: Column) -> Column:
    """Ids of experiment units: the hash of the run and user as canonical JSON."""
    named = F.to_json(F.struct(run.cast("string").alias("promotion_run_id"), user.cast("string").alias("user_id")))
    return F.concat(F.lit("adunit_"), F.substring(F.sha2(named, 256), 1, 56))


# The least counts of an uplift validation.
VALIDATION_MINIMA = {
    "completed_experiments": 20,
    "treatment_observations": 1000,
    "control_observations": 1000,
    "positive_treatment_outcomes": 30,
    "positive_control_outcomes": 30,
}


def validation_gate(counts: Mapping[str, int], metrics: Mapping[str, float | None]) -> list[str]:
    """The rules that an uplift model fails; none if it may go on to approval."""

    def above(a: float | None, b: float | None) -> bool:
        return a is not None and b is not None and math.isfinite(a) and math.isfinite(b) and a > b

    failed = [k for k, least in VALIDATION_MINIMA.items() if counts.get(k, 0) < least]
    if not above(metrics.get("qini"), 0.0):
        failed.append("qini_above_zero")
    if not above(metrics.get("auuc"), metrics.get("auuc_baseline")):
        failed.append("auuc_above_baseline")
    return failed


@dataclass(frozen=True)
class Selection:
    selected: int
    applied_ratio: float
    reason: str | None


def select_share(matching: int, ratio: float, minimum: int, validated: bool = True) -> Selection:
    """How many of the matching users a validated policy selects; all of them where it doesn't apply."""
    if matching < 0:
        raise ValueError("matching must not be negative")
    if matching == 0:
        return Selection(0, 1.0, "empty_candidate")
    if not validated:
        return Selection(matching, 1.0, "policy_not_validated")
    wanted = min(matching, max(1, math.ceil(matching * ratio)))
    if wanted < minimum:
        return Selection(matching, 1.0, "minimum_selected_user_count_not_met")
    return Selection(wanted, wanted / matching, None)


def choose_ratio(lifts: Mapping[float, float], captures: Mapping[float, float], least_capture: float) -> float:
    """The ratio of highest lift among those that keep enough of the outcomes; everyone if none does."""
    fit = [r for r in lifts if captures.get(r, 0.0) >= least_capture and lifts[r] > 0]
    return max(fit, key=lambda r: (lifts[r], r)) if fit else 1.0


@dataclass(frozen=True)
class Criterion:
    """A bound on a figure, which speaks for the evidence or for the quality."""

    figure: str
    operator: str
    bound: float
    evidence: bool = False

    def passed(self, figures: Mapping[str, float | None]) -> bool:
        value = figures.get(self.figure)
        if self.operator not in (">=", "<=", ">"):
            raise ValueError(f"unknown operator: {self.operator}")
        if value is None:
            return False
        return value >= self.bound if self.operator == ">=" else value <= self.bound if self.operator == "<=" else value > self.bound


def verdict(criteria: Sequence[Criterion], figures: Mapping[str, float | None]) -> str:
    """inconclusive without evidence, or if any of it fails; else passed if everything passes, or failed."""
    evidence = [c for c in criteria if c.evidence]
    if not evidence or not all(c.passed(figures) for c in evidence):
        return "inconclusive"
    return "passed" if all(c.passed(figures) for c in criteria) else "failed"
