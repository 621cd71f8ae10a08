"""Randomised holdouts."""

from __future__ import annotations

import hashlib
import hmac
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import group_rank


def hmac_key(salt: str, *parts: Column) -> Column:
    """Hex HMAC-SHA256 of the parts joined by unit separators, by its definition over SHA-256; null if a part is."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key) for x in (0x36, 0x5C))
    known = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
    message = F.when(known, F.concat_ws("\x1f", *(p.cast("string") for p in parts))).cast("binary")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def hmac_plain(salt: str, *parts: str) -> str:
    return hmac.new(salt.encode(), "\x1f".join(parts).encode(), hashlib.sha256).hexdigest()


def holdout(members: DataFrame, experiment: str, user: str, ratio: float, salt: str | None = None, context: tuple[str, ...] = ()) -> DataFrame:
    """``members`` with arm and treatment_probability.

    Of each experiment's users in HMAC order (id order without a salt) the first
    ``floor(n * ratio + 0.5)`` are treated, at least one and at most all but one;
    the probability is the share that results.  A null comes last.  Experiments of fewer than two
    users have no arm.  The ratio is the decimal that is written, not the double
    next to it: 45 * 0.7 + 0.5 is 32, in doubles less.
    """
    keys = [] if salt is None else [hmac_key(salt, *(F.lit(c) for c in context), F.col(experiment), F.col(user))]
    ranked = group_rank(members, [experiment], [k.asc_nulls_last() for k in (*keys, F.col(user))])
    halves_up = F.floor(F.col("_n").cast("decimal(15,0)") * F.lit(Decimal(str(ratio))) + F.lit(Decimal("0.5"))).cast("long")
    quota = F.least(F.greatest(halves_up, F.lit(1)), F.col("_n") - 1)
    arm = F.when(F.col("_n") >= 2, F.when(F.col("_rank") <= quota, "treatment").otherwise("control"))
    return ranked.withColumn("arm", arm).withColumn("treatment_probability", F.when(F.col("_n") >= 2, quota / F.col("_n"))).drop("_rank", "_n")
