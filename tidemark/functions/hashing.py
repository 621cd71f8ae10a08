"""Portable hashes: the same values in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_eight(text: Column) -> Column:
    """The first 8 bytes of the SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_bucket(text: Column, n: int) -> Column:
    return F.pmod(first_eight(text), F.lit(n).cast("decimal(20,0)")).cast("int")


def signed_coordinate(text: Column) -> tuple[Column, Column]:
    """Bucket of 16 (from the first 8 bytes) and sign (from the ninth byte's low bit) of a text."""
    digest = F.sha2(text, 256)
    bucket = F.conv(F.substring(digest, 16, 1), 16, 10).cast("int")
    odd = F.pmod(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int"), F.lit(2)) == 1
    return bucket, F.when(odd, -1.0).otherwise(1.0)


def row_checksums(*columns: Column) -> tuple[Column, Column]:
    """Aggregates that don't depend on row order: the wrapping sum and the XOR of the rows' hashes.

    The hash is the first 15 hex digits of an MD5, so that the values fit a long everywhere.
    """
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))), 1, 15), 16, 10)
    total = F.pmod(F.sum(own.cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint")
    return total, F.bit_xor(own.cast("bigint"))
