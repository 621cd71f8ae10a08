"""Casts that never fail, for payloads that hold anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date layouts that are tried in this order; ISO, compact, slashes, then with a time.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def float_or_null(text: Column) -> Column:
    return text.try_cast("double")


def float_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def uint8_or_zero(text: Column) -> Column:
    """An integer from 0 to 255 or else 0; words such as ``true`` are 0."""
    n = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(n.between(0, 255), n).otherwise(0)


def date_or_null(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(f)).cast("date") for f in DATE_FORMATS))


def ratio6(numerator: Column, denominator: Column) -> Column:
    """A rate with six decimals, halves up; 0 without a denominator."""
    n, d = numerator.cast("decimal(20,0)"), F.nullif(denominator, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.round((n / d).cast("decimal(20,10)"), 6), F.lit(0)).cast("double")


def product_round6(x: Column) -> Column:
    """Six decimals of a double that isn't negative, halves of its product with 10^6 up.

    As DuckDB rounds: 41 / 640 is 0.0640625, but its product in doubles lies below the half.
    """
    y = x * 1e6
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / 1e6
