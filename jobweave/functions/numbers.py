"""Rounding rules of the three runtimes the figures come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def round_cents(amount: Column) -> Column:
    """Round to 2 digits by the exact binary value, halves to even.

    ``bround`` works on the shortest decimal form and differs where the binary value lies
    just off a half; the number formatter rounds the exact value.
    """
    return F.call_function("format_number", amount, F.lit("0.00")).cast("double")


def half_up(value: Column) -> Column:
    """floor(x + 0.5), the browser's rounding."""
    return F.floor(value + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """Browser-rounded percentage, 0 where the whole is 0 or missing."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0)).cast("bigint")
