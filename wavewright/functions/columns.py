"""Column helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def in_order(keys: list[str], order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: list[str]):
    return Window.partitionBy(*keys)


def bad(v: Column) -> Column:
    """Null, NaN or infinite."""
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def json_safe(v: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~bad(v), v)


def clip01(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def robust_scale(v: str = "value") -> Column:
    """Aggregate: largest of the exact interquartile range over 1.349, the population deviation and 1e-4."""
    return F.greatest((F.expr(f"percentile({v}, 0.75)") - F.expr(f"percentile({v}, 0.25)")) / 1.349, F.stddev_pop(v), F.lit(1e-4))


def unit_of(hex_text: Column, first: int) -> Column:
    """A number in [0, 1) from 8 hex digits of a digest, beginning at digit ``first`` (from 1)."""
    return F.conv(F.substring(hex_text, first, 8), 16, 10).cast("double") / 4294967296.0


def stable_seed(*parts: Column | str) -> Column:
    """Seed in 0..2**32-1 of parts joined by a bar: the first 4 bytes of their SHA-256, little-endian."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    swapped = F.concat(*(F.substring(digest, p, 2) for p in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("long")


def hash_mod(digest: Column, n: Column) -> Column:
    """The first 16 hex digits of a digest as an unsigned number, modulo n."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def default_if(value: Column, condition: Column, other: Column) -> Column:
    return F.when(condition, other).otherwise(value)
