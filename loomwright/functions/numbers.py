"""Exact numbers and bytes: reduced fractions, little-endian arrays, money, path folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers, by at most 96 Euclidean steps."""
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step)["x"]


def reduced(numerator: Column, denominator: Column) -> Column:
    """A fraction as ``struct<num, den>`` in lowest terms with a positive denominator; null over zero."""
    divisor = F.nullif(gcd(numerator, denominator), F.lit(0))
    sign = F.when(denominator < 0, -1).otherwise(1)
    return F.when(
        denominator != 0,
        F.struct(
            (sign * numerator / divisor).cast("bigint").alias("num"),
            (sign * denominator / divisor).cast("bigint").alias("den"),
        ),
    )


def u32_le(values: Column) -> Column:
    """Whole numbers below 2^32 as little-endian bytes."""

    def four(v: Column) -> Column:
        h = F.lpad(F.hex(v.cast("bigint")), 8, "0")
        return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])

    return F.unhex(F.array_join(F.transform(values, four), ""))


def from_u32_le(data: Column) -> Column:
    """The numbers of little-endian bytes; null unless the length is a multiple of four."""
    h = F.hex(data)
    count = F.floor(F.octet_length(data) / 4).cast("int")

    def one(i: Column) -> Column:
        piece = lambda k: F.substring(h, i * 8 + k, F.lit(2))
        return F.conv(F.concat(piece(7), piece(5), piece(3), piece(1)), 16, 10).cast("bigint")

    numbers = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(F.octet_length(data) % 4 == 0, numbers)


def micro_units(amount: Column) -> Column:
    """Decimal money as whole micro-units, rounded up, never down."""
    return F.ceil(amount.cast("decimal(28,10)") * 1_000_000).cast("bigint")


def normal_path(path: Column) -> Column:
    """A POSIX path with its ``.`` and ``..`` parts folded; what leads outside keeps its ``..``."""
    empty = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = (F.size(held) > 0) & (F.element_at(F.concat(F.array(F.lit("")), held), -1) != "..")
        return (
            F.when(part.isin("", "."), held)
            .when((part == "..") & up, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
            .otherwise(F.concat(held, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
