"""Time in units of a rational number of seconds."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rational:
    """num / den in lowest terms, den above 0."""

    num: int
    den: int = 1

    def __post_init__(self) -> None:
        if self.den == 0:
            raise ValueError("a timebase needs a denominator")
        g = gcd(self.num, self.den) * (-1 if self.den < 0 else 1)
        object.__setattr__(self, "num", self.num // g)
        object.__setattr__(self, "den", self.den // g)

    def __mul__(self, other: Rational) -> Rational:
        return Rational(self.num * other.num, self.den * other.den)

    def __truediv__(self, other: Rational) -> Rational:
        return Rational(self.num * other.den, self.den * other.num)

    def __lt__(self, other: Rational) -> bool:
        return self.num * other.den < other.num * self.den

    def seconds(self, pts: int) -> float:
        return pts * self.num / self.den

    def rescaled(self, pts: int, to: Rational) -> int:
        """pts in units of `to`, halves up."""
        r = self / to
        return (2 * pts * r.num + r.den) // (2 * r.den)


def nanoseconds(pts: Column, num: Column, den: Column) -> Column:
    """Whole seconds and the rest apart, so that products stay within 64 bits."""
    n = pts.cast("decimal(38,0)") * num.cast("decimal(10,0)")
    return F.floor(n * F.lit(1_000_000_000).cast("decimal(10,0)") / den.cast("decimal(19,0)")).cast("long")


def rescaled(pts: Column, base: Rational, to: Rational) -> Column:
    """Rational.rescaled() as an expression; floor division for negative times too."""
    r = base / to
    n = pts * (2 * r.num) + r.den
    d = 2 * r.den
    return F.floor((n - F.pmod(n, F.lit(d).cast("long"))) / F.lit(d)).cast("long")
