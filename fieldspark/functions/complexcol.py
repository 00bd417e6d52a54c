"""Complex numbers as pairs of double columns.

Spark has no complex type.  ``C`` pairs two columns and builds plain Catalyst
expressions, so complex arithmetic stays inside whole-stage code generation.
Division by zero gives NULL (ANSI mode would raise), as does anything missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class C:
    re: Column
    im: Column

    @staticmethod
    def of(name: str) -> C:
        return C(F.col(f"{name}_re"), F.col(f"{name}_im"))

    @staticmethod
    def lit(z: complex) -> C:
        return C(F.lit(float(z.real)), F.lit(float(z.imag)))

    def __add__(self, o: C) -> C:
        return C(self.re + o.re, self.im + o.im)

    def __sub__(self, o: C) -> C:
        return C(self.re - o.re, self.im - o.im)

    def __mul__(self, o: C | Column | float) -> C:
        if isinstance(o, C):
            return C(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)
        return C(self.re * o, self.im * o)

    def __truediv__(self, o: C | Column) -> C:
        if isinstance(o, C):
            n = self * o.conj()
            d = o.abs2()
            return C(F.try_divide(n.re, d), F.try_divide(n.im, d))
        return C(F.try_divide(self.re, o), F.try_divide(self.im, o))

    def __neg__(self) -> C:
        return C(-self.re, -self.im)

    def conj(self) -> C:
        return C(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)

    def sum(self) -> C:
        return C(F.sum(self.re), F.sum(self.im))

    def avg(self) -> C:
        return C(F.avg(self.re), F.avg(self.im))

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))

    def named(self, name: str) -> list[Column]:
        return [self.re.alias(f"{name}_re"), self.im.alias(f"{name}_im")]

    def finite(self) -> Column:
        ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return ok(self.re) & ok(self.im)


def solve2(a: list[list[C]], y: list[C]) -> list[C]:
    """Solution of a 2 x 2 complex system by Cramer's rule; NULL where singular."""
    det = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return [(y[0] * a[1][1] - a[0][1] * y[1]) / det, (a[0][0] * y[1] - y[0] * a[1][0]) / det]


def clean(c: Column, digits: int) -> Column:
    """Rounded, with minus zero as zero, for comparisons across engines."""
    return F.round(c, digits) + F.lit(0.0)
