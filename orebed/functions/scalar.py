"""Scalar expressions on columns: geometry, bins, statistics.  All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Wichura's algorithm AS 241 (PPND16, 1988), lowest power first.
PPND_A = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
PPND_B = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
PPND_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
PPND_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
PPND_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPND_F = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner(r: str, coefficients: tuple[float, ...]) -> str:
    text = repr(coefficients[-1]) + "e0" * ("e" not in repr(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {r} + {c!r}{'e0' * ('e' not in repr(c))})"
    return text


def inverse_normal_sql(p: str) -> str:
    """The standard normal quantile of an SQL expression; the same text serves Spark and DuckDB."""
    q, tail = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    middle = f"(0.180625e0 - {q} * {q})"
    near, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    return (
        f"CASE WHEN {p} IS NULL OR {p} <= 0e0 OR {p} >= 1e0 THEN NULL "
        f"WHEN abs({q}) <= 0.425e0 THEN {q} * {_horner(middle, PPND_A)} / {_horner(middle, PPND_B)} "
        f"WHEN {tail} <= 5e0 THEN sign({q}) * {_horner(near, PPND_C)} / {_horner(near, PPND_D)} "
        f"ELSE sign({q}) * {_horner(far, PPND_E)} / {_horner(far, PPND_F)} END"
    )


def inverse_normal(p: str) -> Column:
    """Standard normal quantile of a column by name; null outside (0, 1)."""
    return F.expr(inverse_normal_sql(p))


def unit_vector(azimuth: Column, dip: Column, dip_down: bool = True) -> tuple[Column, Column, Column]:
    """East, north, up of a direction in degrees; with dip_down a positive dip points down."""
    az, d = F.radians(azimuth), F.radians(dip)
    return F.sin(az) * F.cos(d), F.cos(az) * F.cos(d), F.sin(d) * (-1.0 if dip_down else 1.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def axis_angle(a: Column, b: Column) -> Column:
    """Difference of two azimuths as undirected axes, 0 to 90 degrees."""
    return F.abs(F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0)


def bend(inc0: Column, az0: Column, inc1: Column, az1: Column) -> Column:
    """Angle between two directions given as inclination from vertical and azimuth, radians."""
    dot = F.cos(inc1 - inc0) - F.sin(inc0) * F.sin(inc1) * (1 - F.cos(az1 - az0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def ratio_factor(angle: Column) -> Column:
    """Minimum-curvature factor; 1 for a straight segment."""
    return F.when(angle < 1e-6, F.lit(1.0)).otherwise(2.0 / angle * F.tan(angle / 2))


def ratio(n: Column, d: Column, least: float = 1e-9) -> Column:
    """n / d, null where d is next to nothing."""
    return F.when(F.abs(d) > least, n / d)


def half_width(low: Column, mid: Column, high: Column) -> Column:
    """Larger distance from the middle, relative to it."""
    return F.greatest(F.abs(high - mid), F.abs(mid - low)) / F.greatest(F.abs(mid), F.lit(1e-9))


def entropy(shares: list[Column]) -> Column:
    """Shannon entropy of shares, from 0 to 1: natural logarithm over that of their number."""
    clipped = [F.greatest(s, F.lit(1e-12)) for s in shares]
    total = clipped[0] * F.log(clipped[0])
    for c in clipped[1:]:
        total = total + c * F.log(c)
    return -total / math.log(len(shares))


def floor_bin(x: Column, origin: Column | float, step: float) -> Column:
    """Left-closed bin, counted from the origin."""
    return F.floor((x - origin) / step).cast("long")


def even_bin(x: Column, origin: Column | float, step: float) -> Column:
    """Nearest grid node; halves go to the even one."""
    return F.rint((x - origin) / step).cast("long")


def cleaned(c: Column) -> Column:
    """Trimmed text; empty text and the spellings of nothing become null."""
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "None"), t)


def number(c: Column) -> Column:
    """Text as a double; what can't be read, and not-a-number, become null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)
