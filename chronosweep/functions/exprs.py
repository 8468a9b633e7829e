"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timeframes, their width in seconds, and the offset of their buckets from the epoch.
TIMEFRAMES = {"M1": (60, 0), "M5": (300, 0), "M15": (900, 0), "M30": (1800, 0), "H1": (3600, 0), "H4": (14400, 0), "D": (86400, 0), "W": (604800, 259200)}


def pip(pair: Column) -> Column:
    return F.when(pair.contains("JPY"), 0.01).otherwise(0.0001)


def bucket(seconds: Column, width: int, offset: int = 0) -> Column:
    """Start of the bucket, left-closed; weeks start on Sunday through their offset."""
    return (F.floor((seconds - offset) / width) * width + offset).cast("long")


def hour_of(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def weekday_of(seconds: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)).cast("int")


def session_id(hour: Column) -> Column:
    """0 Asia, 1 London, 2 New York, 3 overlap of London and New York; null without an hour."""
    return F.when(hour.between(7, 12), 1).when(hour.between(13, 15), 3).when(hour.between(16, 21), 2).when(hour.isNotNull(), 0)


def session_name(hour: Column) -> Column:
    """The cost model's sessions, whose borders differ from those of session_id; null without an hour."""
    return F.when(hour < 8, "Asian").when(hour < 13, "London").when(hour < 17, "Lon-NY").when(hour < 21, "NY").when(hour.isNotNull(), "Rollover")


def time_filter(hour: Column, day: Column, start: Column, end: Column, days: Column) -> Column:
    """Day bit set, and hour within inclusive bounds that may wrap past midnight."""
    inside = F.when(start <= end, hour.between(start, end)).otherwise((hour >= start) | (hour <= end))
    return F.expr("true") & (days.bitwiseAND(F.pow(F.lit(2), day).cast("int")) != 0) & inside


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(none))


def norm_cdf(x: Column) -> Column:
    """Normal distribution function by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    # Coefficients of the approximation.
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - p * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def uniform(seed: int, key: Column, path: str) -> Column:
    """A number in [0, 1) that depends only on seed, key and path."""
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(path))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967296.0


# Coefficients of the rational approximation of the inverse normal distribution function, centre and tails.
PPF_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
PPF_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
PPF_LOW = 0.02425


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """By Horner's rule, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function, for p strictly between 0 and 1."""
    tail = lambda x: (lambda q: polynomial(PPF_TAIL[0], q) / polynomial(PPF_TAIL[1], q))(F.sqrt(-2.0 * F.ln(x)))
    q = p - 0.5
    return F.when(p < PPF_LOW, tail(p)).when(p > 1 - PPF_LOW, -tail(1 - p)).otherwise(polynomial(PPF_CENTRE[0], q * q) * q / polynomial(PPF_CENTRE[1], q * q))


def nice_round(x: Column) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten; 0.1 for what isn't positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(x > 0, x))))
    base = x / power
    return F.when(x <= 0, 0.1).otherwise(F.when(base < 1.5, 1).when(base < 3.5, 2).when(base < 7.5, 5).otherwise(10) * power)
