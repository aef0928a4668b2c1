"""Statistics as Column expressions over ordered value arrays (JVM side, no Python).

A history is an `array<double>` ordered oldest -> newest, bounded by the history
length N (20 by default), so each row stays small whatever the input volume.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method (statistical anomaly requirements).
LOGIT_CLAMP_LOW = 0.001
LOGIT_CLAMP_HIGH = 0.999
MAD_CONSISTENCY = 1.4826
HOLT_ALPHA = 0.3
HOLT_BETA = 0.1
Z95 = 1.96
Z80 = 1.28
FAMILY_ALPHA_ELEVATED = 0.05
FAMILY_ALPHA_CRITICAL = 0.005


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def logit(p: Column) -> Column:
    """ln(c / (1 - c)) with c clamped to [0.001, 0.999] (UDF-1 as an expression)."""
    c = F.greatest(F.lit(LOGIT_CLAMP_LOW), F.least(F.lit(LOGIT_CLAMP_HIGH), p.cast("double")))
    return F.ln(c / (F.lit(1.0) - c))


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def arr_mean(a: Column) -> Column:
    return arr_sum(a) / F.size(a)


def arr_sd(a: Column) -> Column:
    """Sample SD (ddof = 1); NULL for fewer than 2 values."""
    m = arr_mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    return F.when(F.size(a) > 1, F.sqrt(ss / (F.size(a) - 1)))


def arr_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    mid = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.element_at(s, mid + 1)) \
        .otherwise((F.element_at(s, F.greatest(mid, F.lit(1))) + F.element_at(s, mid + 1)) / 2.0)


def arr_mad(a: Column, scale: float = MAD_CONSISTENCY) -> Column:
    med = arr_median(a)
    return F.lit(scale) * arr_median(F.transform(a, lambda x: F.abs(x - med)))


def ols(a: Column) -> Column:
    """OLS of value on index 0..n-1: struct(slope, r_squared, slope_normalized).

    n < 3 -> zeros (insufficient). slope = Sxy / Sxx; R² = 1 - SSres / SStot.
    """
    n = F.size(a)
    idx = F.sequence(F.lit(0), n - 1)
    xm = (n - 1) / 2.0
    ym = arr_mean(a)
    pairs = F.arrays_zip(idx.alias("x"), a.alias("y"))
    sxy = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - xm) * (p["y"] - ym))
    sxx = F.aggregate(idx, F.lit(0.0), lambda acc, x: acc + (x - xm) * (x - xm))
    slope = F.when(sxx > 0, sxy / sxx).otherwise(F.lit(0.0))
    ss_res = F.aggregate(pairs, F.lit(0.0),
                         lambda acc, p: acc + F.pow(p["y"] - (ym + slope * (p["x"] - xm)), 2))
    ss_tot = F.aggregate(a, F.lit(0.0), lambda acc, y: acc + (y - ym) * (y - ym))
    r2 = F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot).otherwise(F.lit(0.0))
    sd = arr_sd(a)
    norm = F.when(sd > 0, slope / sd).otherwise(F.lit(0.0))
    short = n < 3
    return F.struct(F.when(short, 0.0).otherwise(slope).alias("slope"),
                    F.when(short, 0.0).otherwise(r2).alias("r_squared"),
                    F.when(short, 0.0).otherwise(norm).alias("slope_normalized"))


def holt(a: Column, alpha: float = HOLT_ALPHA, beta: float = HOLT_BETA) -> Column:
    """Holt linear smoothing as an ordered fold: struct(level, trend, sse, n_res).

    level_0 = y_0, trend_0 = (y_k - y_0)/k with k = min(2, n-1); for each later y:
    e = y - (l + b); l' = α y + (1-α)(l + b); b' = β (l' - l) + (1-β) b.
    Fewer than 3 points: flat at the last value.
    """
    n = F.size(a)
    k = F.least(F.lit(2), n - 1)
    y0 = F.try_element_at(a, F.lit(1))
    init = F.struct(y0.alias("level"),
                    F.try_divide(F.try_element_at(a, k + 1) - y0, k).alias("trend"),
                    F.lit(0.0).alias("sse"), F.lit(0).alias("n_res"))

    def step(s, y):
        pl, pt = s["level"], s["trend"]
        lvl = F.lit(alpha) * y + F.lit(1 - alpha) * (pl + pt)
        return F.struct(lvl.alias("level"),
                        (F.lit(beta) * (lvl - pl) + F.lit(1 - beta) * pt).alias("trend"),
                        (s["sse"] + (y - (pl + pt)) * (y - (pl + pt))).alias("sse"),
                        (s["n_res"] + 1).alias("n_res"))

    fold = F.aggregate(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), init, step)
    flat = F.struct(F.element_at(a, -1).alias("level"), F.lit(0.0).alias("trend"),
                    F.lit(0.0).alias("sse"), F.lit(0).alias("n_res"))
    return F.when(n < 3, flat).otherwise(fold)


def residual_se(h: Column) -> Column:
    """sqrt(Σe² / (n_res - 1)) = sqrt(Σe² / (n - 2)); 0 with fewer than 2 residuals."""
    return F.when(h["n_res"] >= 2, F.sqrt(h["sse"] / (h["n_res"] - 1))).otherwise(F.lit(0.0))


# Inverse standard normal CDF, rational approximation with relative error < 1.2e-9
# (P. J. Acklam's published coefficients; fixed values).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_P_LOW = 0.02425


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_norm(p: Column) -> Column:
    q_lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    lo = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + F.lit(1.0))
    q = p - 0.5
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    hi = -(_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + F.lit(1.0)))
    return F.when(p < _P_LOW, lo).when(p <= 1 - _P_LOW, mid).otherwise(hi)


def bonferroni(n_tests: Column) -> Column:
    """struct(alpha, elevated, critical): one-sided z at 0.05/N and 0.005/N (ANO-8)."""
    n = n_tests.cast("double")
    return F.struct((F.lit(FAMILY_ALPHA_ELEVATED) / n).alias("alpha"),
                    inv_norm(F.lit(1.0) - F.lit(FAMILY_ALPHA_ELEVATED) / n).alias("elevated"),
                    inv_norm(F.lit(1.0) - F.lit(FAMILY_ALPHA_CRITICAL) / n).alias("critical"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length numeric arrays (zip_with + aggregate)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, na * nb)


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a string of digits, as a fold over the reversed digit array."""
    arr = F.transform(F.reverse(F.split(digits, "")), lambda ch: ch.cast("int"))
    idx = F.sequence(F.lit(0), F.size(arr) - 1)
    z = F.arrays_zip(idx.alias("i"), arr.alias("d"))
    total = F.aggregate(z, F.lit(0), lambda s, p: s + F.when(
        p["i"] % 2 == 1, F.when(p["d"] * 2 > 9, p["d"] * 2 - 9).otherwise(p["d"] * 2)).otherwise(p["d"]))
    return (total % 10) == 0
