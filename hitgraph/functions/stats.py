"""Statistics as Column expressions: they stay in whole-stage code, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_even_tail(x: Column, k: Column) -> Column:
    """Upper tail of chi-square with 2k degrees at 2x: exp(-x) * sum of x^i / i! for i < k."""
    terms = F.aggregate(
        F.when(k > 1, F.sequence(F.lit(1), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * x / i).alias("term"), (acc["total"] + acc["term"] * x / i).alias("total")),
        lambda acc: acc["total"],
    )
    return F.exp(-x) * terms


def fisher(ps: Column) -> Column:
    """Aggregate: combined p of independent tests; NaN and NULL are skipped."""
    p = F.nanvl(ps.cast("double"), F.lit(None).cast("double"))
    return chi2_even_tail(-F.sum(F.ln(p)), F.count(p))


#: Coefficients of the AS241 approximation to the normal quantile (fixed values).
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner_sql(c: tuple[float, ...], x: str) -> str:
    out = repr(c[-1]) + ("e0" if "e" not in repr(c[-1]) else "")
    for v in reversed(c[:-1]):
        out = f"({out} * {x} + {v!r}{'' if 'e' in repr(v) else 'e0'})"
    return out


def qnorm_sql(p: str) -> str:
    """Normal quantile of p as text that Spark and DuckDB read alike."""
    q, r = f"({p} - 0.5e0)", f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    tail = f"sqrt(-ln(CASE WHEN {p} < 0.5e0 THEN {p} ELSE 1e0 - {p} END))"
    near, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    sign = f"(CASE WHEN {p} < 0.5e0 THEN -1e0 ELSE 1e0 END)"
    return (
        f"(CASE WHEN {p} IS NULL OR {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {q} * {_horner_sql(_A, r)} / {_horner_sql(_B, r)} "
        f"WHEN {tail} <= 5e0 THEN {sign} * {_horner_sql(_C, near)} / {_horner_sql(_D, near)} ELSE {sign} * {_horner_sql(_E, far)} / {_horner_sql(_F, far)} END)"
    )


def qnorm(p: str) -> Column:
    return F.expr(qnorm_sql(p))


def percentile6(sorted_values: Column, p: float) -> Column:
    """Type-6 percentile of a sorted array: place p(c+1), interpolated, clamped; one value is itself."""
    c = F.size(sorted_values)
    place = F.lit(p) * (c + 1)
    low = F.least(F.greatest(F.floor(place), F.lit(1)), c).cast("int")
    high = F.least(low + 1, c).cast("int")
    part = F.when(place <= 1, F.lit(0.0)).when(place >= c, F.lit(0.0)).otherwise(place - F.floor(place))
    a, b = F.element_at(sorted_values, low), F.element_at(sorted_values, high)
    return F.when(c > 0, a + part * (b - a))


def sorted_present(x: Column) -> Column:
    """Aggregate: the values of x, ascending, without NULL and NaN."""
    return F.sort_array(F.collect_list(F.nanvl(x.cast("double"), F.lit(None).cast("double"))))
