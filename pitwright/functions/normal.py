"""The normal distribution as column expressions, and the same text for SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of the upper tail by Hart (1968), good to 15 digits. Fixed values.
UPPER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def cdf(x: Column) -> Column:
    """Null for null; 0 or 1 beyond 37."""
    a = F.abs(x)

    def horner(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    near = F.exp(-a * a / 2) * horner(UPPER) / horner(LOWER)
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    far = F.exp(-a * a / 2) / (tail * 2.506628274631)
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def cdf_sql(x: str) -> str:
    a = f"abs({x})"

    def horner(coefficients):
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    near = f"exp(-{a} * {a} / 2) * {horner(UPPER)} / {horner(LOWER)}"
    tail = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE)))))"
    upper = f"CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547 THEN {near} ELSE exp(-{a} * {a} / 2) / ({tail} * 2.506628274631::DOUBLE) END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE ({upper}) END"
