"""Guards that the other expressions are built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NaN becomes NULL, which aggregates skip."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def ratio(a: Column, b: Column, least: float = 0.0, otherwise: float | None = None) -> Column:
    """a / b where abs(b) > least; elsewhere otherwise, or NULL."""
    return F.when(a.isNull() | b.isNull(), None).when(F.abs(b) > least, a / b).otherwise(F.lit(otherwise).cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def steps(c: Column, bounds: list[float], values: list, otherwise) -> Column:
    """values[i] for the first bounds[i] that c lies under, otherwise beyond the last; NULL for NULL."""
    out = F.when(c.isNull(), None)
    for b, v in zip(bounds, values, strict=True):
        out = out.when(c < b, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def lookup(c: Column, table: dict, otherwise=None) -> Column:
    out = F.when(F.lit(False), None)
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, within 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    # fixed values
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z.isNull(), None).when(z >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The same in SQL."""
    t = f"(1 / (1 + 0.2316419::double * abs({z})))"
    poly = f"{t} * (0.319381530::double + {t} * (-0.356563782::double + {t} * (1.781477937::double + {t} * (-1.821255978::double + {t} * 1.330274429::double))))"
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327::double * {poly})"
    return f"(case when ({z}) >= 0 then 1 - {tail} else {tail} end)"


def uniform(*keys: Column) -> Column:
    """A draw from [0, 1) that the keys alone decide: 32 bits of a digest of their texts, so a task that runs again draws alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_sql(*keys: str) -> str:
    return f"(('0x' || left(md5(concat_ws('|', {', '.join(keys)})), 8))::bigint / 4294967296.0::double)"
