"""Distribution functions as column functions, for p-values and intervals of aggregated rows.

Tails come from :mod:`litforge.functions.special` in one Arrow batch each, so small p-values keep their digits. Put them
after aggregation: they are meant for few rows. An argument that is null or no number gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.core.text import bind  # noqa: F401  (used with these functions)
from litforge.functions import special

#: Fixed value: the 97.5 % point of the standard normal distribution.
Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _column(function: Callable[..., float]) -> Callable[..., Column]:
    def run(*arguments: pd.Series) -> pd.Series:
        rows = zip(*arguments, strict=True)
        return pd.Series([function(*row) if all(math.isfinite(x) for x in row) else math.nan for row in rows], dtype="float64")

    run.__annotations__ = {"arguments": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, T.DoubleType())
    return lambda *columns: F.nanvl(udf(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for x in columns]), F.lit(None).cast("double"))


lgamma = _column(special.lgamma)
log_choose = _column(special.log_choose)
gamma_p = _column(lambda a, x: special.gamma_tails(a, x)[0])
gamma_q = _column(lambda a, x: special.gamma_tails(a, x)[1])
beta_i = _column(special.beta_tail)
norm_cdf = _column(special.norm_cdf)
norm_p2 = _column(special.norm_p2)
norm_quantile = _column(special.norm_quantile)
t_p2 = _column(special.t_p2)
t_cdf = _column(special.t_cdf)
t_quantile = _column(special.t_quantile)
chi2_sf = _column(special.chi2_sf)
f_sf = _column(special.f_sf)
fisher_p = _column(special.fisher_p)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi): Wilson interval of a proportion, null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n.isNotNull(), F.struct(F.greatest(centre - half, F.lit(0.0)).alias("lo"), F.least(centre + half, F.lit(1.0)).alias("hi")))
