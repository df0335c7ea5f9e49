"""Measures of 2x2 tables, as columns over rows with counts a, b, c, d."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.functions.distributions import Z95, bind, chi2_sf, fisher_p, ratio, wilson

col = F.col


def table2x2(df: DataFrame, exposed: Column, outcome: Column, by: list[str] | None = None) -> DataFrame:
    """a, b (exposed with and without outcome), c, d (not exposed) per group; rows with a null condition don't count."""
    rows = df.where(exposed.isNotNull() & outcome.isNotNull())
    n = lambda x: F.count_if(x)
    return rows.groupBy(*(by or [])).agg(n(exposed & outcome).alias("a"), n(exposed & ~outcome).alias("b"), n(~exposed & outcome).alias("c"), n(~exposed & ~outcome).alias("d"))


def problem() -> Column:
    """Why a table can't be analysed, null if it can."""
    cells = [col(x) for x in "abcd"]
    a, b, c, d = cells
    unfit = F.exists(F.array(*[x.cast("double") for x in cells]), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x != F.floor(x)))
    return (
        F.when(unfit, "Counts must be whole numbers, zero or more.")
        .when((a + b == 0) | (c + d == 0), "Each group needs at least one person.")
        .when((a + c == 0) & (b + d == 0), "Enter some counts.")
    )


def _interval(log_value: Column, se: Column) -> list[Column]:
    return [F.exp(log_value), F.exp(log_value - Z95 * se), F.exp(log_value + Z95 * se)]


def risk(tables: DataFrame, p: bool = True) -> DataFrame:
    """Risk and odds ratio, risk difference, number needed, chi-square (and exact p) of each table.

    Ratios add a half to every cell if one is zero; the difference uses the counts as they are. The number needed has
    no interval where the difference's interval includes zero. Measures of a table with an empty group are null; an
    empty column adds nothing to chi-square.
    """
    a, b, c, d = (col(x).cast("double") for x in "abcd")
    zero = F.least(a, b, c, d) == 0
    h = F.when(zero, 0.5).otherwise(0.0)
    a1, b1, c1, d1 = a + h, b + h, c + h, d + h
    rr = _interval(F.log(a1 / (a1 + b1)) - F.log(c1 / (c1 + d1)), F.sqrt(1 / a1 - 1 / (a1 + b1) + 1 / c1 - 1 / (c1 + d1)))
    odds = _interval(F.log(a1 * d1 / (b1 * c1)), F.sqrt(1 / a1 + 1 / b1 + 1 / c1 + 1 / d1))
    r1, r0 = ratio(a, a + b), ratio(c, c + d)
    rd, se = r1 - r0, F.sqrt(ratio(r1 * (1 - r1), a + b) + ratio(r0 * (1 - r0), c + d))
    lo, hi = rd - Z95 * se, rd + Z95 * se
    n = a + b + c + d
    both = (a + b > 0) & (c + d > 0)
    chi = F.when(both, F.coalesce(ratio(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d)), F.lit(0.0)))
    least = F.when(both, F.least(a + b, c + d) * F.least(a + c, b + d) / n)
    sure = (lo > 0) | (hi < 0)
    out = tables.select(
        "*", wilson(a, a + b).alias("risk1_ci"), wilson(c, c + d).alias("risk0_ci"), r1.alias("risk1"), r0.alias("risk0"),
        *[F.when(both, x).alias(k) for k, x in zip(("rr", "rr_lo", "rr_hi"), rr, strict=True)], *[F.when(both, x).alias(k) for k, x in zip(("odds", "odds_lo", "odds_hi"), odds, strict=True)],
        rd.alias("rd"), lo.alias("rd_lo"), hi.alias("rd_hi"), ratio(F.lit(1.0), F.abs(rd)).alias("nn"), F.when(rd < 0, "benefit").when(rd > 0, "harm").alias("nn_kind"),
        F.when(sure, ratio(F.lit(1.0), F.greatest(F.abs(lo), F.abs(hi)))).alias("nn_lo"), F.when(sure, ratio(F.lit(1.0), F.least(F.abs(lo), F.abs(hi)))).alias("nn_hi"),
        zero.alias("corrected"), chi.alias("chi2"), least.alias("least_expected"), (least < 5).alias("small_expected"),
    )
    return out.withColumn("chi2_p", chi2_sf(col("chi2"), F.lit(1.0))).withColumn("fisher_p", fisher()) if p else out


def fisher() -> Column:
    """Two-sided exact p: the tables with the same margins that are no likelier than this one."""
    return fisher_p(*[col(x) for x in "abcd"])


def diagnostic(tables: DataFrame) -> DataFrame:
    """Accuracy of a test from a = true positives, b = false positives, c = false negatives, d = true negatives.

    What divides by zero is null: likelihood ratios, their intervals and the odds ratio included.
    """
    tp, fp, fn, tn = (col(x).cast("double") for x in "abcd")
    sens, spec = ratio(tp, tp + fn), ratio(tn, fp + tn)
    plus, minus = ratio(sens, 1 - spec), ratio(1 - sens, spec)
    spread = lambda x, n: ratio(F.lit(1.0), x) - ratio(F.lit(1.0), n)
    se_plus, se_minus = F.sqrt(spread(tp, tp + fn) + spread(fp, fp + tn)), F.sqrt(spread(fn, tp + fn) + spread(tn, fp + tn))
    ends = lambda name, value, se: [(value * F.exp(sign * Z95 * se)).alias(f"{name}_{end}") for sign, end in ((-1, "lo"), (1, "hi"))]
    return tables.select(
        "*", sens.alias("sens"), spec.alias("spec"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, fn + tn).alias("npv"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp + fn, tp + fp + fn + tn).alias("prevalence"),
        wilson(tp, tp + fn).alias("sens_ci"), wilson(tn, fp + tn).alias("spec_ci"),
        plus.alias("lr_plus"), *ends("lr_plus", plus, se_plus), minus.alias("lr_minus"), *ends("lr_minus", minus, se_minus), ratio(tp * tn, fp * fn).alias("dor"),
    )


def post_test(prior: Column, likelihood: Column) -> Column:
    """Probability after a test with a likelihood ratio; a certain prior stays certain."""
    return F.when((prior >= 1) & likelihood.isNotNull(), 1.0).otherwise(bind(ratio(prior, 1 - prior) * likelihood, lambda odds: odds / (1 + odds)))


def predictive_values(sens: Column, spec: Column, prevalence: Column) -> Column:
    """struct(ppv, npv) at a prevalence."""
    tp, fp = sens * prevalence, (1 - spec) * (1 - prevalence)
    fn, tn = (1 - sens) * prevalence, spec * (1 - prevalence)
    return F.struct(ratio(tp, tp + fp).alias("ppv"), ratio(tn, fn + tn).alias("npv"))
