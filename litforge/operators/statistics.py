"""Descriptive statistics and tests. Every test reduces the data to a few sums in one or two shuffles first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.core.frames import join_on
from litforge.functions import distributions as d

c = F.col
#: Ranges that a running sum is taken in.
RANGES = 64


def prefix(rows: DataFrame, order: str, weight: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``rows`` with column before: the sum of ``weight`` over smaller values of the numeric ``order``, within ``by``.

    A running sum in ranges: their edges are approximate quantiles of each group (a sketch of bounded size, combined
    map-side), each range is summed by itself and shifted by the sums of the ranges before it, at most ``ranges`` rows a
    group. So neither the whole table nor one group that holds most of it is summed by one task. Values of ``order`` must be
    distinct within a group.
    """
    by = by or []
    cuts = F.percentile_approx(c(order).cast("double"), [i / ranges for i in range(1, ranges)], 1000)
    edges = rows.groupBy(*by).agg(cuts.alias("__edges"))
    # without groups the edges are one row, with groups the join is on the group and left to the optimizer
    joined = join_on(rows, edges, by) if by else rows.crossJoin(F.broadcast(edges))
    placed = joined.withColumn("__b", F.size(F.filter("__edges", lambda e: e <= c(order)))).drop("__edges")
    sums = placed.groupBy(*by, "__b").agg(F.sum(weight).alias("__s"))
    upto = F.sum("__s").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b"))
    shift = sums.select(*by, "__b", (upto - c("__s")).alias("__shift"))
    inside = F.sum(weight).over(Window.partitionBy(*by, "__b").orderBy(order)) - c(weight)
    return join_on(placed.withColumn("before", inside), shift, [*by, "__b"]).withColumn("before", c("before") + c("__shift")).drop("__b", "__shift")


def quantiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact type-7 quantiles per group, one column per entry of ``points`` (name: probability).

    Equal values are counted together, their places come from :func:`prefix`, and the two values that a quantile lies
    between are picked by one aggregation; no task holds the values of a group.
    """
    by = by or []
    counts = df.select(*by, c(value).cast("double").alias("__x")).where(c("__x").isNotNull() & ~F.isnan("__x")).groupBy(*by, "__x").agg(F.count("*").alias("__n"))
    placed = prefix(counts, "__x", "__n", by)
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    joined = join_on(placed, total, by) if by else placed.crossJoin(F.broadcast(total))
    at = {name: (c("__total") - 1) * F.lit(p) for name, p in points.items()}
    holds = lambda place: F.max(F.when((c("before") <= place) & (place < c("before") + c("__n")), c("__x")))
    ends = lambda h: (("lo", F.floor(h)), ("hi", F.ceil(h)))
    picked = joined.groupBy(*by).agg(F.max("__total").alias("__total"), *[holds(place).alias(f"__{end}_{name}") for name, h in at.items() for end, place in ends(h)]).where(c("__total") > 0)
    blend = lambda name, h: (c(f"__lo_{name}") + (h - F.floor(h)) * (c(f"__hi_{name}") - c(f"__lo_{name}"))).alias(name)
    return picked.select(*by, *[blend(name, h) for name, h in at.items()])


def describe(df: DataFrame, value: str, by: list[str] | None = None, interval: bool = False) -> DataFrame:
    """n, mean, sd, se, median, q1, q3, min, max per group (type-7 quantiles); with ``interval`` the t interval of the mean.

    Nulls and NaN don't count; sd and se of one value are null; groups without values have no row.
    """
    by = by or []
    x = c(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")).where(c("n") > 0)
    middle = quantiles(rows, value, {"median": 0.5, "q1": 0.25, "q3": 0.75}, by)
    out = join_on(sums, middle, by) if by else sums.crossJoin(F.broadcast(middle))  # one row each
    out = out.select(*by, "n", "mean", "sd", (c("sd") / F.sqrt("n")).alias("se"), "median", "q1", "q3", "min", "max")
    if interval:
        half = d.t_quantile(F.lit(0.975), c("n") - 1) * c("se")
        out = out.withColumn("ci_lo", c("mean") - half).withColumn("ci_hi", c("mean") + half)
    return out


def upper_median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The element at position floor(n / 2) of the sorted values, never between two of them."""
    by = by or []
    counts = df.where(c(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = prefix(counts, value, "n", by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = join_on(upto, total, by) if by else upto.crossJoin(F.broadcast(total))
    place = F.floor(c("total") / 2)
    return joined.where((c("before") <= place) & (place < c("before") + c("n"))).select(*by, c(value).alias("median"), c("total").alias("n"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """bin, lo, hi, n: Sturges bins (3 to 20), the last one closed, empty ones included."""
    x = c(value).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    span = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where(c("n") > 0)
    bins = F.least(F.greatest(F.ceil(F.log2("n") + 1), F.lit(3)), F.lit(20)).cast("int")
    shape = span.select("lo", bins.alias("bins"), F.when(c("hi") > c("lo"), (c("hi") - c("lo")) / bins).otherwise(1.0).alias("width"))
    place = F.least(c("bins") - 1, F.floor((c("x") - c("lo")) / c("width"))).cast("int")
    counts = rows.crossJoin(F.broadcast(shape)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = shape.select(F.explode(F.sequence(F.lit(0), c("bins") - 1)).alias("bin"), (c("lo")).alias("from"), "width")
    return every.join(counts, "bin", "left").select("bin", (c("from") + c("bin") * c("width")).alias("lo"), (c("from") + (c("bin") + 1) * c("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def axis(top: Column, ticks: int = 4) -> Column:
    """struct(top, step): a clean upper end of an axis from 0 and the distance of its ticks, 1, 2 or 5 times a power of ten."""
    raw = top / ticks
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.coalesce(*[F.when(m * size >= raw, m * size) for m in (1.0, 2.0, 5.0)], 10 * size)
    return F.when(top > 0, F.struct((F.ceil(top / step) * step).alias("top"), F.greatest(step, F.lit(1.0)).alias("step"))).otherwise(F.struct(F.lit(1.0).alias("top"), F.lit(1.0).alias("step")))


def thinned(points: DataFrame, order: str, most: int = 1500) -> DataFrame:
    """Every k-th of the points in the order of the numeric, distinct ``order``, k chosen so that at most ``most`` are left."""
    placed = prefix(points.withColumn("__one", F.lit(1).cast("long")), order, "__one")
    total = points.agg(F.count("*").alias("__total"))
    step = F.greatest(F.ceil(c("__total") / F.lit(most)), F.lit(1))
    return placed.crossJoin(F.broadcast(total)).where(c("before") % step == 0).select(*points.columns)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing, distinct_values of each column, in one pass with one row out per column."""
    parts = [F.struct(F.lit(k).alias("column"), F.count(k).alias("n"), (F.count("*") - F.count(k)).alias("missing"), F.count_distinct(c(k)).alias("distinct_values")) for k in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def top_values(df: DataFrame, column: str, limit: int = 4) -> DataFrame:
    """Most frequent values of a column with their counts; ties by value."""
    counts = df.where(c(column).isNotNull()).groupBy(c(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def summary(df: DataFrame, columns: list[str] | None = None, shown: int = 4) -> DataFrame:
    """column, type, n, missing, text, median, range of every column, as shown to people.

    Numbers show mean ± sd, median (quartiles) and range; other columns the commonest values with their share and how many
    more there are, ties by value. One aggregation per column over all rows, one row out of each.
    """
    from litforge.functions.text import shown_number as fmt

    number = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    parts = []
    for name in columns or df.columns:
        missing = df.agg(F.count("*").alias("every"), F.count(f"`{name}`").alias("n"))
        if dict(df.dtypes)[name].split("(")[0] in number:
            stats = describe(df.select(c(f"`{name}`").alias("x")), "x")
            row = missing.join(stats.drop("n"), how="left")  # one row each
            has = c("n") > 0
            parts.append(row.select(
                F.lit(name).alias("column"), F.lit("number").alias("type"), "n", (c("every") - c("n")).alias("missing"),
                F.when(has, F.concat(fmt(c("mean")), F.lit(" ± "), fmt(c("sd")))).otherwise("–").alias("text"),
                F.when(has, F.concat(fmt(c("median")), F.lit(" ("), fmt(c("q1")), F.lit("–"), fmt(c("q3")), F.lit(")"))).otherwise("–").alias("median"),
                F.when(has, F.concat(fmt(c("min")), F.lit(" – "), fmt(c("max")))).otherwise("–").alias("range"),
            ))
            continue
        labels = df.where(c(f"`{name}`").isNotNull()).groupBy(c(f"`{name}`").cast("string").alias("value")).agg(F.count("*").alias("k"))
        kinds = labels.agg(F.count("*").alias("kinds"))
        best = labels.orderBy(F.desc("k"), "value").limit(shown).agg(F.collect_list(F.struct((-c("k")).alias("k"), "value")).alias("best"))
        row = missing.join(kinds).join(best)  # one row each
        each = F.transform(F.array_sort("best"), lambda x: F.concat(x["value"], F.lit(" "), (-x["k"]).cast("string"), F.lit(" ("), F.round(-x["k"] * 100 / c("n"), 0).cast("long").cast("string"), F.lit("%)")))
        more = F.when(c("kinds") > shown, F.concat(F.lit("; +"), (c("kinds") - shown).cast("string"), F.lit(" more"))).otherwise("")
        parts.append(row.select(F.lit(name).alias("column"), F.concat(c("kinds").cast("string"), F.lit(" categories")).alias("type"), "n", (c("every") - c("n")).alias("missing"), F.concat(F.array_join(each, "; "), more).alias("text"), F.lit("").alias("median"), F.lit("").alias("range")))
    return reduce(DataFrame.unionByName, parts)


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """value, n, rank of each distinct value: ties share the mean of their places, counted from 1."""
    by = by or []
    counts = df.where(c(value).isNotNull()).groupBy(*by, c(value).alias("value")).agg(F.count("*").alias("n"))
    return prefix(counts, "value", "n", by).select(*by, "value", "n", (c("before") + (c("n") + 1) / 2).alias("rank"))


def _two(df: DataFrame, value: str, group: str, a, b, *more: Column) -> DataFrame:
    """One row with n, mean and variance of the two groups a and b."""
    x = c(value).cast("double")
    inside = lambda g: F.when(c(group) == g, x)
    both = df.where(c(group).isin(a, b) & x.isNotNull())
    return both.agg(*[f(inside(g)).alias(f"{n}{i}") for i, g in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))], *more)


def welch_t(df: DataFrame, value: str, group: str, a, b, p: bool = True) -> DataFrame:
    """diff, t, df (p, ci_lo, ci_hi of diff): Welch's test of two groups; null where a group has less than 2 values or nothing varies."""
    s1, s2 = c("v1") / c("n1"), c("v2") / c("n2")
    ok = (c("n1") > 1) & (c("n2") > 1) & (s1 + s2 > 0)
    out = _two(df, value, group, a, b).select(
        "n1", "n2", (c("m1") - c("m2")).alias("diff"), F.when(ok, (c("m1") - c("m2")) / F.sqrt(s1 + s2)).alias("t"),
        F.when(ok, (s1 + s2) ** 2 / (s1 * s1 / (c("n1") - 1) + s2 * s2 / (c("n2") - 1))).alias("df"), F.when(ok, F.sqrt(s1 + s2)).alias("se"),
    )
    if not p:
        return out.drop("se")
    half = d.t_quantile(F.lit(0.975), c("df")) * c("se")
    return out.withColumn("p", d.t_p2(c("t"), c("df"))).withColumn("ci_lo", c("diff") - half).withColumn("ci_hi", c("diff") + half).drop("se")


def _ranked(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, n, rank sum) and one row (n, ties, groups) of all values ranked together."""
    rows = df.where(c(value).isNotNull() & c(group).isNotNull())
    cells = rows.groupBy(c(group).alias("g"), c(value).alias("value")).agg(F.count("*").alias("m"))
    ranks = average_ranks(rows, value)
    sums = cells.join(ranks.select("value", "rank"), "value").groupBy("g").agg(F.sum("m").alias("n"), F.sum(c("m") * c("rank")).alias("r"))
    ties = ranks.agg(F.sum("n").alias("total"), F.sum(c("n").cast("double") ** 3 - c("n")).alias("ties"))
    return sums, ties


def mann_whitney(df: DataFrame, value: str, group: str, a, b, p: bool = True) -> DataFrame:
    """u (the smaller), z and p with tie and continuity correction; null where a group is empty or all values are equal."""
    sums, ties = _ranked(df.where(c(group).isin(a, b)), value, group)
    one = sums.agg(*[F.sum(F.when(c("g") == g, c(k))).alias(f"{k}{i}") for i, g in ((1, a), (2, b)) for k in ("n", "r")]).crossJoin(F.broadcast(ties))
    n1, n2, n = c("n1").cast("double"), c("n2").cast("double"), c("total").cast("double")
    u1 = c("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - d.ratio(c("ties"), n * (n - 1))))
    z = d.ratio(F.abs(u1 - n1 * n2 / 2) - 0.5, F.when(sd > 0, sd))
    out = one.select(F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"), F.when(z.isNotNull(), F.least(u1, n1 * n2 - u1)).alias("u"), F.when(z.isNotNull(), F.greatest(z, F.lit(0.0))).alias("z"))
    return out.withColumn("p", d.norm_p2(c("z"))) if p else out


def anova(df: DataFrame, value: str, group: str, p: bool = True) -> DataFrame:
    """f, df1, df2 and p of a one-way analysis of variance; null without variation within groups."""
    x = c(value).cast("double")
    per = df.where(x.isNotNull() & c(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    # sums of squares about the first group's mean, which keeps digits when values are far from zero
    origin = per.agg(F.min_by("m", group).alias("origin"))
    rows = per.crossJoin(F.broadcast(origin)).withColumn("e", c("m") - c("origin"))  # one row
    one = rows.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(c("n") * c("e")).alias("first"), F.sum((c("n") - 1) * c("v")).alias("within"), F.sum(c("n") * c("e") * c("e")).alias("squares"))
    between = c("squares") - c("first") * c("first") / c("n")
    ok = (c("k") > 1) & (c("n") > c("k")) & (c("within") > 0)
    out = one.select("k", F.coalesce("n", F.lit(0)).alias("n"), F.when(ok, (between / (c("k") - 1)) / (c("within") / (c("n") - c("k")))).alias("f"), (c("k") - 1).alias("df1"), (F.coalesce("n", F.lit(0)) - c("k")).alias("df2"))
    return out.withColumn("p", d.f_sf(c("f"), c("df1"), c("df2"))) if p else out


def kruskal(df: DataFrame, value: str, group: str, p: bool = True) -> DataFrame:
    """h, df and p of the Kruskal-Wallis test, corrected for ties; null for less than 3 values or no variation."""
    sums, ties = _ranked(df, value, group)
    one = sums.agg(F.count("*").alias("k"), F.sum(c("r") * c("r") / c("n")).alias("q")).crossJoin(F.broadcast(ties))
    n = c("total").cast("double")
    fair = 1 - d.ratio(c("ties"), n * n * n - n)
    h = d.ratio(12 / (n * (n + 1)) * c("q") - 3 * (n + 1), F.when(fair > 0, fair))
    out = one.select("k", F.coalesce("total", F.lit(0)).alias("n"), F.when((n > 2) & (c("k") > 1), h).alias("h"), (c("k") - 1).alias("df"))
    return out.withColumn("p", d.chi2_sf(c("h"), c("df"))) if p else out


def correlation(df: DataFrame, x: str, y: str, p: bool = True) -> DataFrame:
    """n, r, t, slope, intercept (and p, ci_lo, ci_hi): Pearson's correlation and the least-squares line of y on x."""
    both = df.where(c(x).isNotNull() & c(y).isNotNull()).select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    together = d.ratio(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))  # the built-in correlation fails without variation
    one = both.agg(F.count("*").alias("n"), F.when(together > 1, 1.0).when(together < -1, -1.0).otherwise(together).alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    r = F.when((c("n") > 2) & ~F.isnan("r"), c("r"))
    out = one.withColumn("r", r).withColumn("t", d.ratio(c("r") * F.sqrt(c("n") - 2), F.sqrt(1 - c("r") * c("r"))))
    if not p:
        return out
    half = d.Z95 / F.sqrt(F.when(c("n") > 3, c("n") - 3))
    ci = lambda sign: F.when(F.abs("r") < 1, F.tanh(F.atanh("r") + sign * half))
    return out.withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(d.t_p2(c("t"), c("n") - 2))).withColumn("ci_lo", ci(-1)).withColumn("ci_hi", ci(1))


def spearman(df: DataFrame, x: str, y: str, p: bool = True) -> DataFrame:
    """Pearson's correlation of the average ranks."""
    both = df.where(c(x).isNotNull() & c(y).isNotNull()).select(c(x).alias("x"), c(y).alias("y"))
    rx = average_ranks(both, "x").select(c("value").alias("x"), c("rank").alias("rx"))
    ry = average_ranks(both, "y").select(c("value").alias("y"), c("rank").alias("ry"))
    cells = both.groupBy("x", "y").agg(F.count("*").alias("m")).join(rx, "x").join(ry, "y")
    s = lambda e: F.sum(c("m") * e)
    one = cells.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), s(c("rx")).alias("sx"), s(c("ry")).alias("sy"), s(c("rx") * c("rx")).alias("sxx"), s(c("ry") * c("ry")).alias("syy"), s(c("rx") * c("ry")).alias("sxy"))
    n = F.when(c("n") > 0, c("n").cast("double"))
    top, vx, vy = c("sxy") - c("sx") * c("sy") / n, c("sxx") - c("sx") * c("sx") / n, c("syy") - c("sy") * c("sy") / n
    out = one.select("n", F.when((n > 2) & (vx > 0) & (vy > 0), top / F.sqrt(vx * vy)).alias("rho"))
    t = c("rho") * F.sqrt(c("n") - 2) / F.sqrt(F.when(F.abs("rho") < 1, 1 - c("rho") * c("rho")))
    return out.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(d.t_p2(t, c("n") - 2))) if p else out


def correlate(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, ci_lo, ci_hi, p, rho, rho_p, slope, intercept: both correlations and the line, one row; null where there is no variation."""
    ranks = spearman(df, x, y).select("rho", c("p").alias("rho_p"))
    return correlation(df, x, y).crossJoin(F.broadcast(ranks)).select("n", "r", "ci_lo", "ci_hi", "p", "rho", "rho_p", "slope", "intercept")  # one row each


def cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """r, c, n for the pairs of values that occur; null pairs don't count."""
    return df.where(c(row).isNotNull() & c(column).isNotNull()).groupBy(c(row).alias("r"), c(column).alias("c")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """r, c, n, row_percent for every pair of a value of ``row`` and one of ``column``, zeros included; null pairs don't count.

    The result has labels x labels rows, which is the table asked for; tests take :func:`cells`, which has no zeros.
    """
    found = cells(df, row, column)
    rows, columns = found.groupBy("r").agg(F.sum("n").alias("nr")), found.select("c").distinct()
    grid = rows.crossJoin(columns).join(found, ["r", "c"], "left")
    return grid.select("r", "c", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 100 / c("nr")).alias("row_percent"))


def chi_square(df: DataFrame, row: str, column: str, p: bool = True) -> DataFrame:
    """n, chi2, df, cramers_v, least_expected (p, fisher_p of a 2x2 table, warning) of a cross table; null with less than two rows or columns.

    Only cells that occur are kept: chi-square is the sum of n² / expected over them, less the total.
    """
    found = cells(df, row, column)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows, columns = found.groupBy("r").agg(F.sum("n").alias("nr")), found.groupBy("c").agg(F.sum("n").alias("nc"))
    shape = rows.agg(F.count("*").alias("rows"), F.min("nr").alias("least_r"), F.min("r").alias("r1")).crossJoin(columns.agg(F.count("*").alias("columns"), F.min("nc").alias("least_c"), F.min("c").alias("c1")))
    one_row = total.crossJoin(shape)
    joined = found.join(rows, "r").join(columns, "c").crossJoin(F.broadcast(one_row))
    first_r, first_c = c("r") == c("r1"), c("c") == c("c1")
    corner = lambda e: F.sum(F.when(e, c("n")).otherwise(0))
    sums = joined.agg(
        F.sum(c("n").cast("double") * c("n") / (c("nr").cast("double") * c("nc"))).alias("share"), corner(first_r & first_c).alias("a"), corner(first_r & ~first_c).alias("b"),
        corner(~first_r & first_c).alias("c"), corner(~first_r & ~first_c).alias("d"),
    )
    ok = (c("rows") > 1) & (c("columns") > 1)
    chi = F.when(ok, F.greatest(c("total") * (c("share") - 1), F.lit(0.0)))
    out = sums.crossJoin(F.broadcast(one_row)).select(
        c("total").alias("n"), chi.alias("chi2"), ((c("rows") - 1) * (c("columns") - 1)).alias("df"),
        F.sqrt(d.ratio(chi, c("total") * (F.least("rows", "columns") - 1))).alias("cramers_v"), d.ratio(c("least_r") * c("least_c"), c("total")).alias("least_expected"),
        F.when((c("rows") == 2) & (c("columns") == 2), F.struct("a", "b", "c", "d")).alias("two"),
    )
    if not p:
        return out.drop("two")
    exact = d.fisher_p(*[c(f"two.{x}") for x in "abcd"])
    return out.withColumn("p", d.chi2_sf(c("chi2"), c("df"))).withColumn("fisher_p", exact).withColumn("warning", F.when(c("chi2").isNotNull() & (c("least_expected") < 5), "Some expected counts are below 5.")).drop("two")


#: Most groups that are compared.
MOST_GROUPS = 12


def compare_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """test, statistic, p, warning of the tests that fit: two groups get Welch and Mann-Whitney, more get ANOVA and Kruskal-Wallis.

    A value that is no number is cross-tabulated, and a 2x2 table gets Fisher's exact test as well. Only the group labels
    and sizes (at most MOST_GROUPS + 1 rows) reach the driver.
    """
    numeric = dict(df.dtypes)[value] not in ("string", "boolean")
    empty = F.lit(None).cast("string").alias("warning")
    if not numeric:
        one = chi_square(df, value, group)
        exact = one.where(c("fisher_p").isNotNull()).select(F.lit("Fisher exact").alias("test"), F.lit(None).cast("double").alias("statistic"), c("fisher_p").alias("p"), "warning")
        return one.select(F.lit("chi-square").alias("test"), c("chi2").alias("statistic"), "p", "warning").unionByName(exact)
    sizes = {r[0]: r[1] for r in df.where(c(value).isNotNull() & c(group).isNotNull()).groupBy(group).agg(F.count("*")).limit(MOST_GROUPS + 1).collect()}
    if not 2 <= len(sizes) <= MOST_GROUPS:
        raise ValueError(f"a comparison needs 2 to {MOST_GROUPS} groups")
    warning = F.lit("A group has fewer than two values.").alias("warning") if min(sizes.values()) < 2 else empty
    pick = lambda frame, name, statistic: frame.select(F.lit(name).alias("test"), c(statistic).alias("statistic"), "p", warning)
    if len(sizes) == 2:
        a, b = sorted(sizes)
        parts = [pick(welch_t(df, value, group, a, b), "Welch t", "t"), pick(mann_whitney(df, value, group, a, b), "Mann-Whitney U", "u")]
    else:
        parts = [pick(anova(df, value, group), "ANOVA F", "f"), pick(kruskal(df, value, group), "Kruskal-Wallis H", "h")]
    return reduce(DataFrame.unionByName, parts)
