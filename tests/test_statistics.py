"""Published values and small examples of the statistical functions."""

import math

import pytest
from pyspark.sql import functions as F

from litforge.functions import distributions as d
from litforge.functions import special as s
from litforge.operators import clinical, meta, statistics

c = F.col


def near(a, b, tolerance=1e-4):
    assert abs(a - b) < tolerance, (a, b)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, rows, kind="double"):
    return spark.createDataFrame([(x,) for x in rows], f"x {kind}")


def grouped(spark, *groups):
    return spark.createDataFrame([(float(x), "abcdef"[i]) for i, g in enumerate(groups) for x in g], "x double, g string")


def test_distributions_match_published_values(spark):
    near(s.norm_cdf(1.96), 0.9750021, 1e-6)
    near(s.norm_cdf(-1), 0.1586553, 1e-6)
    near(s.norm_quantile(0.975), 1.959964, 1e-5)
    near(s.t_quantile(0.975, 10), 2.228139)
    near(s.t_p2(2.0, 5), 0.1019395, 1e-5)
    near(s.chi2_sf(5.991465, 2), 0.05, 1e-5)
    near(s.f_sf(4.964603, 1, 10), 0.05, 1e-5)
    row = one(spark, d.norm_cdf(0.0).alias("a"), d.t_p2(2.228139, 10).alias("b"), d.chi2_sf(3.841459, 1).alias("c"), d.norm_p2(F.lit(None).cast("double")).alias("n"), d.wilson(F.lit(8), F.lit(10)).alias("w"), d.wilson(F.lit(0), F.lit(0)).alias("v"))
    near(row.a, 0.5, 1e-12)
    near(row.b, 0.05, 1e-5)
    near(row.c, 0.05, 1e-5)
    assert row.n is None and row.v is None
    near(row.w.lo, 0.4902, 1e-3)
    near(row.w.hi, 0.9433, 1e-3)


def test_tails_keep_their_digits():
    assert abs(s.norm_p2(20) / 5.507248237212467e-89 - 1) < 1e-9
    near(s.chi2_sf(650, 700), 0.911747, 1e-6)
    near(s.t_p2(3, 4000), 0.0027164, 1e-6)
    assert 0 < s.chi2_sf(2000, 10) < 1e-300 or s.chi2_sf(2000, 10) == 0
    for df in (1, 2, 3.5, 30, 1e6):
        near(s.t_cdf(s.t_quantile(0.9, df), df), 0.9, 1e-10)
    for x, a in ((0.3, 2.0), (40.0, 30.0), (500.0, 700.0)):
        low, high = s.gamma_tails(a, x)
        near(low + high, 1, 1e-12)


def test_exact_test_equals_the_sum_over_all_tables():
    def brute(a, b, c_, d_):
        r, t, k = a + b, c_ + d_, a + c_
        chance = lambda x: s.log_choose(r, x) + s.log_choose(t, k - x) - s.log_choose(r + t, k)
        return min(1, sum(math.exp(chance(x)) for x in range(max(0, k - t), min(r, k) + 1) if chance(x) <= chance(a) + 1e-9))

    for table in [(3, 1, 1, 3), (0, 5, 5, 0), (20, 30, 10, 40), (1, 9, 11, 3), (0, 0, 4, 2), (7, 7, 7, 7)]:
        near(s.fisher_p(*table), brute(*table), 1e-12)
    near(s.fisher_p(3, 1, 1, 3), 0.4857, 1e-3)
    assert 0 < s.fisher_p(10**8, 10**8 + 30_000, 10**8, 10**8) < 1


def tables(spark, *rows):
    return spark.createDataFrame(list(rows), "a long, b long, c long, d long")


def test_risk(spark):
    r = clinical.risk(tables(spark, (20, 80, 10, 90))).first()
    near(r.rr, 2)
    near(r.odds, 2.25)
    near(r.rd, 0.1)
    near(r.odds_lo, 0.9937, 1e-3)
    near(r.odds_hi, 5.094, 1e-2)
    assert r.nn_kind == "harm" and not r.corrected
    near(r.nn, 10)
    near(r.nn_lo, 5.05, 1e-2)
    assert clinical.risk(tables(spark, (6, 94, 4, 96)), p=False).first().nn_lo is None
    t = clinical.risk(tables(spark, (10, 190, 40, 160)), p=False).first()
    assert t.nn_kind == "benefit" and t.nn_lo < t.nn < t.nn_hi
    z = clinical.risk(tables(spark, (0, 10, 5, 5)), p=False).first()
    assert z.corrected and z.small_expected and math.isfinite(z.odds)
    near(clinical.risk(tables(spark, (20, 30, 10, 40))).first().chi2, 4.7619, 1e-3)


def test_empty_margins_give_null_and_no_error(spark):
    rows = clinical.risk(tables(spark, (0, 0, 3, 4), (0, 5, 0, 6), (0, 0, 0, 0))).collect()
    assert [r.rr is None for r in rows] == [True, False, True]
    assert rows[1].chi2 == 0.0 and rows[0].chi2 is None
    found = clinical.diagnostic(tables(spark, (0, 0, 0, 0), (5, 0, 0, 5))).collect()
    assert found[0].sens is None and found[1].lr_plus is None and found[1].dor is None


def test_problems_of_tables(spark):
    rows = spark.createDataFrame([(1.5, 1.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0), (1.0, 2.0, 3.0, 4.0), (-1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    said = [r.p for r in rows.select(clinical.problem().alias("p")).collect()]
    assert "whole" in said[0] and "roup" in said[1] and said[2] is None and "zero or more" in said[3]


def test_diagnostic_accuracy(spark):
    r = clinical.diagnostic(tables(spark, (90, 20, 10, 80))).first()
    for found, expected in ((r.sens, 0.9), (r.spec, 0.8), (r.ppv, 90 / 110), (r.npv, 80 / 90), (r.lr_plus, 4.5), (r.lr_minus, 0.125), (r.dor, 36), (r.prevalence, 0.5)):
        near(found, expected)
    row = one(spark, clinical.predictive_values(F.lit(0.9), F.lit(0.8), F.lit(0.05)).alias("p"), clinical.post_test(F.lit(0.5), F.lit(4.5)).alias("q"), clinical.post_test(F.lit(1.0), F.lit(4.5)).alias("s"))
    near(row.p.ppv, 0.1915, 1e-3)
    near(row.p.npv, 0.9941, 1e-3)
    near(row.q, 0.818, 1e-3)
    assert row.s == 1.0


def test_describe(spark):
    r = statistics.describe(values(spark, range(1, 11), "long"), "x", interval=True).first()
    for found, expected in ((r["mean"], 5.5), (r.sd, 3.02765), (r.median, 5.5), (r.q1, 3.25), (r.q3, 7.75)):
        near(found, expected)
    assert r.ci_lo < 5.5 < r.ci_hi
    assert statistics.describe(values(spark, []), "x").count() == 0
    single = statistics.describe(values(spark, [4.0, None, float("nan")]), "x", interval=True).first()
    assert (single.n, single.sd, single.median, single.ci_lo) == (1, None, 4.0, None)


def test_groups_with_null_keys_are_kept(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert {r.g: r.median for r in statistics.describe(rows, "x", ["g"]).collect()} == {None: 2.0, "a": 5.0}


def test_one_group_with_nearly_all_rows(spark):
    rows = spark.range(20_000).select(F.when(c("id") < 19_990, "hot").otherwise("cold").alias("g"), (c("id") % 997).cast("double").alias("x"))
    expected = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("x", F.lit(0.25)).alias("q")).collect()}
    assert {r.g: r.q for r in statistics.quantiles(rows, "x", {"q": 0.25}, ["g"]).collect()} == expected


def test_ranks_with_ties(spark):
    ranks = statistics.average_ranks(values(spark, [10, 20, 20, 30], "int"), "x")
    assert sorted((r.value, r.n, r.rank) for r in ranks.collect()) == [(10, 1, 1.0), (20, 2, 2.5), (30, 1, 4.0)]


def test_two_groups(spark):
    t = statistics.welch_t(grouped(spark, [1, 2, 3, 4, 5], [2, 4, 6, 8, 10]), "x", "g", "a", "b").first()
    near(t.t, -1.8974, 1e-3)
    near(t.df, 5.882, 1e-2)
    near(t.p, 0.1076, 5e-3)
    near(t.diff, -3)
    assert t.ci_lo < -3 < t.ci_hi
    u = statistics.mann_whitney(grouped(spark, [1, 2, 3, 4, 5], [6, 7, 8, 9, 10]), "x", "g", "a", "b").first()
    assert u.u == 0 and u.p < 0.02
    empty = statistics.mann_whitney(grouped(spark, [1, 2, 3]), "x", "g", "a", "b").first()
    assert (empty.n1, empty.n2, empty.u, empty.p) == (3, 0, None, None)
    flat = statistics.mann_whitney(grouped(spark, [1, 1], [1, 1]), "x", "g", "a", "b").first()
    assert flat.u is None and flat.p is None
    assert statistics.welch_t(grouped(spark, [1], [2, 3]), "x", "g", "a", "b").first().t is None


def test_several_groups(spark):
    three = grouped(spark, [1, 2, 3], [4, 5, 6], [7, 8, 9])
    a = statistics.anova(three, "x", "g").first()
    near(a.f, 27, 1e-6)
    near(a.p, 0.001, 1e-6)
    k = statistics.kruskal(three, "x", "g").first()
    near(k.h, 7.2, 1e-6)
    near(k.p, 0.0273, 1e-3)
    assert statistics.anova(grouped(spark, [1, 1], [2, 2]), "x", "g").first().f is None
    assert statistics.kruskal(grouped(spark), "x", "g").first().h is None


def test_correlations(spark):
    pairs = lambda *rows: spark.createDataFrame([(float(x), float(y)) for x, y in rows], "x double, y double")
    near(statistics.correlation(pairs((1, 2), (2, 4), (3, 6), (4, 8), (5, 10)), "x", "y").first().r, 1)
    p = statistics.correlate(pairs((1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5)), "x", "y").first()
    near(p.r, 0.8286, 1e-3)
    near(p.p, 0.0415, 2e-3)
    assert p.ci_lo < p.r < p.ci_hi
    near(statistics.spearman(pairs((1, 1), (2, 4), (3, 9), (4, 16)), "x", "y").first().rho, 1)
    assert statistics.correlation(pairs((1, 1), (1, 2), (1, 3)), "x", "y").first().r is None


def test_cross_tables(spark):
    counts = [("x", "p", 20), ("x", "q", 30), ("y", "p", 10), ("y", "q", 40)]
    rows = spark.createDataFrame([(a, b) for a, b, n in counts for _ in range(n)], "a string, b string")
    chi = statistics.chi_square(rows, "a", "b").first()
    near(chi.chi2, 4.7619, 1e-3)
    near(chi.cramers_v, math.sqrt(4.7619 / 100))
    near(chi.fisher_p, s.fisher_p(20, 30, 10, 40), 1e-9)
    assert chi.least_expected == 15.0 and chi.warning is None
    flat = statistics.chi_square(spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string"), "a", "b").first()
    assert flat.chi2 is None and flat.fisher_p is None
    grid = statistics.crosstab(spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "a string, b string"), "a", "b")
    assert sorted((r.r, r.c, r.n) for r in grid.collect()) == [("x", "p", 1), ("x", "q", 1), ("y", "p", 1), ("y", "q", 0)]
    tests = statistics.compare_groups(rows, "a", "b").collect()
    assert [t.test for t in tests] == ["chi-square", "Fisher exact"]


def test_comparisons_choose_their_tests(spark):
    two = statistics.compare_groups(grouped(spark, [1, 2, 3], [4, 5, 9]), "x", "g")
    assert {t.test for t in two.collect()} == {"Welch t", "Mann-Whitney U"}
    small = statistics.compare_groups(grouped(spark, [1, 2, 3], [4, 5, 9], [2]), "x", "g").collect()
    assert {t.test for t in small} == {"ANOVA F", "Kruskal-Wallis H"} and all("fewer than two" in t.warning for t in small)
    with pytest.raises(ValueError):
        statistics.compare_groups(grouped(spark, [1, 2, 3]), "x", "g")


def studies(spark, *rows):
    return spark.createDataFrame([("m", *r) for r in rows], "analysis string, label string, est double, lo double, hi double")


def test_meta_analysis(spark):
    same = studies(spark, ("A", 0.8, 0.6, 1.067), ("B", 0.8, 0.6, 1.067))
    m = meta.pooled(same, ratio=True).first()
    near(m.fixed, 0.8, 1e-3)
    near(m["random"], 0.8, 1e-3)
    near(m.i2, 0)
    near(meta.weights(same, ratio=True).first().fixed_weight, 50, 1e-6)
    assert m.fixed_hi - m.fixed_lo < 1.067 - 0.6
    m = meta.warnings(meta.pooled(studies(spark, ("A", 0.5, 0.4, 0.625), ("B", 1.5, 1.2, 1.875), ("C", 1.0, 0.8, 1.25)), ratio=True)).first()
    near(m.tau2, 0.29567, 1e-5)
    near(m.i2, 95.8, 0.05)
    near(m["random"], 0.909, 1e-3)
    assert m.q_p < 0.001 and m.random_hi - m.random_lo > m.fixed_hi - m.fixed_lo
    assert m.notes == ["heterogeneity is high", "fewer than five studies"]
    m = meta.pooled(studies(spark, ("A", -2.0, -4.0, 0.0), ("B", -3.0, -5.0, -1.0), ("bad", 5.0, 6.0, 7.0)), ratio=False).first()
    near(m.fixed, -2.5, 1e-9)
    assert m.skipped == 1
    assert meta.pooled(studies(spark, ("A", 1.0, 0.5, 2.0)), ratio=True).count() == 0
    assert meta.pooled(studies(spark, ("A", -1.0, -2.0, 1.0), ("B", 1.0, 0.5, 2.0)), ratio=True).count() == 0


def test_meta_export(spark):
    rows = studies(spark, ('Say "A"', 2.0, 1.0, 3.0), ("B", 2.0, 1.0, 3.0))
    lines = meta.export_lines(meta.weights(rows, ratio=False), meta.pooled(rows, ratio=False, p=False), "Mean difference").orderBy("part", "label").collect()
    assert lines[0].line == "Study,Mean difference,Lower 95%,Upper 95%,Weight fixed %,Weight random %"
    assert lines[2].line == '"Say ""A""",2.0,1.0,3.0,50,50'
    assert lines[3].line.startswith("Fixed effect,2.0,") and lines[3].line.endswith(",,")


def test_summary_of_columns(spark):
    rows = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, None), (None, "b")], "n double, t string")
    found = {r["column"]: r for r in statistics.summary(rows).collect()}
    assert (found["n"].text, found["n"].median, found["n"].range, found["n"].missing) == ("2 ± 1", "2 (1.5–2.5)", "1 – 3", 1)
    assert (found["t"].type, found["t"].text, found["t"].missing) == ("2 categories", "a 2 (67%); b 1 (33%)", 1)


def test_axes_and_thinning(spark):
    row = one(spark, statistics.axis(F.lit(87.0)).alias("a"), statistics.axis(F.lit(0.0)).alias("z"), statistics.axis(F.lit(4.0)).alias("f"))
    assert (row.a.top, row.a.step) == (100.0, 50.0) and (row.z.top, row.z.step) == (1.0, 1.0) and (row.f.top, row.f.step) == (4.0, 1.0)
    kept = statistics.thinned(spark.range(10).toDF("i"), "i", 4)
    assert sorted(r.i for r in kept.collect()) == [0, 3, 6, 9]


def test_percentiles_of_empty_and_constant(spark):
    assert statistics.quantiles(values(spark, []), "x", {"m": 0.5}).count() == 0
    assert statistics.histogram(values(spark, [3.0, 3.0]), "x").agg(F.sum("n")).first()[0] == 2
    assert statistics.histogram(values(spark, []), "x").count() == 0
