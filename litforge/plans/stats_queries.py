"""Queries of the statistical operators and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.core.session import table
from litforge.functions import distributions as d
from litforge.operators import clinical, meta, statistics
from litforge.plans.registry import query, rounded

c = F.col
Z = d.Z95


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS se,
round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def describe_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.describe(table(spark, sf, "events"), "value", ["event_type"]))


@query()
def describe_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.describe(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"], interval=True), 4)


@query("SELECT list_sort(list(o_totalprice))[(count(*) // 2)::INT + 1] AS median, count(*) AS n FROM orders")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.upper_median(table(spark, sf, "orders"), "o_totalprice")


@query("""WITH s AS (SELECT count(*) n, min(l_quantity) lo, max(l_quantity) hi, least(greatest(ceil(log2(count(*)) + 1), 3), 20)::INT AS bins FROM lineitem),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1 END AS width FROM s),
b AS (SELECT least(bins - 1, floor((l_quantity - lo) / width))::INT AS bin, count(*) AS n FROM lineitem, w GROUP BY 1)
SELECT r.bin::BIGINT AS bin, round(lo + r.bin * width, 6) AS lo, round(lo + (r.bin + 1) * width, 6) AS hi, coalesce(b.n, 0) AS n FROM w, (SELECT unnest(range(0, (SELECT bins FROM w))) AS bin) r LEFT JOIN b ON b.bin = r.bin""")
def histogram_sturges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.histogram(table(spark, sf, "lineitem"), "l_quantity"))


@query("""SELECT * FROM (SELECT 'pmid' AS "column", count(pmid) AS n, count(*) - count(pmid) AS missing, count(DISTINCT pmid) AS distinct_values FROM articles
UNION ALL SELECT 'doi', count(doi), count(*) - count(doi), count(DISTINCT doi) FROM articles UNION ALL SELECT 'pmcid', count(pmcid), count(*) - count(pmcid), count(DISTINCT pmcid) FROM articles
UNION ALL SELECT 'lang', count(lang), count(*) - count(lang), count(DISTINCT lang) FROM articles)""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.profile(table(spark, sf, "articles"), ["pmid", "doi", "pmcid", "lang"])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.top_values(table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT DISTINCT p_size::BIGINT AS value, count(*) OVER (PARTITION BY p_size) AS n, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part WHERE p_size IS NOT NULL")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.average_ranks(table(spark, sf, "part"), "p_size"))


_BETA = "list_sum([exp({a}*ln({x})+{b}*ln(1-({x}))-ln({a})-(lgamma({a})+lgamma({b})-lgamma({a}+{b}))+lgamma({a}+1)-lgamma({a}+{b})+lgamma({a}+{b}+j_)-lgamma({a}+1+j_)+j_*ln({x})) for j_ in range(0,501)])"


def sql_beta(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function as SQL (an independent rendering of the series)."""
    left, right = _BETA.format(x=f"({x})", a=f"({a})", b=f"({b})"), _BETA.format(x=f"(1-({x}))", a=f"({b})", b=f"({a})")
    return f"CASE WHEN ({x})<=0 THEN 0 WHEN ({x})>=1 THEN 1 WHEN ({x})<=0.5 THEN {left} WHEN ({a})*(1-({x}))/({x})>200 THEN 0 ELSE 1-{right} END"


def sql_gamma(a: str, x: str) -> str:
    return f"CASE WHEN ({x})<=0 THEN 0 WHEN ({x})>300 THEN 1 ELSE list_sum([exp((({a})+j_)*ln({x})-({x})-lgamma(({a})+j_+1)) for j_ in range(0,401)]) END"


_WELCH = f"""WITH g AS (SELECT event_type, count(value) n, avg(value) m, var_samp(value) v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
s AS (SELECT a.n n1, b.n n2, a.m - b.m diff, a.v / a.n s1, b.v / b.n s2 FROM g a, g b WHERE a.event_type = 'click' AND b.event_type = 'view'),
t AS (SELECT n1, n2, diff, diff / sqrt(s1 + s2) AS t, (s1 + s2)^2 / (s1^2 / (n1 - 1) + s2^2 / (n2 - 1)) AS df FROM s)
SELECT n1, n2, round(diff, 6) AS diff, round(t, 6) AS t, round(df, 4) AS df, round({sql_beta("df/(df+t*t)", "df/2", "0.5::DOUBLE")}, 6) AS p FROM t"""


@query(_WELCH)
def welch_t(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.welch_t(table(spark, sf, "events"), "value", "event_type", "click", "view").drop("ci_lo", "ci_hi")
    return rounded(out).withColumn("df", F.round("df", 4))


_RANKED = """WITH v AS (SELECT {group} AS g, {value} AS x FROM {table} WHERE {where}),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM v),
ties AS (SELECT sum(n) AS total, sum(n::DOUBLE ^ 3 - n) AS ties FROM (SELECT count(*) n FROM v GROUP BY x)),
s AS (SELECT g, count(*) n, sum(r) r FROM r GROUP BY g)"""


@query(_RANKED.format(group="event_type", value="value", table="events", where="event_type IN ('click', 'view') AND value IS NOT NULL") + f""",
u AS (SELECT a.n n1, b.n n2, a.r - a.n * (a.n + 1) / 2 AS u1, total, ties FROM s a, s b, ties WHERE a.g = 'click' AND b.g = 'view'),
z AS (SELECT *, greatest(0, (abs(u1 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (total + 1 - ties / (total::DOUBLE * (total - 1))))) AS z FROM u)
SELECT n1, n2, round(least(u1, n1 * n2 - u1), 6) AS u, round(z, 6) AS z, round(1 - ({sql_gamma("0.5", "z*z/2")}), 6) AS p FROM z""")
def mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.mann_whitney(table(spark, sf, "events"), "value", "event_type", "click", "view"))


@query(f"""WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1),
s AS (SELECT count(*) k, sum(n)::BIGINT n, sum(n * m) / sum(n) grand, sum((n - 1) * v) w FROM g),
f AS (SELECT k, s.n, (sum(g.n * (m - grand)^2) / (k - 1)) / (any_value(w) / (s.n - k)) AS f FROM g, s GROUP BY k, s.n)
SELECT k, n, round(f, 5) AS f, k - 1 AS df1, n - k AS df2, round({sql_beta("(n-k)/((n-k)+(k-1)*f)", "(n-k)/2", "(k-1)/2")}, 5) AS p FROM f""")
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 5)


@query(_RANKED.format(group="o_orderpriority", value="o_totalprice", table="orders", where="o_totalprice IS NOT NULL") + f""",
h AS (SELECT count(*) k, any_value(total)::BIGINT n, (12 / (any_value(total)::DOUBLE * (any_value(total) + 1)) * sum(r * r / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (any_value(total)::DOUBLE ^ 3 - any_value(total))) AS h FROM s, ties)
SELECT k, n, round(h, 5) AS h, k - 1 AS df, round(1 - ({sql_gamma("(k-1)/2", "h/2")}), 5) AS p FROM h""")
def kruskal_h(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.kruskal(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 5)


@query(f"""WITH s AS (SELECT count(*) n, corr(l_quantity, l_discount) r, regr_slope(l_discount, l_quantity) slope, regr_intercept(l_discount, l_quantity) intercept FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM s)
SELECT n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(t, 4) AS t, round({sql_beta("(n-2)/((n-2)+t*t)", "(n-2)/2", "0.5::DOUBLE")}, 4) AS p,
round(tanh(atanh(r) - {Z} / sqrt(n - 3)), 6) AS ci_lo, round(tanh(atanh(r) + {Z} / sqrt(n - 3)), 6) AS ci_hi FROM t""")
def pearson_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_discount")).withColumn("t", F.round("t", 4)).withColumn("p", F.round("p", 4))


@query("""WITH v AS (SELECT p_size x, p_retailprice y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman_rho(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", p=False))


@query("""SELECT r, c, n, round(n * 100 / sum(n) OVER (PARTITION BY r), 6) AS row_percent FROM (SELECT r.l_returnflag AS r, c.l_linestatus AS c, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) r CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) c
LEFT JOIN lineitem l ON l.l_returnflag = r.l_returnflag AND l.l_linestatus = c.l_linestatus GROUP BY 1, 2)""")
def crosstab_long(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"""WITH x AS (SELECT label AS r, category AS c, 1 AS one FROM entities WHERE label IS NOT NULL AND category IS NOT NULL),
g AS (SELECT a.r, b.c, coalesce(n, 0) n FROM (SELECT DISTINCT r FROM x) a CROSS JOIN (SELECT DISTINCT c FROM x) b LEFT JOIN (SELECT r, c, count(*) n FROM x GROUP BY 1, 2) k ON k.r = a.r AND k.c = b.c),
m AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM g),
s AS (SELECT sum(n)::BIGINT n, sum((n - e)^2 / e) chi2, min(e) least_expected, (SELECT count(DISTINCT r) FROM x) nr, (SELECT count(DISTINCT c) FROM x) nc FROM m)
SELECT n, round(chi2, 3) AS chi2, (nr - 1) * (nc - 1) AS df, round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v, round(least_expected, 6) AS least_expected, round(1 - ({sql_gamma("((nr-1)*(nc-1))/2", "chi2/2")}), 6) AS p FROM s""")
def chi_square_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.chi_square(table(spark, sf, "entities"), "label", "category").drop("fisher_p", "warning")).withColumn("chi2", F.round("chi2", 3))


@query()
def compare_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.compare_groups(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


# Mentions by category: a sure detection (score 0.8 and more) against being denied.
_COUNTS = "SELECT category, count_if(score >= 0.8 AND negated)::BIGINT a, count_if(score >= 0.8 AND NOT negated)::BIGINT b, count_if(score < 0.8 AND negated)::BIGINT c, count_if(score < 0.8 AND NOT negated)::BIGINT d FROM entities WHERE score IS NOT NULL AND negated IS NOT NULL GROUP BY category"


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    return clinical.table2x2(table(spark, sf, "entities"), c("score") >= 0.8, c("negated"), ["category"])


@query(f"""WITH t AS ({_COUNTS}), h AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS h, (a + b + c + d) AS n, a / (a + b) AS r1, c / (c + d) AS r0 FROM t),
k AS (SELECT *, a + h AS a1, b + h AS b1, c + h AS c1, d + h AS d1, r1 - r0 AS rd, sqrt(r1 * (1 - r1) / (a + b) + r0 * (1 - r0) / (c + d)) AS se FROM h),
q AS (SELECT *, ln(a1 / (a1 + b1)) - ln(c1 / (c1 + d1)) AS lr, sqrt(1 / a1 - 1 / (a1 + b1) + 1 / c1 - 1 / (c1 + d1)) AS sr, ln(a1 * d1 / (b1 * c1)) AS lo, sqrt(1 / a1 + 1 / b1 + 1 / c1 + 1 / d1) AS so FROM k)
SELECT category, a, b, c, d, round(r1, 6) AS risk1, round(r0, 6) AS risk0, round(exp(lr + e), 6) AS rr, round(exp(lr - {Z} * sr + e), 6) AS rr_lo, round(exp(lr + {Z} * sr + e), 6) AS rr_hi,
round(exp(lo + e), 6) AS odds, round(exp(lo - {Z} * so + e), 6) AS odds_lo, round(exp(lo + {Z} * so + e), 6) AS odds_hi, round(rd, 6) AS rd, round(rd - {Z} * se, 6) AS rd_lo, round(rd + {Z} * se, 6) AS rd_hi,
round(CASE WHEN rd <> 0 THEN 1 / abs(rd) END, 4) AS nn, CASE WHEN e IS NULL THEN NULL WHEN rd < 0 THEN 'benefit' WHEN rd > 0 THEN 'harm' END AS nn_kind, h > 0 AS corrected,
round(coalesce(n * (a * d - b * c)::DOUBLE ^ 2 / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0), 0) + e, 6) AS chi2 FROM (SELECT *, CASE WHEN (a + b) * (c + d) > 0 THEN 0 END AS e FROM q)""")
def risk_2x2(spark: SparkSession, sf: str) -> DataFrame:
    out = clinical.risk(_tables(spark, sf), p=False).select("category", "a", "b", "c", "d", "risk1", "risk0", "rr", "rr_lo", "rr_hi", "odds", "odds_lo", "odds_hi", "rd", "rd_lo", "rd_hi", "nn", "nn_kind", "corrected", "chi2")
    return rounded(out).withColumn("nn", F.round("nn", 4))


@query(f"""WITH t AS ({_COUNTS}), m AS (SELECT *, a + b r, c + d s, a + c k FROM t),
x AS (SELECT category, a, r, s, k, unnest(range(greatest(0, k - s)::BIGINT, (least(r, k) + 1)::BIGINT)) AS x FROM m),
l AS (SELECT category, a, x, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(s + 1) - lgamma(k - x + 1) - lgamma(s - k + x + 1) - (lgamma(r + s + 1) - lgamma(k + 1) - lgamma(r + s - k + 1)) AS p FROM x)
SELECT l.category, round(least(1, sum(CASE WHEN l.p <= h.p + 1e-9 THEN exp(l.p) ELSE 0 END)), 6) AS fisher_p FROM l JOIN l h ON h.category = l.category AND h.x = h.a GROUP BY 1""")
def fisher_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_tables(spark, sf).select("category", clinical.fisher().alias("fisher_p")))


@query(f"""WITH t AS ({_COUNTS}) SELECT category, a, b, c, d, round(a / (a + c), 6) AS sens, round(d / (b + d), 6) AS spec, round(a / (a + b), 6) AS ppv, round(d / (c + d), 6) AS npv, round((a + d) / (a + b + c + d), 6) AS accuracy,
round((a + c) / (a + b + c + d), 6) AS prevalence, round((a / (a + c)) / (1 - d / (b + d)), 6) AS lr_plus, round((1 - a / (a + c)) / (d / (b + d)), 6) AS lr_minus, round(CASE WHEN b > 0 AND c > 0 THEN a * d / (b * c) END, 6) AS dor FROM t""")
def diagnostic_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clinical.diagnostic(_tables(spark, sf)).select("category", "a", "b", "c", "d", "sens", "spec", "ppv", "npv", "accuracy", "prevalence", "lr_plus", "lr_minus", "dor"))


@query(f"""SELECT category, count_if(negated)::BIGINT AS k, count(*) AS n,
round(greatest(0, (k / n + {Z}^2 / (2 * n)) / (1 + {Z}^2 / n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z}^2 / (4 * n * n)) / (1 + {Z}^2 / n)), 8) AS lo,
round(least(1, (k / n + {Z}^2 / (2 * n)) / (1 + {Z}^2 / n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z}^2 / (4 * n * n)) / (1 + {Z}^2 / n)), 8) AS hi FROM entities GROUP BY category""", 8)
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "entities").groupBy("category").agg(F.count_if("negated").alias("k"), F.count("*").alias("n"))
    return rounded(counts.withColumn("w", d.wilson(c("k"), c("n"))).select("category", "k", "n", c("w.lo").alias("lo"), c("w.hi").alias("hi")), 8)


@query(f"""WITH x AS (SELECT n_nationkey::BIGINT AS k, 0.2 * n_nationkey + 0.05 AS z, n_nationkey + 2.0 AS df FROM nation)
SELECT k, round(0.5 + 0.5 * ({sql_gamma("0.5", "z*z/2")}), 8) AS norm_cdf, round(1 - ({sql_gamma("0.5", "z*z/2")}), 8) AS norm_p2, round({sql_beta("df/(df+z*z)", "df/2", "0.5::DOUBLE")}, 8) AS t_p2,
round(1 - ({sql_gamma("df/2", "z*3/2")}), 8) AS chi2_sf, round({sql_beta("df/(df+4*z)", "df/2", "2.0::DOUBLE")}, 8) AS f_sf FROM x""", 8)
def distribution_tails(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("k"), (0.2 * c("n_nationkey") + 0.05).alias("z"), (c("n_nationkey") + 2.0).alias("df"))
    out = x.select("k", d.norm_cdf(c("z")).alias("norm_cdf"), d.norm_p2(c("z")).alias("norm_p2"), d.t_p2(c("z"), c("df")).alias("t_p2"), d.chi2_sf(c("z") * 3, c("df")).alias("chi2_sf"), d.f_sf(c("z"), F.lit(4.0), c("df")).alias("f_sf"))
    return rounded(out, 8)


# Studies: one per nation, the mean account balance of its customers; an analysis per region; three bad rows.
_STUDIES = f"""SELECT n_regionkey::BIGINT AS analysis, n_name AS label, avg(c_acctbal) AS est, avg(c_acctbal) - {Z} * stddev_samp(c_acctbal) / sqrt(count(*)) AS lo, avg(c_acctbal) + {Z} * stddev_samp(c_acctbal) / sqrt(count(*)) AS hi
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL SELECT r_regionkey, 'bad', 5.0, 6.0, 7.0 FROM region WHERE r_regionkey < 3"""
_META = f"""WITH st AS ({_STUDIES}), v AS (SELECT analysis, label, {{y}} AS y, ({{f}}(hi) - {{f}}(lo)) / (2 * {Z}) AS se FROM st WHERE lo <= est AND est <= hi AND hi > lo{{more}}),
w AS (SELECT *, 1 / (se * se) AS w FROM v), s AS (SELECT analysis, count(*) k, sum(w) sw, sum(w * y) swy, sum(w * w) sw2 FROM w GROUP BY 1 HAVING count(*) > 1),
q AS (SELECT s.*, q FROM s JOIN (SELECT w.analysis, sum(w * (y - swy / sw)^2) AS q FROM w JOIN s USING (analysis) GROUP BY 1) USING (analysis)),
t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
r AS (SELECT w.analysis, w.label, w.w, 1 / (se * se + tau2) AS wr, y FROM w JOIN t USING (analysis)), rs AS (SELECT analysis, sum(wr) swr, sum(wr * y) swry FROM r GROUP BY 1)"""


def _studies(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy(c("n_regionkey").cast("bigint").alias("analysis"), c("n_name").alias("label"))
    half = Z * c("sd") / F.sqrt("n")
    good = by.agg(F.avg("c_acctbal").alias("est"), F.stddev_samp("c_acctbal").alias("sd"), F.count("*").alias("n")).select("analysis", "label", "est", (c("est") - half).alias("lo"), (c("est") + half).alias("hi"))
    bad = table(spark, sf, "region").where("r_regionkey < 3").select(c("r_regionkey").cast("bigint"), F.lit("bad"), F.lit(5.0), F.lit(6.0), F.lit(7.0))
    return good.union(bad)


@query(_META.format(y="est", f="", more="") + f""" SELECT analysis, k, (SELECT count(*) FROM st WHERE st.analysis = t.analysis) - k AS skipped, round(swy / sw, 4) AS fixed, round(swy / sw - {Z} / sqrt(sw), 4) AS fixed_lo, round(swy / sw + {Z} / sqrt(sw), 4) AS fixed_hi,
round(swry / swr, 4) AS random, round(swry / swr - {Z} / sqrt(swr), 4) AS random_lo, round(swry / swr + {Z} / sqrt(swr), 4) AS random_hi, round(q, 4) AS q, k - 1 AS df, round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END, 4) AS i2, round(tau2, 3) AS tau2
FROM t JOIN rs USING (analysis)""")
def meta_pooled(spark: SparkSession, sf: str) -> DataFrame:
    out = meta.pooled(_studies(spark, sf), ratio=False, p=False).drop("fixed_z", "random_z")
    return rounded(out, 4).withColumn("tau2", F.round("tau2", 3))


@query(_META.format(y="ln(est)", f="ln", more=" AND lo > 0") + " SELECT r.analysis, label, round(100 * w / sw, 4) AS fixed_weight, round(100 * wr / swr, 4) AS random_weight FROM r JOIN t USING (analysis) JOIN rs USING (analysis)")
def meta_ratio_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(meta.weights(_studies(spark, sf), ratio=True).select("analysis", "label", "fixed_weight", "random_weight"), 4)


@query()
def meta_notes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(meta.warnings(meta.pooled(_studies(spark, sf), ratio=False)), 4)


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY 1""")
def quantiles_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.quantiles(table(spark, sf, "orders"), "o_totalprice", {"p10": 0.1, "p90": 0.9, "p99": 0.99}, ["o_orderpriority"])


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice FROM r, n WHERE i % greatest(ceil(n / 1500), 1) = 0""")
def thinned_points(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.thinned(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("""WITH m AS (SELECT l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY 1), r AS (SELECT *, m / 4 AS raw, 10.0 ^ floor(log10(m / 4)) AS size FROM m),
s AS (SELECT *, CASE WHEN size >= raw THEN size WHEN 2 * size >= raw THEN 2 * size WHEN 5 * size >= raw THEN 5 * size ELSE 10 * size END AS step FROM r)
SELECT l_returnflag, round(ceil(m / step) * step, 6) AS top, round(greatest(step, 1), 6) AS step FROM s""")
def chart_axes(spark: SparkSession, sf: str) -> DataFrame:
    most = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("m"))
    return most.select("l_returnflag", statistics.axis(c("m")).alias("a")).select("l_returnflag", "a.*")


@query("""WITH s AS (SELECT count(*) n, corr(l_quantity, l_extendedprice) r, regr_slope(l_extendedprice, l_quantity) slope, regr_intercept(l_extendedprice, l_quantity) intercept FROM lineitem)
SELECT n, round(r, 5) AS r, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM s""", 5)
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.correlate(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", "r", "slope", "intercept")


@query()
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.summary(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "o_orderstatus"])


@query("""SELECT category, round(s, 8) AS ppv_at_5, round(p, 8) AS after_positive FROM (SELECT category, sens * 0.05 / (sens * 0.05 + (1 - spec) * 0.95) AS s, (lr * 0.1 / 0.9) / (1 + lr * 0.1 / 0.9) AS p
FROM (SELECT category, a / (a + c) AS sens, d / (b + d) AS spec, (a / (a + c)) / (1 - d / (b + d)) AS lr FROM (""" + _COUNTS + """)))""", 8)
def predictive_values(spark: SparkSession, sf: str) -> DataFrame:
    out = clinical.diagnostic(_tables(spark, sf))
    return out.select("category", clinical.predictive_values(c("sens"), c("spec"), F.lit(0.05))["ppv"].alias("ppv_at_5"), clinical.post_test(F.lit(0.1), c("lr_plus")).alias("after_positive"))


@query("""SELECT a, b, c, d, CASE WHEN a <> floor(a) THEN 'Counts must be whole numbers, zero or more.' WHEN a + b = 0 OR c + d = 0 THEN 'Each group needs at least one person.' END AS problem
FROM (SELECT l_quantity / 2 AS a, l_linenumber::DOUBLE - 1 AS b, l_linenumber::DOUBLE AS c, 0::DOUBLE AS d FROM lineitem)""")
def table_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((c("l_quantity") / 2).alias("a"), (c("l_linenumber") - 1.0).alias("b"), c("l_linenumber").cast("double").alias("c"), F.lit(0.0).alias("d"))
    return rows.withColumn("problem", clinical.problem())


@query()
def meta_export(spark: SparkSession, sf: str) -> DataFrame:
    studies = _studies(spark, sf)
    return meta.export_lines(meta.weights(studies, ratio=False), meta.pooled(studies, ratio=False, p=False))
