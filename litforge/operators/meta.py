"""Fixed- and random-effects meta-analysis of many analyses at once, in one shuffle on the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions.distributions import Z95, chi2_sf, norm_p2
from litforge.functions.text import shown_number
from litforge.operators.effects import measure_label

c = F.col


def parse_estimate(text: Column) -> Column:
    """A number typed with a point or a comma; null if it is none."""
    return F.regexp_replace(F.trim(text), "^([^,]*),", "$1.").try_cast("double")


def study_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """label, est, lo, hi of pasted lines: parts between semicolons, tabs or commas before a number; others are left out."""
    parts = F.split(text, r"[;\t]|,(?=\s*[\d.-])")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    return lines.where(F.size(parts) >= 4).select(*[x for x in lines.columns if x != text], at(0).alias("label"), *[parse_estimate(at(i)).alias(n) for i, n in ((1, "est"), (2, "lo"), (3, "hi"))])


def weights(studies: DataFrame, ratio: bool, by: str = "analysis") -> DataFrame:
    """Each valid study with y, se, its fixed and random weight in per cent, and the sums of its analysis.

    A study is valid if lo <= est <= hi, the interval has a width, and ratios are positive; others are skipped.
    """
    f = (lambda x: F.log(x)) if ratio else (lambda x: x)
    ok = (c("lo") <= c("est")) & (c("est") <= c("hi")) & (c("hi") > c("lo"))
    if ratio:
        ok = ok & (c("lo") > 0)
    rows = studies.where(F.coalesce(ok, F.lit(False))).withColumn("y", f(c("est"))).withColumn("se", (f(c("hi")) - f(c("lo"))) / (2 * Z95))
    w = Window.partitionBy(by)
    rows = rows.withColumn("w", 1 / (c("se") * c("se")))
    for name, e in (("k", F.lit(1)), ("sw", c("w")), ("swy", c("w") * c("y")), ("sw2", c("w") * c("w"))):
        rows = rows.withColumn(name, F.sum(e).over(w))
    rows = rows.where(c("k") > 1).withColumn("q", F.sum(c("w") * (c("y") - c("swy") / c("sw")) ** 2).over(w))
    scale = c("sw") - c("sw2") / c("sw")
    rows = rows.withColumn("tau2", F.greatest(F.lit(0.0), (c("q") - (c("k") - 1)) / scale)).withColumn("wr", 1 / (c("se") * c("se") + c("tau2")))
    rows = rows.withColumn("swr", F.sum("wr").over(w)).withColumn("swry", F.sum(c("wr") * c("y")).over(w))
    return rows.withColumn("fixed_weight", 100 * c("w") / c("sw")).withColumn("random_weight", 100 * c("wr") / c("swr"))


def pooled(studies: DataFrame, ratio: bool, by: str = "analysis", p: bool = True) -> DataFrame:
    """Pooled estimates, heterogeneity and number of skipped studies of each analysis with two valid studies or more."""
    g = F.exp if ratio else (lambda x: x)
    every = studies.groupBy(by).agg(F.count("*").alias("n_all"))
    one = weights(studies, ratio, by).groupBy(by).agg(*[F.max(x).alias(x) for x in ("k", "sw", "swy", "q", "tau2", "swr", "swry")]).join(every, by)
    fixed, random = c("swy") / c("sw"), c("swry") / c("swr")
    se_f, se_r = 1 / F.sqrt("sw"), 1 / F.sqrt("swr")
    out = one.select(
        by, "k", (c("n_all") - c("k")).alias("skipped"), g(fixed).alias("fixed"), g(fixed - Z95 * se_f).alias("fixed_lo"), g(fixed + Z95 * se_f).alias("fixed_hi"),
        g(random).alias("random"), g(random - Z95 * se_r).alias("random_lo"), g(random + Z95 * se_r).alias("random_hi"),
        "q", (c("k") - 1).alias("df"), F.when(c("q") > 0, F.greatest(F.lit(0.0), (c("q") - (c("k") - 1)) / c("q")) * 100).otherwise(0.0).alias("i2"), "tau2",
        (fixed / se_f).alias("fixed_z"), (random / se_r).alias("random_z"),
    )
    return out.withColumn("q_p", chi2_sf(c("q"), c("df"))).withColumn("fixed_p", norm_p2(c("fixed_z"))).withColumn("random_p", norm_p2(c("random_z"))) if p else out


def warnings(result: DataFrame, kinds: DataFrame | None = None, by: str = "analysis") -> DataFrame:
    """``result`` with column notes: what to mind when reading it. ``kinds`` is (analysis, kind), the measures of the studies used."""
    if kinds is not None:
        counts = kinds.where(c("kind").isNotNull()).groupBy(by).agg(F.count_distinct("kind").alias("__kinds"))
        result = result.join(counts, by, "left")
    notes = [
        F.when(c("__kinds") > 1, "different measures are mixed") if kinds is not None else F.lit(None).cast("string"),
        F.when(c("i2") >= 75, "heterogeneity is high").when(c("i2") >= 50, "heterogeneity is moderate"),
        F.when(c("k") < 5, "fewer than five studies"),
    ]
    return result.withColumn("notes", F.array_compact(F.array(*notes))).drop("__kinds")


def measure_names(kinds: DataFrame, otherwise: str = "Effect", by: str = "analysis") -> DataFrame:
    """analysis, measure: the label of the measure that all studies share, ``otherwise`` where there are several or none."""
    one = kinds.groupBy(by).agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    return one.select(by, F.when(c("a") == c("b"), measure_label(c("a"))).otherwise(otherwise).alias("measure"))


def export_lines(weighed: DataFrame, result: DataFrame, measure: str = "Effect", by: str = "analysis") -> DataFrame:
    """analysis, part, label, line: the export of every analysis; part 0 is the header, 1 a study, 2 and 3 the pooled estimates.

    ``weighed`` is :func:`weights`, ``result`` is :func:`pooled`.
    """
    text = lambda x: x.cast("string")
    head = result.select(by, F.lit(0).alias("part"), F.lit("").alias("label"), F.lit(f"Study,{measure},Lower 95%,Upper 95%,Weight fixed %,Weight random %").alias("line"))
    name = F.concat(F.lit('"'), F.replace(F.trim("label"), F.lit('"'), F.lit('""')), F.lit('"'))
    study = weighed.select(by, F.lit(1).alias("part"), "label", F.concat_ws(",", name, text(c("est")), text(c("lo")), text(c("hi")), shown_number(c("fixed_weight"), 1), shown_number(c("random_weight"), 1)).alias("line"))
    total = lambda part, title, n: result.select(by, F.lit(part).alias("part"), F.lit(title).alias("label"), F.concat(F.concat_ws(",", F.lit(title), text(c(n)), text(c(f"{n}_lo")), text(c(f"{n}_hi"))), F.lit(",,")).alias("line"))
    return head.unionByName(study).unionByName(total(2, "Fixed effect", "fixed")).unionByName(total(3, "Random effects", "random"))


def chosen_studies(papers: DataFrame, effects: DataFrame, decisions: DataFrame, overrides: DataFrame, unused: DataFrame, hand: DataFrame) -> DataFrame:
    """Studies of a list's analysis: included papers (all but the excluded ones if none is), their effects or corrections, and typed rows.

    papers(analysis, key, label), effects and overrides(key, est, lo, hi), decisions(key, decision), unused(key), hand(analysis, label, est, lo, hi).
    """
    rows = papers.join(decisions, "key", "left")
    picky = F.max(F.coalesce(c("decision") == "include", F.lit(False))).over(Window.partitionBy("analysis"))
    rows = rows.withColumn("picky", picky).where(F.when(c("picky"), c("decision") == "include").otherwise(F.coalesce("decision", F.lit("")) != "exclude")).join(unused, "key", "left_anti")
    fixed = overrides.select("key", *[c(x).alias(f"{x}_o") for x in ("est", "lo", "hi")])
    rows = rows.join(effects.select("key", "est", "lo", "hi"), "key", "left").join(fixed, "key", "left")
    own = c("est_o").isNotNull()
    values = [F.when(own, c(f"{x}_o")).otherwise(c(x)).alias(x) for x in ("est", "lo", "hi")]
    return rows.select("analysis", "label", *values).where(c("est").isNotNull()).unionByName(hand.select("analysis", "label", "est", "lo", "hi"))
