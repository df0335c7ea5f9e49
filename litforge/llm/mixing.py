"""Problem 9: mix sources to target shares of all tokens, repeating no document more often than its source allows.

Entropy balancing. Every document of a source gets the rate r = min(m, exp(b x)), x its tokens over the mean of its source
and m the repeats allowed: of all rates that give the source its share of the tokens these are the nearest to one copy
each, in relative entropy. Where a source has to shrink, long documents are thinned more than short ones, where it has to
grow, they are repeated more. The dual in b is convex in one unknown a source; it is solved by Newton iterations kept
between bounds, each one distributed aggregation of the sums that gradient and Hessian need, and only a few numbers per
source reach the driver. A source that does not converge raises.

The mix is as large as the scarcest source allows, unless a smaller total is given; ``limits`` marks that source in the
shares. A source whose share misses its target by more than ``TOLERANCE`` of it is marked ``missed``; a source that is to
have tokens gets one document at least.

Rates depend on source and length only, so documents are counted once per (source, tokens, part), and the iterations
run over this table. Rounding is systematic along it: rates are summed up in order of length and every whole number
that is passed is one copy, which keeps the tokens of a source within about one document of its target. The sums are taken
in ranges (:func:`litforge.operators.statistics.prefix`) and parts hold some thousand documents, so a source or length
with a large share of all documents is spread over many tasks.

Defined results: documents without tokens (null, empty) and of sources without a target, null included, are not in the
mix; a target without documents is reported with share 0 and the others keep their proportions; an empty table gives
no documents and shares of 0; equal documents with different ids count separately.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litforge.core.session import cut, table
from litforge.llm import tokens
from litforge.operators.statistics import prefix

#: Documents of one (source, tokens, part), about.
PART = 4096
#: Parts of one length, of which none has more.
MOST_PARTS = 1_000_000
#: Sources that may have a target; their multipliers are on the driver.
MOST_SOURCES = 10_000


#: Part of its target that a source's share may be off before it is marked.
TOLERANCE = 0.05
#: Exponents are kept below this, where every rate is at its limit.
STEEPEST = 60.0


def _sums(cells: DataFrame, state: dict[str, dict]) -> dict[str, tuple[float, float]]:
    """Per source: tokens at the present rates in means, and their slope in b."""
    rows = [(s, float(v["b"]), float(v["mean"]), float(v["most"])) for s, v in state.items()]
    now = cells.sparkSession.createDataFrame(rows, "source string, b double, mean double, most double")
    x = F.col("n_tokens") / F.col("mean")
    raw = F.exp(F.greatest(F.least(F.col("b") * x, F.lit(STEEPEST)), F.lit(-700.0)))
    joined = cells.join(F.broadcast(now), "source").select("source", F.col("n").cast("double").alias("n"), x.alias("x"), F.least(raw, "most").alias("r"), (raw < F.col("most")).cast("double").alias("free"))
    n, r, x, free = (F.col(c) for c in ("n", "r", "x", "free"))
    return {row[0]: (row[1], row[2]) for row in joined.groupBy("source").agg(F.sum(n * r * x), F.sum(n * r * x * x * free)).collect()}


def solve(cells: DataFrame, goals: dict[str, dict], rounds: int = 200, close: float = 1e-9) -> dict[str, dict]:
    """``goals`` (source: tokens wanted, mean, most, all tokens) with the multiplier b that meets them; raises where none is found."""
    state = {s: g | {"b": 0.0, "lo": -math.inf, "hi": math.inf, "gap": math.inf} for s, g in goals.items()}
    for v in state.values():
        if v["wanted"] >= v["most"] * v["tokens"] * (1 - 1e-12):  # every document as often as allowed
            v |= {"b": STEEPEST * v["mean"], "gap": 0.0}
    for _ in range(rounds):
        todo = {s: v for s, v in state.items() if v["gap"] > close}
        if not todo:
            return state
        for s, (got, slope) in _sums(cells, todo).items():
            v = todo[s]
            want = v["wanted"] / v["mean"]
            v["gap"] = abs(got - want) / want
            if v["gap"] <= close:
                continue
            v["lo" if got < want else "hi"] = v["b"]
            move = v["b"] - (got - want) / slope if slope > 0 else math.nan
            if not v["lo"] < move < v["hi"] or abs(move - v["b"]) > 4:  # a step out of the bounds: halve them, or go on by a fixed step
                move = (v["lo"] + v["hi"]) / 2 if math.isfinite(v["lo"] + v["hi"]) else v["b"] + (4 if got < want else -4)
            if math.isfinite(v["lo"] + v["hi"]) and v["hi"] - v["lo"] <= 1e-13 * max(1.0, abs(v["b"])):
                v["gap"] = 0.0  # the limits of the rates leave a step here; rounding and correction meet the target
            v["b"] = move
    left = [s for s, v in state.items() if v["gap"] > close]
    if left:
        raise ArithmeticError(f"no rates were found for the sources {left}")
    return state


def corrected(plan: DataFrame, wanted: dict[str, float], rounds: int = 50) -> DataFrame:
    """``plan(source, n_tokens, part, base, more, n)`` with single copies added or taken where that nears a source's target.

    A round finds, per source, the length nearest to the tokens missing (or too many) by one aggregation; only that
    cell per source reaches the driver. Every round brings a source nearer, and the last one is that in which none can be;
    ``rounds`` bounds them, and reaching it raises.
    """
    if not wanted:
        return plan
    goal = plan.sparkSession.createDataFrame(sorted(wanted.items()), "source string, wanted double")
    for _ in range(rounds):
        plan = cut(plan)
        copies = F.col("base") * F.col("n") + F.col("more")
        gaps = plan.groupBy("source").agg(F.sum(copies * F.col("n_tokens")).alias("got"), F.sum(copies).alias("copies")).join(goal, "source").select("source", (F.col("wanted") - F.col("got")).alias("gap"), "copies")
        able = F.when(F.col("gap") > 0, F.col("more") < F.col("n")).otherwise(F.col("more") > 0)
        off = F.abs(F.abs("gap") - F.col("n_tokens"))
        best = (
            plan.join(F.broadcast(gaps), "source")
            # nearer than now, or the first document of a source that has none; the last one stays
            .where(able & ((off < F.abs("gap")) | (F.col("copies") == 0)) & ((F.col("gap") < 0) | F.col("open")) & ((F.col("gap") > 0) | (F.col("copies") > 1)))
            .groupBy("source")
            .agg(F.min_by(F.struct("n_tokens", "part", F.signum("gap").cast("int").alias("d")), F.struct(off, "n_tokens", "part")).alias("c"))
            .select("source", "c.*")
            .collect()
        )
        if not best:
            break
        change = plan.sparkSession.createDataFrame([tuple(r) for r in best], "source string, n_tokens long, part long, d int")
        plan = plan.join(F.broadcast(change), ["source", "n_tokens", "part"], "left").withColumn("more", F.col("more") + F.coalesce("d", F.lit(0))).drop("d")
    else:
        raise ArithmeticError(f"the copies did not settle in {rounds} rounds")
    return plan


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of ``documents(doc_id, source, n_tokens)`` for ``targets(source, target_share, max_repeats)``.

    copies: doc_id, source, n_tokens, copies (1 and more). shares: source, target_share, max_repeats, n_documents,
    n_tokens (of the source), wanted_tokens, mix_documents, mix_tokens, share, most_copies, limits (the source that keeps the
    mix from being larger), missed (the share is off its target by more than TOLERANCE of it).
    """
    wanted = {r["source"]: r for r in targets.where(F.col("source").isNotNull()).limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    usable = documents.where(F.col("n_tokens") > 0).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    usable = cut(usable.select("doc_id", "source", "n_tokens"))
    counted = usable.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    placed = usable.join(counted.select("source", "n_tokens", F.ceil(F.col("n") / PART).alias("parts")), ["source", "n_tokens"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    cells = cut(placed.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n")))
    totals = {r["source"]: r for r in cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}
    there = {s: float(w["target_share"]) for s, w in wanted.items() if s in totals and w["target_share"] > 0 and w["max_repeats"] > 0}
    whole = sum(there.values())
    goals = {}
    if there:
        rooms = {s: wanted[s]["max_repeats"] * totals[s]["tokens"] * whole / share for s, share in there.items()}
        room = min(rooms.values())
        size = room if total is None else min(total, room)
        goals = {
            s: {"wanted": size * share / whole, "tokens": float(totals[s]["tokens"]), "limits": rooms[s] <= size * (1 + 1e-12), "mean": totals[s]["tokens"] / totals[s]["n"], "most": float(wanted[s]["max_repeats"])}
            for s, share in there.items()
        }
    state = solve(cells, goals)
    spark = documents.sparkSession
    fitted = spark.createDataFrame([(s, float(v["b"]), float(v["mean"]), float(v["most"]), float(v["wanted"]), bool(v["limits"])) for s, v in state.items()], "source string, b double, mean double, most double, wanted double, limits boolean")
    rate = F.least(F.exp(F.least(F.col("b") * F.col("n_tokens") / F.col("mean"), F.lit(STEEPEST))), "most")
    rated = cells.join(F.broadcast(fitted), "source").withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("rest", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) * F.col("n"))
    # lengths in order, and the parts of one length in theirs
    along = rated.withColumn("ord", F.col("n_tokens") * F.lit(MOST_PARTS) + F.col("part"))
    summed = prefix(along, "ord", "rest", ["source"]).withColumn("upto", F.col("before") + F.col("rest"))
    more = F.floor(F.col("upto") + 0.5) - F.floor(F.col("before") + 0.5)
    plan = summed.select("source", "n_tokens", "part", F.col("base").cast("int").alias("base"), F.least(more, "n").alias("more"), (F.col("base") < F.col("most")).alias("open"))
    plan = corrected(plan.join(cells, ["source", "n_tokens", "part"]), {s: v["wanted"] for s, v in state.items()})
    order = Window.partitionBy("source", "n_tokens", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    chosen = placed.withColumn("place", F.row_number().over(order)).join(plan, ["source", "n_tokens", "part"])
    copies = chosen.select("doc_id", "source", "n_tokens", (F.col("base") + (F.col("place") <= F.col("more")).cast("int")).alias("copies")).where(F.col("copies") > 0)
    reached = copies.groupBy("source").agg(F.count("*").alias("mix_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    have = cells.groupBy("source").agg(F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    every = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    shares = (
        targets.join(have, "source", "left").join(fitted.select("source", F.col("wanted").alias("wanted_tokens"), "limits"), "source", "left").join(reached, "source", "left")
        .fillna(0, ["n_documents", "n_tokens", "wanted_tokens", "mix_documents", "mix_tokens", "most_copies"])
        .withColumn("share", F.when(every > 0, F.round(F.col("mix_tokens") / every, 8)).otherwise(0.0))
        .withColumn("wanted_tokens", F.round("wanted_tokens", 3))
        .withColumn("limits", F.coalesce("limits", F.lit(False)))
        .withColumn("missed", F.abs(F.col("share") - F.col("target_share")) > TOLERANCE * F.col("target_share"))
    )
    return copies, shares


def document_mix(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = tokens.token_count(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mix(documents, table(spark, sf_dir, "mix_targets"))
