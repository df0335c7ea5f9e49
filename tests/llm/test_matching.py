"""Problems 1 and 2 on small tables: bounds, blank records, copies, votes."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.llm import papers, survivors

SHAPE = "rec long, source string, title string, cut boolean, year int, doi string, pmid string, pmcid string, volume string, page string, issue string, journal string, names array<string>"


def record(rec, source="a", title="", year=None, doi=None, pmid=None, pmcid=None, volume=None, page=None, issue=None, journal=None, names=(), cut=False):
    return rec, source, title, cut, year, doi, pmid, pmcid, volume, page, issue, journal, list(names)


def records(spark, *rows):
    return spark.createDataFrame([record(**r) for r in rows], SHAPE)


def random_records(n, seed):
    draw = random.Random(seed)
    words = ["effect", "of", "drugamab", "brexopathy", "risk", "factors", "for", "older", "adults", "trial", "ii", "2019", "cohort"]
    maybe = lambda *x: draw.choice([None, *x])
    for rec in range(n):
        title = " ".join(draw.choices(words, k=draw.randint(0, 9)))
        yield dict(
            rec=rec, source=draw.choice("aoc"), title=title, cut=draw.random() < 0.1, year=maybe(2018, 2019, 2021), doi=maybe("10.1/a", "10.1/b"), pmid=maybe("11", "12"), pmcid=maybe("PMC1"),
            volume=maybe("1", "2"), page=maybe("10", "20"), issue=maybe("1"), journal=maybe("joumed", "annmed"), names=draw.sample(["aann", "bbob", "cciv"], draw.randint(0, 2)),
        )


def test_bound_is_never_under_the_score(spark):
    rows = records(spark, *random_records(60, 5))
    a = rows.select(F.struct(*rows.columns).alias("a"), F.struct("rec", *papers.sketch()).alias("s"))
    b = a.select(F.col("a").alias("b"), F.col("s").alias("t"))
    pairs = a.crossJoin(b).where("a.rec < b.rec").select(papers.score(F.col("a"), F.col("b")).alias("score"), "s", "t").collect()
    column = lambda side: {f: np.array([papers.NONE if p[side][f] is None else p[side][f] for p in pairs], np.int64) for f in papers.SKETCH}
    bounds = papers.bounds(column("s"), column("t"))
    scores = np.array([p.score for p in pairs])
    assert (bounds >= scores - 1e-9).all()
    assert (scores >= papers.MATCH).any() and (bounds < papers.MATCH).mean() > 0.5


def test_blank_records_match_nothing(spark):
    rows = records(spark, *[dict(rec=i) for i in range(4)], *[dict(rec=10 + i, source="o") for i in range(2)])
    assert papers.match_sources(rows).count() == 0 and papers.matches(rows).count() == 0


def test_a_first_letter_does_not_decide(spark):
    one = dict(title="the effect of metformin on outcomes of diabetes", year=2020, volume="12", journal="joumed", page="7")
    rows = records(spark, dict(rec=1, **one, names=["aann"]), dict(rec=2, source="o", **one | {"title": "zhe effect of metformin on outcomes of diabetes"}), dict(rec=3, source="o", title="another thing altogether and more", year=2020))
    assert [(r.rec_a, r.rec_b) for r in papers.match_sources(rows).collect()] == [(1, 2)]


def test_long_titles_are_compared_in_proportion(spark):
    title = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = records(spark, dict(rec=1, title=title, year=2020, page="5", journal="joumed"), dict(rec=2, source="c", title=title.replace("word", "wor", 30), year=2020, page="5", journal="joumed"))
    assert papers.match_sources(rows).count() == 1


def test_copies_of_one_record_stay_together(spark):
    one = dict(title="a title of some length and content", year=2020, doi="10.1/x", names=["aann"])
    rows = records(spark, *[dict(rec=i, **one) for i in range(300)], dict(rec=999, source="o", **one))
    assert papers.match_sources(rows).count() == 300
    members, links = papers.clusters(rows)
    assert {r.cluster for r in members.where("source = 'a'").collect()} == {0} and [(r.a, r.b) for r in links.collect()] == [(0, 999)]


def test_empty_tables(spark):
    assert papers.match_sources(records(spark)).count() == 0


def test_common_words_come_from_the_data(spark):
    rows = spark.createDataFrame([(f"Coined{chr(97 + i // 26)}{chr(97 + i % 26)} Study Group",) for i in range(600)] + [(None,), ("",)], "name string")
    assert papers.common_words(rows) == sorted("".join(sorted(w)) for w in ("study", "group"))


VOTES = "group_id long, field_name string, rec long, source string, fetched_at timestamp, value string, norm string"


def votes(spark, *rows):
    start = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(g, f, rec, src, start + dt.timedelta(days=day), v, v) for g, f, rec, src, day, v in rows], VOTES)


def test_two_older_values_outvote_one_newer(spark):
    rows = votes(spark, (1, "volume", 1, "s", 0, "7"), (1, "volume", 2, "s", 10, "7"), (1, "volume", 3, "s", 20, "8"))
    assert survivors.elect(rows, 90 * 86_400).first().value == "7"
    assert survivors.elect(rows, 86_400).first().value == "8"
    newest = survivors.elect(rows, 0.0).first()
    assert (newest.value, newest.rec) == ("8", 3)
    with pytest.raises(ValueError, match="half-life"):
        survivors.elect(rows, -1)


def test_trusted_sources_weigh_more(spark):
    rows = votes(spark, *[(g, "volume", 10 * g + k, s, 0, v) for g in range(20) for k, (s, v) in enumerate([("good", "7"), ("fine", "7"), ("bad", "9")])])
    trust = {r.source: r.trust for r in survivors.source_trust(rows).collect()}
    assert trust["good"] > 0.8 > 0.3 > trust["bad"]
    duel = votes(spark, (1, "volume", 1, "good", 0, "7"), (1, "volume", 2, "bad", 1, "9"))
    assert survivors.elect(duel, 90 * 86_400, survivors.source_trust(rows)).first().value == "7"


def test_shortened_against_any_longer_text(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma"), (1, "one two three four five"), (1, "one two thr"), (2, "single")], "group_id long, norm string")
    assert sorted(r.norm for r in survivors.shortened(rows).collect()) == ["alpha beta gamma", "one two thr"]
