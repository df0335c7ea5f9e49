"""Problem 2: the best representative of each group of duplicate records, field by field.

Fields are unpivoted to long rows. Every complete value casts a vote: the trust in its source times a decay with its age
against the newest complete one of its group and field, 0.5 to the power of age over half-life. Votes are summed per
normalised value, the value with most votes wins by ``max_by``, and the winners are pivoted back to one row. Two older
sources that agree can so outvote one newer one.

``half_life`` 0 is the limit of ever shorter half-lives: only the values of the newest date vote. That is the rule this
project's data states for ``p2_found`` ("the latest complete one"); ``p2_survivors`` votes with ``HALF_LIFE`` and the trust of each
source, which is the share of its complete values that the other records of their groups bear out (:func:`source_trust`).

An abstract is shortened if a longer complete one of its group holds nearly all of its words and has letters more. A group's
abstracts are compared by way of the longest one that holds each of their words, by joins on the group.

All steps are aggregations and joins on the group with partial combining, so a group that holds a large share of all rows is
never gathered in one task.

Defined results: null values count as not complete; groups without a complete value of a field have no winner for it;
equal votes go to the newest record, then to the smallest id; repeated rows vote again; records in no group and empty
tables give no rows; a source without values that could be borne out has trust ``NO_TRUST``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.core.graph import components
from litforge.core.session import cut, table
from litforge.llm import papers

#: Seconds after which a vote counts half in ``p2_survivors``.
HALF_LIFE = 90 * 86_400.0
#: Trust in a source of which nothing could be borne out, and values added on both sides, so that few values tell little.
NO_TRUST, PRIOR_VALUES = 0.5, 4

FIELDS = ("abstract", "pmcid", "volume", "pages")
#: Letters and digits by which an abstract must be shorter than another to count as shortened against it, and words of its own it may have.
SHORTER, OWN_WORDS = 8, 2


def paper_groups(records: DataFrame) -> DataFrame:
    """rec, group_id for ``records`` (features) of papers with two and more of them; group_id is the smallest id."""
    found = papers.matches(records)
    return cut(components(found.select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b")))).select(F.col("node").alias("rec"), F.col("component").alias("group_id"))


def candidates(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, field_name, rec, source, fetched_at, value, norm of the complete values of every group, one row per record and field.

    source is the catalogue a record came from, the part of its source id before the colon.
    """
    source = F.coalesce(F.nullif(F.substring_index("source_id", ":", 1), F.lit("")), F.lit("service"))
    rows = articles.select(F.col("article_id").alias("rec"), source.alias("source"), *FIELDS, "fetched_at").join(groups, "rec")
    long = rows.select("group_id", "rec", "source", "fetched_at", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x"))
    long = long.select("group_id", "rec", "source", "fetched_at", "x.*")
    plain = F.trim("value")
    complete = (
        F.when(F.col("field_name") == "abstract", F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]+", "")) > 3)
        .when(F.col("field_name") == "pmcid", plain.rlike(r"^PMC\d{7}\z"))
        .when(F.col("field_name") == "volume", plain.rlike(r"^0*[1-9]\d*\z"))
        .otherwise(plain.rlike(r"^(?:0*[1-9]\d*\s?[-–]\s?0*[1-9]\d*|e\d+)\z"))
    )
    norm = F.when(F.col("field_name") == "abstract", F.trim(F.regexp_replace(papers.folded(F.col("value")), r"[^\p{L}\p{N}]+", " "))).otherwise(plain)
    long = cut(long.where(F.coalesce(complete, F.lit(False))).withColumn("norm", norm))
    short = shortened(long.where(F.col("field_name") == "abstract").select("group_id", "norm").distinct()).withColumn("field_name", F.lit("abstract"))
    return long.join(short, ["group_id", "field_name", "norm"], "left_anti")


def shortened(texts: DataFrame) -> DataFrame:
    """group_id, norm of the distinct ``texts(group_id, norm)`` that another text of their group is a longer version of.

    Versions are told against the longest text of the group; what has words of its own beside that one is compared with
    the longest of the rest, and so on, until a round finds no text that any other could hold.
    """
    letters = F.length(F.replace("norm", F.lit(" "), F.lit("")))
    left = cut(texts.select("group_id", "norm", letters.alias("letters"), F.array_distinct(F.split("norm", " ")).alias("words")))
    out: list[DataFrame] = []
    while True:
        tops = left.groupBy("group_id").agg(F.max(F.struct("letters", "norm", "words")).alias("top"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
        told = left.join(tops, "group_id").where(F.col("norm") != F.col("top.norm"))
        own = F.size(F.array_except("words", "top.words"))
        told = cut(told.withColumn("short", (F.col("top.letters") - F.col("letters") >= SHORTER) & (own <= OWN_WORDS)).select("group_id", "norm", "letters", "words", "short"))
        out.append(told.where("short").select("group_id", "norm"))
        rest = told.where(~F.col("short")).select("group_id", "norm", "letters", "words")
        if rest.groupBy("group_id").count().where("count > 1").isEmpty():
            return reduce(DataFrame.unionByName, out)
        left = rest


def source_trust(rows: DataFrame) -> DataFrame:
    """source, trust: the share of a source's values that other records of their group and field bear out, for ``candidates``.

    Groups with one value of a field say nothing. ``PRIOR_VALUES`` values of trust ``NO_TRUST`` are added to every source.
    """
    keys = ["group_id", "field_name"]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    agree = rows.groupBy(*keys, "norm").agg(F.count("*").alias("same"))
    told = rows.join(whole, keys).join(agree, [*keys, "norm"]).groupBy("source").agg(F.count("*").alias("told"), F.count_if(F.col("same") > 1).alias("borne"))
    share = (F.coalesce("borne", F.lit(0)) + NO_TRUST * PRIOR_VALUES) / (F.coalesce("told", F.lit(0)) + PRIOR_VALUES)
    return rows.select("source").distinct().join(told, "source", "left").select("source", share.alias("trust"))


def elect(rows: DataFrame, half_life: float = HALF_LIFE, trust: DataFrame | None = None) -> DataFrame:
    """group_id, field_name, rec, value, votes: the winning value of ``candidates`` and the newest record that has it.

    ``trust(source, trust)`` weighs the votes; a source it does not name has ``NO_TRUST``, and without it all count 1.
    """
    if half_life < 0:
        raise ValueError("a half-life is not negative")
    able = rows.withColumn("trust", F.lit(1.0)) if trust is None else rows.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(NO_TRUST)))
    newest = able.groupBy("group_id", "field_name").agg(F.max("fetched_at").alias("newest"))
    able = able.join(newest, ["group_id", "field_name"])
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))).cast("double") / 1e6
    decay = F.when(age == 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half_life) if half_life else F.lit(0.0))
    votes = (
        able.withColumn("vote", F.col("trust") * F.coalesce(decay, F.lit(0.0)))
        .groupBy("group_id", "field_name", "norm")
        .agg(F.sum("vote").alias("votes"), F.max_by(F.struct("rec", "value"), F.struct("fetched_at", -F.col("rec"))).alias("best"), F.max(F.struct("fetched_at", -F.col("rec"))).alias("last"))
    )
    won = votes.groupBy("group_id", "field_name").agg(F.max_by(F.struct("best", "votes"), F.struct("votes", "last")).alias("won"))
    return won.select("group_id", "field_name", F.col("won.best.rec").alias("rec"), F.col("won.best.value").alias("value"), F.col("won.votes").alias("votes"))


def survivors(elected: DataFrame) -> DataFrame:
    """group_id, one column per field with the surviving value, and one with the record it comes from."""
    wide = elected.groupBy("group_id").pivot("field_name", list(FIELDS)).agg(F.first("value").alias("value"), F.first("rec").alias("rec"))
    return wide.select("group_id", *[F.col(f"{f}_value").alias(f) for f in FIELDS], *[F.col(f"{f}_rec").alias(f"{f}_from") for f in FIELDS])


def article_candidates(spark, sf_dir: str) -> DataFrame:
    return candidates(table(spark, sf_dir, "articles"), paper_groups(papers.article_records(spark, sf_dir)))


def newest_complete(spark, sf_dir: str) -> DataFrame:
    """The newest complete value of every field: the vote at half-life 0, all sources trusted alike."""
    return elect(article_candidates(spark, sf_dir), 0.0)


def article_election(spark, sf_dir: str) -> DataFrame:
    rows = cut(article_candidates(spark, sf_dir))
    return elect(rows, HALF_LIFE, source_trust(rows))
