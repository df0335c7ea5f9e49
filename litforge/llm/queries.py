"""Queries of the ten problems and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litforge.core.session import table
from litforge.llm import languages, lookalikes, mixing, namelink, papers, sentences, survivors, termmap, together, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.match_sources(papers.all_records(spark, sf_dir))


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind member: record a belongs to cluster b of its source; kind link: clusters a and b of two sources are one paper."""
    members, links = papers.clusters(papers.all_records(spark, sf_dir))
    return members.selectExpr("'member' AS kind", "rec AS a", "cluster AS b", "confidence").unionByName(links.selectExpr("'link' AS kind", "a", "b", "confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.newest_complete(spark, sf_dir).selectExpr("group_id", "field_name", "rec AS article_id")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(survivors.article_election(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = together.pair_lift(together.term_baskets(spark, sf_dir))
    return found.selectExpr("kind AS basket_kind", "item_a AS term_a", "item_b AS term_b")


def p3_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.pair_lift(together.term_baskets(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namelink.name_pairs(namelink.link_names(namelink.author_spellings(spark, sf_dir)))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namelink.link_names(namelink.author_spellings(spark, sf_dir))


def _language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").selectExpr("article_id AS id", "lang AS label", "title", "abstract")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _language_rows(spark, sf_dir)
    return languages.mislabelled(languages.segments(rows, languages.fit(rows))).selectExpr("id AS article_id", "lang_code")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _language_rows(spark, sf_dir)
    return languages.segments(rows, languages.fit(rows)).withColumnRenamed("id", "article_id").drop("label")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lookalikes.article_values(table(spark, sf_dir, "articles").select("article_id", "title", "abstract", "authors"))
    return lookalikes.odd_fields(values).selectExpr("row_id AS article_id", "field_name")


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lookalikes.article_values(table(spark, sf_dir, "articles").select("article_id", "title", "abstract", "authors"))
    return lookalikes.canonical_texts(values).selectExpr("row_id AS article_id", "field_name", "element", "canonical")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = termmap.map_values(termmap.term_values(spark, sf_dir), table(spark, sf_dir, "canonical_terms"))
    return found.select("source_table", "row_id", "term_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_confidence, p2_found, p2_survivors, p3_found, p3_lift, p4_found, p4_entities, p5_found, p5_segments, p6_found, p6_canonical, p7_found, p8_ids, p9_mix, p9_shares, p10_found)}


_NORMAL = r"regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
_P3 = f"""
WITH items AS (
  SELECT DISTINCT * FROM (
    SELECT 'article' AS kind, article_id AS basket, {_NORMAL.format("text")} AS item FROM entities WHERE NOT coalesce(negated, false)
    UNION ALL
    SELECT 'run', run_id, {_NORMAL.format("display")} FROM term_groups WHERE NOT coalesce(negated, false))
  WHERE length(item) >= 2),
total AS (SELECT kind, count(DISTINCT basket) AS n_baskets FROM items GROUP BY kind),
single AS (SELECT kind, item, count(*) AS n FROM items GROUP BY kind, item),
pairs AS (
  SELECT a.kind, a.item AS item_a, b.item AS item_b, count(*) AS n
  FROM items a JOIN items b ON a.kind = b.kind AND a.basket = b.basket AND a.item < b.item GROUP BY ALL)
SELECT @COLUMNS FROM pairs p JOIN total t USING (kind)
JOIN single x ON x.kind = p.kind AND x.item = p.item_a JOIN single y ON y.kind = p.kind AND y.item = p.item_b
WHERE p.n >= 4 AND 1000 * p.n >= t.n_baskets AND p.n * t.n_baskets >= 3 * x.n * y.n"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3.replace("@COLUMNS", "p.kind AS basket_kind, item_a AS term_a, item_b AS term_b"),
        "p3_lift": _P3.replace(
            "@COLUMNS",
            "p.kind, item_a, item_b, p.n, x.n AS n_a, y.n AS n_b, t.n_baskets, "
            "round(p.n::DOUBLE * t.n_baskets / (x.n::DOUBLE * y.n), 6) AS lift, round(ln(p.n::DOUBLE * t.n_baskets / (x.n::DOUBLE * y.n)), 6) AS pmi"
        ),
    }
