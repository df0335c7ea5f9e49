"""Queries on reading lists, the matrix, history, documents and streams.

Articles stand for papers; a paper's list is that of its source, its decision and note follow from its year and volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.core.session import table
from litforge.functions import text as tx
from litforge.operators import documents, library, trends
from litforge.plans.paper_queries import _LABELS, _PART, _RANKED_ARTICLES, _WHO
from litforge.plans.registry import query
from litforge.streaming import runs

c = F.col

_DECISION = "CASE right(pub_year, 1) WHEN '1' THEN 'include' WHEN '2' THEN 'include' WHEN '3' THEN 'exclude' WHEN '4' THEN 'unsure' ELSE '' END"


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").withColumn("key", c("article_id")).withColumn("pos", c("article_id"))


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).select("key", F.expr(_DECISION).alias("decision")).where("decision <> ''")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = _papers(spark, sf).select("key", F.explode(F.array(F.struct(F.lit("design").alias("col_id"), c("volume").alias("value")), F.struct(F.lit("finding").alias("col_id"), c("issue").alias("value")))).alias("x"))
    return cells.select("key", "x.*").where("value <> ''")


def _saved(spark: SparkSession, sf: str, name: str = "customer") -> DataFrame:
    """Nations as lists, customers as what they hold."""
    return table(spark, sf, name).select(c("c_nationkey").cast("bigint").alias("list_id"), c("c_custkey").cast("bigint").alias("key"), c("c_custkey").cast("bigint").alias("pos"), c("c_mktsegment").alias("note"), c("c_acctbal").alias("added_at"))


@query("SELECT n_nationkey::BIGINT AS list_id, n_name AS name, count(c_custkey) AS papers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def list_counts(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("list_id"), c("n_name").alias("name"))
    return library.list_counts(lists, _saved(spark, sf))


_KEYS = "(SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0)"


@query(f"SELECT c_nationkey::BIGINT AS list_id, c_custkey::BIGINT AS key FROM customer UNION SELECT 2, c_custkey FROM customer WHERE c_nationkey = 1 AND c_custkey IN {_KEYS}")
def list_copy(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").where("c_acctbal < 0").select(c("c_custkey").cast("bigint").alias("key"))
    return library.copied(_saved(spark, sf), 1, 2, keys).select("list_id", "key")


@query(f"SELECT CASE WHEN c_nationkey = 1 AND c_custkey IN {_KEYS} THEN 2 ELSE c_nationkey END::BIGINT AS list_id, c_custkey::BIGINT AS key FROM customer")
def list_move(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").where("c_acctbal < 0").select(c("c_custkey").cast("bigint").alias("key"))
    return library.copied(_saved(spark, sf), 1, 2, keys, move=True).select("list_id", "key")


@query("""(SELECT c_nationkey::BIGINT AS list_id, c_custkey::BIGINT AS key FROM customer WHERE NOT (c_nationkey = 3 AND c_acctbal < 0)) UNION ALL SELECT 3, c_custkey FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 3""")
def list_toggle(spark: SparkSession, sf: str) -> DataFrame:
    papers = _saved(spark, sf).where("added_at < 0").withColumn("list_id", F.lit(3).cast("bigint")).drop("pos")
    return library.toggled(_saved(spark, sf), papers).select("list_id", "key")


@query("SELECT c_nationkey::BIGINT AS list_id, c_custkey::BIGINT AS key, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_mktsegment END AS note FROM customer")
def list_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes = _saved(spark, sf).where("added_at < 0").select("list_id", "key", F.lit("in debt").alias("note"))
    return library.noted(_saved(spark, sf), notes).select("list_id", "key", "note")


@query("""SELECT n_nationkey::BIGINT AS pos, n_regionkey::BIGINT AS region, CASE WHEN place > 1 THEN r_name || ' (' || place || ')' ELSE r_name END AS name FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS place FROM nation JOIN region ON r_regionkey = n_regionkey)""")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("pos"), c("n_regionkey").alias("region"), c("r_name").alias("name"))
    return library.unique_names(rows)


@query(r"""SELECT pos, label, CASE WHEN place > 1 THEN slug || '-' || place ELSE slug END AS col_id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS place FROM (SELECT p_partkey::BIGINT AS pos, p_brand AS label,
coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'column') AS slug FROM part))""")
def column_ids(spark: SparkSession, sf: str) -> DataFrame:
    return library.column_ids(table(spark, sf, "part").select(c("p_partkey").alias("pos"), c("p_brand").alias("label")))


@query("SELECT article_id FROM articles WHERE contains(lower(title || ' ' || array_to_string(authors, ' ') || ' ' || pub_year || ' ' || journal), 'trial')")
def list_search(spark: SparkSession, sf: str) -> DataFrame:
    return library.text_filter(table(spark, sf, "articles"), " Trial ").select("article_id")


@query("""SELECT event_type || '|' || user_id AS state, max(ts) AS date FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def history_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.concat_ws("|", "event_type", c("user_id").cast("string")).alias("state"), c("ts").alias("date"))
    return library.recorded(rows.where("date < '2024-01-10'"), rows.where("date >= '2024-01-10'"))


@query("SELECT DISTINCT user_id::BIGINT AS pmid FROM events WHERE ts >= '2024-01-20' AND event_type = 'error' EXCEPT SELECT user_id FROM events WHERE ts < '2024-01-20' AND event_type = 'error'")
def history_new(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type = 'error'").withColumn("pmid", c("user_id"))
    return library.new_since(rows.where("ts >= '2024-01-20'"), rows.where("ts < '2024-01-20'")).select("pmid").distinct()


@query("SELECT article_id, EXISTS (SELECT 1 FROM openalex_works w WHERE lower(regexp_replace(w.doi, '^https?://(dx\\.)?doi\\.org/', '')) = lower(a.doi)) AS saved FROM articles a")
def is_saved(spark: SparkSession, sf: str) -> DataFrame:
    papers = table(spark, sf, "articles").select("article_id", F.lower("doi").alias("key"))
    saved = table(spark, sf, "openalex_works").select(F.lower(F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "")).alias("key")).where(c("key").isNotNull()).distinct()
    return papers.join(saved.withColumn("hit", F.lit(True)), "key", "left").select("article_id", F.coalesce("hit", F.lit(False)).alias("saved"))


# ---------------------------------------------------------------- matrix


@query(f"SELECT count_if(d = 'include')::BIGINT AS include, count_if(d = 'unsure')::BIGINT AS unsure, count_if(d = '')::BIGINT AS undecided, count_if(d = 'exclude')::BIGINT AS exclude FROM (SELECT {_DECISION} AS d FROM articles)")
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return library.decision_counts(_papers(spark, sf), _decisions(spark, sf))


@query(f"""SELECT article_id, CASE d WHEN 'include' THEN 1 WHEN 'unsure' THEN 2 WHEN '' THEN 3 ELSE 4 END::BIGINT AS by_decision, coalesce(try_cast(trim(pub_year) AS INT), 9999)::BIGINT AS by_year, rank AS by_evidence FROM (SELECT *, {_DECISION} AS d FROM {_RANKED_ARTICLES})""")
def matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    papers, decisions = _papers(spark, sf), _decisions(spark, sf)
    keys = [library.matrix_rows(papers, decisions, sort).select("key", c("order1").alias(name)) for sort, name in (("decision", "by_decision"), ("year-asc", "by_year"), ("evidence", "by_evidence"))]
    return keys[0].join(keys[1], "key").join(keys[2], "key").withColumnRenamed("key", "article_id")


@query(f"SELECT article_id FROM articles WHERE {_DECISION} = ''")
def matrix_undecided(spark: SparkSession, sf: str) -> DataFrame:
    return library.matrix_rows(_papers(spark, sf), _decisions(spark, sf), keep="none").select("article_id")


@query(f"""SELECT article_id AS pos, {_PART} || ', ' || CASE WHEN pub_year <> '' THEN pub_year ELSE 'n.d.' END AS "Study", regexp_replace(title, '\\.$', '') AS "Title", journal AS "Journal", pub_year AS "Year", pmid AS "PMID", coalesce(doi, '') AS "DOI", {_LABELS} AS "Evidence level",
CASE {_DECISION} WHEN 'include' THEN 'Include' WHEN 'unsure' THEN 'Unsure' WHEN '' THEN 'Undecided' ELSE 'Exclude' END AS "Decision", volume AS "Study design", issue AS "Key finding" FROM (SELECT w.*, rank FROM {_WHO} w JOIN (SELECT article_id, rank FROM {_RANKED_ARTICLES}) USING (article_id))""")
def matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return library.matrix_table(_papers(spark, sf), _cells(spark, sf), _decisions(spark, sf), [("design", "Study design"), ("finding", "Key finding")])


@query()
def matrix_csv(spark: SparkSession, sf: str) -> DataFrame:
    return library.matrix_lines(library.matrix_table(_papers(spark, sf), _cells(spark, sf), _decisions(spark, sf), [("design", "Study design"), ("finding", "Key finding")]))


@query("""WITH x AS (SELECT article_id AS key, 'design' AS col_id, volume AS value, 'guess' AS s FROM articles UNION ALL SELECT article_id, 'size', NULL, 'guess' FROM articles)
SELECT key, col_id, CASE WHEN coalesce(trim(value), '') = '' THEN s ELSE value END AS value, coalesce(trim(value), '') = '' AS filled FROM x""")
def filled_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions go into blank cells of columns that exist."""
    papers = _papers(spark, sf)
    guess = papers.select("key", F.explode(F.array(*[F.lit(x) for x in ("design", "size", "gone")])).alias("col_id"), F.lit("guess").alias("value"))
    columns = spark.createDataFrame([("design",), ("size",)], "col_id string")
    return library.with_suggestions(papers.select("key", F.lit("design").alias("col_id"), c("volume").alias("value")), guess, columns)


@query()
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return library.suggestions(_papers(spark, sf))


_ROWS = f"(SELECT r.*, CASE WHEN trim(volume) <> '' THEN trim(volume) ELSE 'Not stated' END AS design, coalesce(nullif({_DECISION}, ''), 'undecided') AS d, try_cast(trim(pub_year) AS INT) AS y FROM {_RANKED_ARTICLES} r)"


@query(f"""SELECT 'decisions' AS "group", d AS label, count(*) AS papers FROM {_ROWS} GROUP BY 2 UNION ALL SELECT 'evidence', {_LABELS}, count(*) FROM {_ROWS} GROUP BY rank
UNION ALL SELECT 'totals', 'total', count(*) FROM articles UNION ALL SELECT 'totals', 'with_abstract', count_if(trim(abstract) <> '')::BIGINT FROM articles UNION ALL SELECT 'totals', 'retracted', count_if(retracted)::BIGINT FROM articles
UNION ALL SELECT 'totals', 'with_notes', count_if(trim(issue) <> '')::BIGINT FROM articles UNION ALL SELECT 'totals', 'median_year', (list_sort(list(y))[(count(*) // 2)::INT + 1])::BIGINT FROM {_ROWS} WHERE y > 1800
UNION ALL (SELECT 'journals', journal, count(*) FROM articles WHERE journal <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)""")
def overview_tall(spark: SparkSession, sf: str) -> DataFrame:
    papers = _papers(spark, sf)
    out = trends.overview(papers, papers.select("key", F.lit("").alias("design")), _decisions(spark, sf), papers.select("key", c("issue").alias("note")))
    return out.where("`group` IN ('decisions', 'evidence', 'journals') OR label IN ('total', 'with_abstract', 'retracted', 'with_notes', 'median_year')").select("group", "label", "papers")


@query()
def overview_export(spark: SparkSession, sf: str) -> DataFrame:
    papers = _papers(spark, sf)
    return trends.overview_lines(trends.overview(papers, papers.select("key", F.lit("").alias("design")), _decisions(spark, sf), papers.select("key", c("issue").alias("note"))))


# ---------------------------------------------------------------- documents and kept rows


@query("SELECT o_custkey::BIGINT AS o_custkey, max(o_orderkey)::BIGINT AS o_orderkey FROM orders GROUP BY 1")
def kept_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return library.upserted(rows.where("o_orderkey < 100"), rows.where("o_orderkey >= 100"), ["o_custkey"], "o_orderkey")


@query("SELECT l_partkey::BIGINT AS key, count(*) AS cites, p_partkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1, 3")
def cited_records(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("key")).agg(F.count("*").alias("cites"))
    return library.cited_records(cited, table(spark, sf, "part").where("p_size > 10").select(c("p_partkey").alias("key"))).select("key", "cites", "missing")


_MARKDOWN = r"regexp_replace({0}, '([\\*_`])', '\\\1', 'g')"


@query(f"""SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+'), lambda w: w <> ''))::BIGINT AS n_words, '# ' || {_MARKDOWN.format("source")} || chr(10) || chr(10) || {_MARKDOWN.format("text")} || chr(10) AS rendered
FROM documents WHERE text <> '' AND trim(source) <> ''""")
def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.render_table(_documents(spark, sf), "markdown")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a document of one paragraph."""
    node = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    tree = node(type=F.lit("doc"), content=F.array(node(type=F.lit("paragraph"), content=F.array(node(type=F.lit("text"), text=c("text"))))))
    refs = F.expr("cast(array() as array<struct<key:string,name:string,label:string,reference:string>>)")
    return table(spark, sf, "documents").where("text <> '' AND trim(source) <> ''").select(c("doc_id").alias("id"), c("source").alias("title"), F.to_json(tree).alias("json"), F.lit("vancouver").alias("style"), refs.alias("refs"))


@query()
def latex_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.render_table(_documents(spark, sf), "latex")


@query()
def html_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.render_table(_documents(spark, sf), "html")


# ---------------------------------------------------------------- streams (the same functions on tables)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id::BIGINT AS user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return runs.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")


@query("SELECT DISTINCT pmid FROM articles WHERE pmid <> ''")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return runs.first_seen(table(spark, sf, "articles").where("pmid <> ''")).select("pmid")
