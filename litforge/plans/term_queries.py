"""Queries on the terms found in papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.core.session import spread, table
from litforge.functions import text as tx
from litforge.operators import spans, terms
from litforge.plans.registry import query

c = F.col

NORMAL = r"regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
_ROWS = f"(SELECT * FROM (SELECT article_id, pos, entity_id, category, text, {NORMAL.format('text')} AS term_key FROM entities WHERE NOT coalesce(negated, false) AND text IS NOT NULL) WHERE length(term_key) >= 2)"
_TALLY = f"""(SELECT category, term_key, any_value(display) AS display, count(DISTINCT article_id) AS docs, count(*) AS mentions FROM {_ROWS} r JOIN
(SELECT category, term_key, text AS display FROM (SELECT *, row_number() OVER (PARTITION BY category, term_key ORDER BY regexp_full_match(text, '[A-Z0-9-]{{2,10}}s?'), n DESC, a, p, e) AS place FROM
(SELECT category, term_key, text, count(*) AS n, (min({{a: article_id, b: pos, c: entity_id}})).a AS a, (min({{a: article_id, b: pos, c: entity_id}})).b AS p, (min({{a: article_id, b: pos, c: entity_id}})).c AS e FROM {_ROWS} GROUP BY 1, 2, 3)) WHERE place = 1) d USING (category, term_key) GROUP BY 1, 2)"""


def _tally(spark: SparkSession, sf: str) -> DataFrame:
    return terms.tally(table(spark, sf, "entities"))


@query(f"SELECT * FROM {_TALLY}")
def term_tally(spark: SparkSession, sf: str) -> DataFrame:
    return _tally(spark, sf)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY docs DESC, mentions DESC, term_key) AS place FROM {_TALLY}) WHERE place <= 12")
def term_topk(spark: SparkSession, sf: str) -> DataFrame:
    return terms.top_terms(_tally(spark, sf))


_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.CATEGORIES) + " END"


@query(f"SELECT {_LABEL} AS category, {NORMAL.format('display')} AS term, docs AS papers, mentions, printf('%.3f', docs / n) AS share FROM {_TALLY}, (SELECT count(*) AS n FROM articles)")
def term_shares(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "articles").agg(F.count("*").alias("n"))
    return terms.terms_csv(_tally(spark, sf).crossJoin(F.broadcast(total)), c("n"))  # one row


@query(f"""WITH t AS {_TALLY}, k AS (SELECT category, term_key FROM t ORDER BY docs DESC, mentions DESC, category, term_key LIMIT 20)
SELECT category, term_key, count(DISTINCT article_id) AS papers, sum(DISTINCT article_id)::DOUBLE AS ids FROM {_ROWS} JOIN k USING (category, term_key) GROUP BY 1, 2""")
def term_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The papers of the 20 commonest terms."""
    first = _tally(spark, sf).orderBy(F.desc("docs"), F.desc("mentions"), "category", "term_key").limit(20)
    papers = terms.term_documents(table(spark, sf, "entities")).join(F.broadcast(first.select("category", "term_key")), ["category", "term_key"])  # 20 rows
    return papers.groupBy("category", "term_key").agg(F.count("*").alias("papers"), F.sum("doc").cast("double").alias("ids"))


def _commonest(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Category and key of the term with most papers; one row reaches the driver."""
    row = _tally(spark, sf).orderBy(F.desc("docs"), F.desc("mentions"), "category", "term_key").select("category", "term_key").first()
    return (row[0], row[1]) if row else ("", "")


@query(f"""WITH d AS (SELECT DISTINCT category, term_key, article_id FROM {_ROWS}), k AS (SELECT category, term_key FROM {_TALLY} ORDER BY docs DESC, mentions DESC, category, term_key LIMIT 1),
h AS (SELECT article_id FROM d JOIN k USING (category, term_key))
SELECT category, term_key, count(h.article_id) AS shared, count(*) AS docs FROM d LEFT JOIN h USING (article_id) WHERE (category, term_key) NOT IN (SELECT (category, term_key) FROM k) GROUP BY 1, 2 HAVING count(h.article_id) > 0 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 8""")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return terms.cooccurring(table(spark, sf, "entities"), *_commonest(spark, sf))


@query(f"""WITH k AS (SELECT category, term_key FROM {_TALLY} ORDER BY docs DESC, mentions DESC, category, term_key LIMIT 1)
SELECT article_id, title FROM articles WHERE article_id IN (SELECT article_id FROM {_ROWS} JOIN k USING (category, term_key))""")
def papers_with_term(spark: SparkSession, sf: str) -> DataFrame:
    return terms.papers_with_term(table(spark, sf, "articles"), table(spark, sf, "entities"), *_commonest(spark, sf)).select("article_id", "title")


@query(f"""SELECT category, term_key, count(*) AS n, bool_and(negated) AS negated, first(text ORDER BY article_id, pos, entity_id) AS display FROM (SELECT *, {NORMAL.format('text')} AS term_key FROM (SELECT * REPLACE (coalesce(negated, false) AS negated) FROM entities WHERE text IS NOT NULL)) GROUP BY 1, 2""")
def term_groups_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.group_terms(table(spark, sf, "entities")).select("category", "term_key", "n", "negated", "display")


@query(f"SELECT DISTINCT category, {_LABEL} AS label FROM entities WHERE {_LABEL} IS NOT NULL")
def categories_present(spark: SparkSession, sf: str) -> DataFrame:
    return terms.present_categories(table(spark, sf, "entities")).select("category", "label")


@query(r"""SELECT DISTINCT label, CASE WHEN regexp_matches(l, 'FINDING|SIGN|SYMPTOM') THEN 'finding' WHEN regexp_matches(l, 'DISEASE|CONDITION|PATHOLOGY|CANCER') THEN 'condition' WHEN regexp_matches(l, 'CHEM|DRUG') THEN 'drug'
WHEN regexp_matches(l, 'GENE|PROTEIN|DNA|RNA') THEN 'gene' WHEN contains(replace(l, 'ORGANISM', ''), 'ORGAN') OR regexp_matches(l, 'TISSUE|ANATOMY') THEN 'anatomy' WHEN regexp_matches(l, 'ORGANISM|SPECIES') THEN 'organism' WHEN contains(l, 'CELL') THEN 'cell' ELSE 'other' END AS category
FROM (SELECT label, upper(label) AS l FROM (SELECT label FROM entities UNION ALL SELECT unnest(['ORGAN', 'ORGANISM', 'SIMPLE_CHEMICAL', 'GENE_OR_GENE_PRODUCT', 'CANCER', 'CELL', 'x'])) WHERE label IS NOT NULL)""")
def label_categories(spark: SparkSession, sf: str) -> DataFrame:
    more = spark.createDataFrame([(x,) for x in ("ORGAN", "ORGANISM", "SIMPLE_CHEMICAL", "GENE_OR_GENE_PRODUCT", "CANCER", "CELL", "x")], "label string")
    labels = table(spark, sf, "entities").select("label").union(more).where(c("label").isNotNull()).distinct()
    return labels.select("label", tx.category_for(c("label")).alias("category"))


_LAST = r"regexp_extract(k, '(\p{L}+)$', 1)"
_KEPT = rf"(regexp_matches(lower({_LAST}), '(ss|us|is|as|os|ys|es)$') OR length({_LAST}) <= 4)"


@query(rf"""SELECT DISTINCT text, k AS normal, CASE WHEN {_LAST} = '' THEN k WHEN {_KEPT} AND lower({_LAST}) LIKE '%ies' AND length({_LAST}) > 5 THEN left(k, length(k) - 3) || 'y' WHEN {_KEPT} AND regexp_matches(lower({_LAST}), '(ches|shes|xes)$') THEN left(k, length(k) - 2)
WHEN NOT {_KEPT} AND lower({_LAST}) LIKE '%s' THEN left(k, length(k) - 1) ELSE k END AS singular FROM (SELECT text, {NORMAL.format('text')} AS k FROM entities WHERE text IS NOT NULL)""")
def normal_terms(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "entities").select("text").where(c("text").isNotNull()).distinct()
    return texts.select("text", tx.normalize_term(c("text")).alias("normal"), tx.singularize(tx.normalize_term(c("text"))).alias("singular"))


_INITIALS = "array_to_string(list_transform(regexp_split_to_array(preferred, ' '), lambda w: upper(left(w, 1))), '')"


@query(f"""WITH d AS (SELECT lower(s) AS short, lower(preferred) AS long, count(*) AS n, min(term_id) AS first FROM (SELECT term_id, preferred, unnest(synonyms) AS s FROM canonical_terms)
WHERE s = {_INITIALS} AND length(s) BETWEEN 3 AND 10 AND NOT contains(preferred, '-') GROUP BY 1, 2) SELECT short, first(long ORDER BY n DESC, first, long) AS long FROM d GROUP BY 1""")
def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions read from sentences made of the reference list's terms and their initials."""
    rows = table(spark, sf, "canonical_terms").select("term_id", "preferred", F.explode("synonyms").alias("s"))
    initials = F.array_join(F.transform(F.split("preferred", " "), lambda w: F.upper(F.left(w, F.lit(1)))), "")
    defined = rows.where((c("s") == initials) & F.length("s").between(3, 10) & ~c("preferred").contains("-"))
    texts = defined.select("term_id", F.concat(F.lit("We saw adults: "), "preferred", F.lit(" ("), "s", F.lit(").")).alias("text"))
    return terms.abbreviation_map(terms.find_abbreviations(texts, "term_id", "text"), {})


@query()
def canonical_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Terms counted under their long forms, as the abbreviations of the reference list give them."""
    rows = table(spark, sf, "canonical_terms").select("term_id", "preferred", F.explode("synonyms").alias("s")).where(c("s").rlike("^[A-Z0-9-]{2,10}$"))
    definitions = rows.select(c("term_id").alias("doc"), tx.normalize_term(c("s")).alias("short"), tx.normalize_term(c("preferred")).alias("long"))
    return terms.tally(terms.with_canonical(table(spark, sf, "entities"), terms.abbreviation_map(definitions)), c("canonical"))


# Endings of names of conditions and of substances, and the labels of what has them.
ENDINGS = {"DISEASE": "algia emia itis opathy osis oxia oemia".split(), "CHEM": "dexan mab ostat quil rin tramil vastat vex var vir".split()}
#: Words that the vocabulary tagger knows at most: its dictionary is in every task.
MOST_WORDS = 2000


def vocabulary(docs: DataFrame, text: str = "text", most: int = MOST_WORDS) -> dict[str, str]:
    """The commonest long words of the texts that end like conditions and substances, with their labels; counted over all texts."""
    ends = {label: "|".join(x) for label, x in ENDINGS.items()}
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{9,}\b"), 0)).alias("w")).where(c("w").rlike(f"(?:{'|'.join(ends.values())})$"))
    label = F.coalesce(*[F.when(c("w").rlike(f"(?:{e})$"), k) for k, e in ends.items()])
    found = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w", label.alias("label")).collect()
    return {r["w"]: r["label"] for r in found}


def tagged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of all documents by a vocabulary tagger and the rules for signs and symptoms."""
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(spread(table(spark, sf, "documents")))  # tagging is CPU work, which bytes don't show
    return spans.tag(docs, [spans.TermTagger(vocabulary(docs))], "doc_id", rules=[spans.rule_findings()])


@query()
def tagged_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to entities to the twelve commonest terms of each category: the flagship path."""
    return terms.top_terms(terms.tally(tagged_documents(spark, sf), doc="doc_id", seen=["doc_id", "pos"]))


@query("SELECT DISTINCT article_id FROM entities WHERE NOT coalesce(negated, false) EXCEPT SELECT article_id FROM entities WHERE negated")
def never_denied(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with mentions none of which is denied."""
    rows = table(spark, sf, "entities")
    return rows.where(~F.coalesce("negated", F.lit(False))).select("article_id").distinct().join(rows.where("negated").select("article_id"), "article_id", "left_anti")
