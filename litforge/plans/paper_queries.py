"""Queries on papers: text functions, evidence, trends, citations and records of other catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.core.session import table
from litforge.functions import text as tx
from litforge.operators import citations, effects, search, spans, trends
from litforge.plans.registry import query
from litforge.sources import records

c = F.col

# ---------------------------------------------------------------- evidence and trends

_RANK = "CASE " + " ".join(f"WHEN lower(trim(t)) IN ({', '.join(repr(x) for x in types)}) THEN {rank}" for rank, _, _, types in tx.LEVELS if types) + " ELSE 9 END"
_RANKS = f"(SELECT article_id, coalesce(min({_RANK}), 9)::BIGINT AS rank FROM (SELECT article_id, unnest(pub_types) AS t FROM articles) GROUP BY 1)"
_LABELS = "CASE rank " + " ".join(f"WHEN {rank} THEN '{label}'" for rank, _, label, _ in tx.LEVELS) + " END"
_RANKED_ARTICLES = f"(SELECT a.*, coalesce(r.rank, 9) AS rank FROM articles a LEFT JOIN {_RANKS} r USING (article_id))"


@query(f"SELECT article_id, rank, {_LABELS} AS label FROM {_RANKED_ARTICLES}")
def evidence_level(spark: SparkSession, sf: str) -> DataFrame:
    rank = tx.evidence_rank(c("pub_types"))
    return table(spark, sf, "articles").select("article_id", rank.alias("rank"), tx.level_name(rank, 2).alias("label"))


@query(f"SELECT rank, {_LABELS} AS label, count(*) AS papers FROM {_RANKED_ARTICLES} GROUP BY rank")
def evidence_mix(spark: SparkSession, sf: str) -> DataFrame:
    return trends.evidence_mix(table(spark, sf, "articles"))


@query(f"""SELECT article_id, row_number() OVER (PARTITION BY journal ORDER BY rank, article_id) AS by_evidence,
row_number() OVER (PARTITION BY journal ORDER BY coalesce(try_cast(trim(pub_year) AS INT), 0) DESC, article_id) AS by_year FROM {_RANKED_ARTICLES}""")
def evidence_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of results within each journal."""
    papers = table(spark, sf, "articles").withColumn("rank", c("article_id"))
    place = lambda order: F.row_number().over(Window.partitionBy("journal").orderBy(*trends.order_keys(order)))
    return papers.select("article_id", place("evidence").alias("by_evidence"), place("newest").alias("by_year"))


@query("""SELECT article_id, row_number() OVER (PARTITION BY journal ORDER BY coalesce(p_size, -1) DESC, article_id) AS by_citations FROM articles LEFT JOIN part ON p_partkey = article_id""")
def citations_order(spark: SparkSession, sf: str) -> DataFrame:
    """Most cited first within each journal; papers without counts come last."""
    metrics = table(spark, sf, "part").select(c("p_partkey").alias("article_id"), c("p_size").alias("citations"))
    papers = table(spark, sf, "articles").withColumn("rank", c("article_id")).join(metrics, "article_id", "left")
    return papers.select("article_id", F.row_number().over(Window.partitionBy("journal").orderBy(*trends.order_keys("citations"))).alias("by_citations"))


@query("""WITH y AS (SELECT try_cast(trim(pub_year) AS INT) AS year, count(*) AS papers FROM articles WHERE try_cast(trim(pub_year) AS INT) > 1800 GROUP BY 1)
SELECT r.year::BIGINT AS year, coalesce(papers, 0) AS papers FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) r LEFT JOIN y ON y.year = r.year""")
def year_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trends.year_counts(table(spark, sf, "articles"))


@query("""SELECT r.year::BIGINT AS year, count(article_id) AS papers FROM (SELECT unnest(range(2001, 2026)) AS year) r LEFT JOIN articles ON try_cast(trim(pub_year) AS INT) = r.year GROUP BY 1""")
def year_trend(spark: SparkSession, sf: str) -> DataFrame:
    return trends.counts_by_year(table(spark, sf, "articles"), 2025)


@query("SELECT journal AS label, count(*) AS papers FROM articles WHERE journal <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_journals(spark: SparkSession, sf: str) -> DataFrame:
    return trends.tally(table(spark, sf, "articles"), "journal")


@query("SELECT t AS label, count(*) AS papers FROM (SELECT unnest(pub_types) AS t FROM articles) WHERE t <> '' GROUP BY 1")
def publication_types(spark: SparkSession, sf: str) -> DataFrame:
    return trends.tally(table(spark, sf, "articles").select(F.explode("pub_types").alias("t")), "t", None)


@query("SELECT article_id, len(list_filter(pub_types, lambda t: lower(t) = 'preprint')) > 0 AS preprint FROM articles")
def preprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.is_preprint(c("pub_types")).alias("preprint"))


# ---------------------------------------------------------------- text functions

_TEXT = "(coalesce(title, '') || chr(10) || coalesce(abstract, ''))"


@query(f"SELECT article_id, md5({_TEXT}) AS hash, length({_TEXT}) AS n FROM articles")
def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", F.md5(tx.article_text()).alias("hash"), F.length(tx.article_text()).alias("n"))


@query("""SELECT article_id, CASE WHEN pmid <> '' THEN pmid WHEN doi <> '' THEN 'doi:' || lower(doi) WHEN source_id <> '' THEN source_id
ELSE 'title:' || left(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), 80) END AS key FROM articles""")
def article_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.article_key().alias("key"))


_T = f"lower({_TEXT})"
_HAS = lambda t: f"list_contains(list_transform(pub_types, lambda t: lower(t)), '{t}')"
_TIMED = r"regexp_extract(t, '\b(?:prospective|retrospective)\b[^.]{0,40}\bcohort\b|\b(?:prospective|retrospective)\s+(?:observational\s+)?(?:study|analysis)\b')"


@query(rf"""SELECT article_id, CASE WHEN {_HAS("meta-analysis")} OR contains(lower(title), 'meta-analy') OR contains(lower(title), 'metaanaly') THEN 'Meta-analysis'
WHEN {_HAS("systematic review")} OR contains(lower(title), 'systematic review') THEN 'Systematic review'
WHEN {_HAS("randomized controlled trial")} OR regexp_matches(t, 'randomi[sz]ed (controlled|clinical) trial|double-blind|randomly assigned') THEN 'Randomized controlled trial'
WHEN regexp_matches(t, 'case[- ]control') THEN 'Case-control study' WHEN regexp_matches(t, 'cross[- ]sectional') THEN 'Cross-sectional study'
WHEN {_TIMED} <> '' THEN CASE WHEN {_TIMED} LIKE 'pro%' THEN 'Prospective' ELSE 'Retrospective' END || CASE WHEN contains({_TIMED}, 'cohort') THEN ' cohort study' ELSE ' study' END
WHEN regexp_matches(t, '\bcohort\b') THEN 'Cohort study' WHEN {_HAS("case reports")} OR regexp_matches(t, '\bwe (report|describe|present) a (case|patient)\b') THEN 'Case report'
WHEN contains(t, 'case series') THEN 'Case series' WHEN {_HAS("practice guideline")} OR {_HAS("guideline")} THEN 'Guideline'
WHEN {_HAS("clinical trial")} OR {_HAS("controlled clinical trial")} OR contains(t, 'clinical trial') THEN 'Clinical trial'
WHEN {_HAS("observational study")} THEN 'Observational study' WHEN {_HAS("review")} THEN 'Narrative review' ELSE '' END AS design
FROM (SELECT *, {_T} AS t FROM articles)""")
def study_designs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.study_design().alias("design"))


_PEOPLE = r"'(?i)\b(\d[\d,]{1,9})\s+(?:(?:consecutive|eligible|adult|pa?ediatric|hospitali[sz]ed|randomi[sz]ed|enrolled|critically\s+ill|older)\s+){0,2}(patients|participants|subjects|adults|children|women|men|individuals|cases|people|infants|neonates|veterans|volunteers|mothers|adolescents)\b'"
_STUDIES = r"'(?i)\b(\d{1,4})\s+(?:randomi[sz]ed\s+)?(studies|trials|articles|reports|cohorts)\b'"


@query(rf"""WITH x AS (SELECT article_id, pub_types, regexp_extract(t, '\b[nN]\s*=\s*(\d[\d,]*)', 1) AS n, regexp_extract(t, {_PEOPLE}, 1) AS p, lower(regexp_extract(t, {_PEOPLE}, 2)) AS pw,
regexp_extract(t, {_STUDIES}, 1) AS s, lower(regexp_extract(t, {_STUDIES}, 2)) AS sw FROM (SELECT *, {_TEXT} AS t FROM articles)),
y AS (SELECT article_id, CASE WHEN n <> '' THEN 'n = ' || n WHEN p <> '' AND NOT regexp_full_match(p, '(19|20)\d\d') THEN p || ' ' || pw WHEN s <> '' THEN s || ' ' || sw
WHEN len(list_filter(pub_types, lambda t: lower(t) = 'case reports')) > 0 THEN '1 patient' ELSE '' END AS size FROM x)
SELECT article_id, size, CASE WHEN size <> '' AND NOT regexp_matches(size, 'studies|trials|articles|reports|cohorts') THEN try_cast(replace(regexp_extract(size, '\d[\d,]*'), ',', '') AS BIGINT) END AS people FROM y""")
def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.sample_size().alias("size"), tx.participants(tx.sample_size()).alias("people"))


# an independent way to the same estimates: one expression for each part of the grammar, without look-around
_CI = r"(?:95\s*%?\s*(?i:CI|confidence interval|confidence limits)|(?i:CI))"
_OPENER = rf"\s*(?:[(\[]\s*(?:{_CI}\s*[:=,]?\s*)?|[,;]\s*{_CI}\s*[:=,]?\s*)"
_RATIO = rf"(?:^|[^A-Za-z])((?i:odds ratio|hazard ratio|risk ratio|relative risk|rate ratio)|aOR|OR|aHR|HR|aRR|IRR|RR)\b[^.\d−–-]{{0,35}}?(?:[=:]\s*)?(\d+(?:\.\d+)?){_OPENER}(\d+(?:\.\d+)?)\s*(?:-|–|—|to|,|;)\s*(\d+(?:\.\d+)?)"


def _part(i: int) -> str:
    return f"regexp_extract_all(t, '{_RATIO}', {i})"


@query(f"""WITH t AS (SELECT article_id, regexp_replace(title || '. ' || abstract, '\\s+', ' ', 'g') AS t FROM articles),
m AS (SELECT article_id, unnest({_part(1)}) AS name, unnest({_part(2)})::DOUBLE AS est, unnest({_part(3)})::DOUBLE AS lo, unnest({_part(4)})::DOUBLE AS hi FROM t)
SELECT DISTINCT article_id, CASE WHEN lower(name) IN ('or', 'aor', 'odds ratio') THEN 'OR' WHEN lower(name) IN ('hr', 'ahr', 'hazard ratio') THEN 'HR' ELSE 'RR' END AS kind, est, lo, hi FROM m
WHERE lo <= est AND est <= hi AND lo > 0 AND hi / lo < 1000""")
def effect_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios that abstracts report."""
    found = effects.extract_effects(table(spark, sf, "articles"), "article_id", F.concat("title", F.lit(". "), "abstract"))
    return found.where("scale = 'ratio'").select("article_id", "kind", "est", "lo", "hi")


_DIFF = "'Pain fell (mean difference ' || round(-l_tax - 1, 2) || ', 95% CI ' || round(-l_tax - 1 - l_discount - 0.5, 2) || ' to ' || round(l_discount - l_tax - 0.5, 2) || '). The odds ratio was ' || l_quantity || ' (95% CI ' || l_quantity / 2 || ' to ' || l_quantity * 2 || ').'"


_LINE_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_discount)"


@query(f"""SELECT DISTINCT {_LINE_KEY} AS line, 'MD' AS kind, 'difference' AS scale, round(-l_tax - 1, 2) AS est, round(-l_tax - 1 - l_discount - 0.5, 2) AS lo, round(l_discount - l_tax - 0.5, 2) AS hi FROM lineitem""")
def primary_effect(spark: SparkSession, sf: str) -> DataFrame:
    """The first difference of a text that reports a difference and a ratio."""
    lines = table(spark, sf, "lineitem").select(F.expr(_LINE_KEY).alias("line"), F.expr(_DIFF).alias("t"))
    return effects.primary_effect(effects.extract_effects(lines, "line", c("t")), "line", "difference").select("line", "kind", "scale", "est", "lo", "hi")


@query()
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spans.chunk_table(table(spark, sf, "documents")).withColumn("n", F.length("chunk")).drop("chunk")


_DOI = r"rtrim(regexp_extract(lower(x), '\b(10\.\d{4,9}/[^\s\"<>]+)', 1), '.,;)]')"


@query(rf"""SELECT article_id, x, CASE WHEN {_DOI} <> '' THEN 'doi' WHEN p <> '' THEN 'pmid' END AS kind, CASE WHEN {_DOI} <> '' THEN {_DOI} WHEN p <> '' THEN p END AS value FROM (SELECT *,
coalesce(nullif(regexp_extract(trim(x), '^(?i:pmid):?\s*(\d{{1,9}})$', 1), ''), nullif(regexp_extract(trim(x), '^(\d{{4,9}})$', 1), ''), nullif(regexp_extract(x, 'pubmed\.ncbi\.nlm\.nih\.gov/(\d{{1,9}})', 1), ''), '') AS p
FROM (SELECT article_id, unnest([coalesce(doi, ''), 'PMID: ' || pmid, pmid, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/']) AS x FROM articles))""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    pmid = c("pmid")
    texts = F.array(F.coalesce("doi", F.lit("")), F.concat(F.lit("PMID: "), pmid), pmid, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))
    rows = table(spark, sf, "articles").select("article_id", F.explode(texts).alias("x"))
    return rows.withColumn("i", tx.identifier(c("x"))).select("article_id", "x", "i.kind", "i.value")


_HINT = r"regexp_matches(title, '[ăâîșțşţĂÂÎȘȚŞŢ]') OR regexp_matches(lower(title), '(^|[^\p{L}])(și|si|cu|pentru|în|fără|fara|sau|de|la|al|ale|din)([^\p{L}]|$)')"


@query(f"SELECT article_id, {_HINT} AS hint FROM articles")
def language_hint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.looks_romanian(c("title")).alias("hint"))


@query()
def translated_titles(spark: SparkSession, sf: str) -> DataFrame:
    return search.translate_table(table(spark, sf, "articles"), "article_id", "title")


@query("""SELECT DISTINCT journal, coalesce(nullif(rtrim(left(regexp_replace(regexp_replace(lower(strip_accents(journal)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-'), ''), 'document') AS slug FROM articles""")
def file_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("journal", tx.file_slug(c("journal")).alias("slug")).distinct()


@query("""SELECT article_id, '<mark>' || left(title, 4) || '</mark>' || substr(title, 5) AS title, CASE WHEN length(abstract) >= 3 THEN '<mark>' || left(abstract, 3) || '</mark>' || substr(abstract, 4) ELSE abstract END AS abstract
FROM articles WHERE length(title) >= 4""")
def marked_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and abstracts with their first letters marked; a span over both is left out."""
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    size = F.length("title")
    found = F.array(span(F.lit(0), F.lit(4)), span(size - 1, size + 2), span(size + 1, size + 4), span(F.lit(2), F.lit(4)))
    return table(spark, sf, "articles").where(size >= 4).select("article_id", tx.marked_card(found).alias("m")).select("article_id", "m.*")


@query("""SELECT article_id, CASE WHEN len(authors) > 4 THEN array_to_string(authors[1:3], ', ') || ', … ' || authors[-1] ELSE array_to_string(authors, ', ') END AS shown FROM articles""")
def short_authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", tx.short_authors(c("authors")).alias("shown"))


@query("SELECT article_id, trim(list_extract(regexp_split_to_array(title || ', ' || journal, ','), -1)) AS phrase FROM articles WHERE NOT regexp_matches(title || journal, '\\s(AND|OR|NOT)\\s')")
def current_phrase(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "articles").where(~F.concat("title", "journal").rlike(r"\s(AND|OR|NOT)\s"))
    return rows.select("article_id", tx.current_phrase(F.concat("title", F.lit(", "), "journal")).alias("phrase"))


_SMALL = "replace(replace(format('{:.1e}', v), 'e-0', 'e-'), 'e+0', 'e+')"


@query(f"""WITH v AS (SELECT l_orderkey::BIGINT * 10 + l_linenumber AS line, unnest([l_extendedprice, 0 - l_discount / 20, l_tax]) AS v FROM lineitem)
SELECT line, v, CASE WHEN v <> 0 AND abs(v) < 0.01 THEN {_SMALL} ELSE rtrim(rtrim(format('{{:,.2f}}', round(v, 2)), '0'), '.') END AS shown,
CASE WHEN v < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', v) END AS p FROM v""", 8)
def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((c("l_orderkey").cast("bigint") * 10 + c("l_linenumber")).alias("line"), F.explode(F.array(c("l_extendedprice"), 0 - c("l_discount") / 20, c("l_tax"))).alias("v"))
    return rows.select("line", "v", tx.shown_number(c("v")).alias("shown"), tx.shown_p(c("v"), name=True).alias("p"))


# ---------------------------------------------------------------- search expressions

_FILTERS = """SELECT n_nationkey::BIGINT AS k, n_name AS base, CASE WHEN n_regionkey > 1 THEN 2000 + n_nationkey END AS from_year, CASE WHEN n_regionkey > 2 THEN 2030 END AS to_year,
CASE n_regionkey WHEN 0 THEN [] WHEN 1 THEN ['rct'] ELSE ['rct', 'meta'] END AS types, n_regionkey = 3 AS free_full_text, n_regionkey = 4 AS humans, CASE WHEN n_regionkey > 2 THEN ['romanian', 'english'] ELSE [] END AS languages,
CASE WHEN n_regionkey = 2 THEN ['aged'] ELSE [] END AS ages, CASE WHEN n_regionkey = 1 THEN 'female' ELSE '' END AS sex, CASE WHEN n_regionkey = 0 THEN 'therapy' END AS clinical, CASE WHEN n_regionkey = 0 THEN 'narrow' END AS scope FROM nation"""


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    region = c("n_regionkey")
    words = lambda *x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    return table(spark, sf, "nation").select(
        c("n_nationkey").cast("bigint").alias("k"), c("n_name").alias("base"), F.when(region > 1, 2000 + c("n_nationkey")).cast("int").alias("from_year"), F.when(region > 2, 2030).alias("to_year"),
        F.when(region == 0, words()).when(region == 1, words("rct")).otherwise(words("rct", "meta")).alias("types"), (region == 3).alias("free_full_text"), (region == 4).alias("humans"),
        F.when(region > 2, words("romanian", "english")).otherwise(words()).alias("languages"), F.when(region == 2, words("aged")).otherwise(words()).alias("ages"),
        F.when(region == 1, "female").otherwise("").alias("sex"), F.when(region == 0, "therapy").alias("clinical"), F.when(region == 0, "narrow").alias("scope"),
    )


@query(f"""SELECT k, array_to_string(list_filter(['(' || base || ')', CASE len(types) WHEN 1 THEN 'randomized controlled trial[pt]' WHEN 2 THEN '(meta-analysis[pt] OR randomized controlled trial[pt])' END,
CASE WHEN from_year IS NOT NULL OR to_year IS NOT NULL THEN '("' || coalesce(from_year, 1800) || '/01/01"[dp] : "' || coalesce(to_year, 3000) || '/12/31"[dp])' END, CASE WHEN free_full_text THEN 'free full text[sb]' END,
CASE WHEN humans THEN 'humans[mh]' END, CASE WHEN len(languages) > 0 THEN '(romanian[la] OR english[la])' END, CASE WHEN len(ages) > 0 THEN 'aged[mh]' END, CASE WHEN sex <> '' THEN sex || '[mh]' END,
CASE WHEN clinical IS NOT NULL THEN 'Therapy/Narrow[filter]' END], lambda x: x IS NOT NULL), ' AND ') AS query FROM ({_FILTERS})""")
def full_query(spark: SparkSession, sf: str) -> DataFrame:
    return _searches(spark, sf).select("k", search.full_query().alias("query"))


@query(f"""SELECT k, count(*) AS chips, string_agg(label, '|' ORDER BY label) AS labels FROM (SELECT k, unnest(list_filter([CASE WHEN from_year IS NOT NULL AND to_year IS NOT NULL THEN from_year || '–' || to_year
WHEN from_year IS NOT NULL THEN 'From ' || from_year WHEN to_year IS NOT NULL THEN 'Until ' || to_year END, CASE WHEN len(types) = 2 THEN 'Meta-analysis' END, CASE WHEN len(types) > 0 THEN 'Randomized controlled trial' END,
CASE WHEN free_full_text THEN 'Free full text' END, CASE WHEN humans THEN 'Humans' END, CASE WHEN len(languages) > 0 THEN 'English' END, CASE WHEN len(languages) > 0 THEN 'Romanian' END, CASE WHEN len(ages) > 0 THEN 'Older adults (65+)' END,
CASE WHEN sex <> '' THEN 'Female' END, CASE WHEN clinical IS NOT NULL THEN 'Clinical query: Therapy (narrow)' END], lambda x: x IS NOT NULL)) AS label FROM ({_FILTERS})) GROUP BY k""")
def active_filters(spark: SparkSession, sf: str) -> DataFrame:
    chips = search.active_filters(_searches(spark, sf), "k")
    return chips.groupBy("k").agg(F.count("*").alias("chips"), F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))


@query("""SELECT a.n_nationkey::BIGINT AS k, CASE WHEN contains(a.n_name, ' ') THEN '((' || a.n_name || ')' ELSE '(' || a.n_name END || ' OR (big ' || a.n_name || ')) AND (' || CASE WHEN contains(r_name, ' ') THEN '(' || r_name || ')' ELSE r_name END || ' OR placebo) AND (death OR pain)' AS query
FROM nation a JOIN region ON r_regionkey = n_regionkey""")
def pico_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    return rows.select(c("n_nationkey").alias("k"), search.pico_query(F.concat("n_name", F.lit(", big "), "n_name"), c("r_name"), F.lit("placebo"), F.lit("death; pain")).alias("query"))


@query("""SELECT n_nationkey::BIGINT AS k, '(' || n_name || ') AND "' || r_name || '"[tiab]' AS query, 'https://pubmed.ncbi.nlm.nih.gov/?term=' || url_encode(n_name) AS url FROM nation JOIN region ON r_regionkey = n_regionkey""")
def narrow_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    return rows.select(c("n_nationkey").alias("k"), search.narrow(c("n_name"), c("r_name")).alias("query"), tx.search_url(c("n_name")).alias("url"))


@query("""SELECT n_nationkey::BIGINT AS k, '#q=' || replace(url_encode(n_name), '%20', '+') || '&n=50&s=relevance' || CASE WHEN n_regionkey = 4 THEN '&f=' || url_encode('{"humans":true}') ELSE '' END AS fragment FROM nation""")
def state_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = _searches(spark, sf).join(table(spark, sf, "nation"), c("k") == c("n_nationkey"))
    plain = rows.select("k", "base", "n_regionkey", *[F.lit(None).cast("int").alias(x) for x in ("from_year", "to_year")], *[F.array().cast("array<string>").alias(x) for x in ("types", "languages", "ages")], F.lit(False).alias("free_full_text"), "humans", *[F.lit(None).cast("string").alias(x) for x in ("sex", "clinical", "scope")])
    return plain.select("k", search.state_fragment(c("base"), F.lit(50), F.lit("relevance"), search.changed_filters()).alias("fragment"))


# ---------------------------------------------------------------- citations

_PEOPLE_LIST = """CASE WHEN len(authors_full) > 0 THEN list_transform(authors_full, lambda a: {last: coalesce(a.last_name, ''), fore: coalesce(a.fore_name, ''), initials: coalesce(a.initials, ''), collective: coalesce(a.collective, '')})
ELSE list_transform(coalesce(authors, []), lambda a: {last: split_part(a, ' ', 1), fore: '', initials: split_part(a, ' ', 2), collective: ''}) END"""
_P = f"(SELECT *, {_PEOPLE_LIST} AS people FROM articles)"
_TITLE = r"regexp_replace(title, '\.[\s\p{Z}\x{FEFF}]*$', '')"
_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"
_SQUEEZE = lambda x: _STRIP(rf"regexp_replace({x}, '[\s\p{{Z}}\x{{FEFF}}]+', ' ', 'g')")
_OPT = lambda column, before="", after="": f"CASE WHEN {column} <> '' THEN '{before}' || {column} || '{after}' ELSE '' END"
_VOL = lambda before: f"CASE WHEN volume <> '' THEN '{before}' || volume || {_OPT('issue', '(', ')')} ELSE '' END"
_SHORT = _STRIP("a.last || ' ' || a.initials")
_NAMES = f"list_transform(people, lambda a: CASE WHEN a.collective <> '' THEN a.collective ELSE {_SHORT} END)"


@query(f"""SELECT article_id, {_SQUEEZE(f"CASE WHEN len(n) > 6 THEN array_to_string(n[1:6], ', ') || ', et al.' ELSE array_to_string(n, ', ') || '.' END || ' ' || {_TITLE} || '. ' || journal || '. ' || pub_year || {_OPT('pub_month', ' ')} || {_VOL(';')} || {_OPT('pages', ':')} || '.' || {_OPT('doi', ' doi:', '.')} || {_OPT('pmid', ' PMID: ', '.')}")} AS reference
FROM (SELECT *, {_NAMES} AS n FROM {_P})""")
def vancouver(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.vancouver().alias("reference"))


_DOTTED = "array_to_string(list_transform(regexp_extract_all(a.initials, '.'), lambda x: x || '.'), ' ')"
_APA_NAMES = f"list_transform(people, lambda a: CASE WHEN a.collective <> '' THEN a.collective ELSE a.last || ', ' || {_DOTTED} END)"


@query(f"""SELECT article_id, {_STRIP(f"CASE len(n) WHEN 0 THEN '' WHEN 1 THEN n[1] ELSE CASE WHEN len(n) <= 20 THEN array_to_string(n[1:len(n) - 1], ', ') || ', & ' || n[-1] ELSE array_to_string(n[1:19], ', ') || ', … ' || n[-1] END END || ' (' || CASE WHEN pub_year <> '' THEN pub_year ELSE 'n.d.' END || '). ' || {_TITLE} || '. ' || CASE WHEN journal_title <> '' THEN journal_title ELSE journal END || {_VOL(', ')} || {_OPT('pages', ', ')} || '.' || CASE WHEN doi <> '' THEN ' https://doi.org/' || doi ELSE {_OPT('pmid', ' https://pubmed.ncbi.nlm.nih.gov/', '/')} END")} AS reference
FROM (SELECT *, {_APA_NAMES} AS n FROM {_P})""")
def apa(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.apa().alias("reference"))


_URL = f"CASE WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END"
_CELL = lambda x: f"CASE WHEN regexp_matches(coalesce({x}, ''), '[\",\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END"


@query("SELECT article_id, " + " || ',' || ".join(_CELL(x) for x in ("pmid", _TITLE, "array_to_string(authors, '; ')", "journal", "pub_year", "volume", "issue", "pages", "doi", "array_to_string(pub_types, '; ')", _URL)) + " AS line FROM articles")
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.csv_row().alias("line"))


_PART = r"""CASE len(w) WHEN 0 THEN regexp_replace(array_to_string(regexp_split_to_array(title, '[\s\p{Z}]+')[1:3], ' '), '[.,:;]+$', '') || '…' WHEN 1 THEN w[1] WHEN 2 THEN w[1] || ' & ' || w[2] ELSE w[1] || ' et al.' END"""
_WHO = f"(SELECT *, list_transform(people, lambda a: CASE WHEN a.collective <> '' THEN a.collective ELSE a.last END) AS w FROM {_P})"


@query(f"SELECT article_id, {_PART} || ', ' || CASE WHEN pub_year <> '' THEN pub_year ELSE 'n.d.' END AS label, {_URL} AS url FROM {_WHO}")
def study_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.study_label().alias("label"), tx.paper_url().alias("url"))


_LINE = lambda tag, x: f"CASE WHEN {x} <> '' THEN '{tag}  - ' || {x} END"
_RIS_AUTHOR = "'AU  - ' || CASE WHEN a.collective <> '' THEN a.collective ELSE array_to_string(list_filter([a.last, CASE WHEN a.fore <> '' THEN a.fore ELSE a.initials END], lambda x: x <> ''), ', ') END"


@query(f"""SELECT article_id, array_to_string(list_filter(['TY  - JOUR'] || list_transform(people, lambda a: {_RIS_AUTHOR}) || ['TI  - ' || {_TITLE}, {_LINE('T2', "CASE WHEN journal_title <> '' THEN journal_title ELSE journal END")}, {_LINE('J2', 'journal')},
{_LINE('PY', 'pub_year')}, {_LINE('VL', 'volume')}, {_LINE('IS', 'issue')}, CASE WHEN pages <> '' THEN 'SP  - ' || split_part(pages, '-', 1) END, {_LINE('EP', "split_part(pages, '-', 2)")}, {_LINE('DO', 'doi')}, {_LINE('AB', "replace(abstract, chr(10), ' ')")}]
|| list_transform(coalesce(mesh_terms, []), lambda k: 'KW  - ' || k) || [CASE WHEN pmid <> '' THEN 'AN  - PMID:' || pmid END, {_LINE('UR', _URL)}, 'ER  - '], lambda x: x IS NOT NULL), chr(13) || chr(10)) AS record FROM {_P}""")
def ris_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.ris().alias("record"))


@query()
def bibtex_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "articles").select("article_id", citations.bibtex().alias("record"))


@query("""SELECT o_orderkey::BIGINT AS o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders""")
def reference_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return citations.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "place")


_CITES = "(SELECT l_suppkey AS doc, l_orderkey AS pos, l_partkey AS key FROM lineitem)"
_ORDER = f"(SELECT doc, key, row_number() OVER (PARTITION BY doc ORDER BY min(pos), key) AS number FROM {_CITES} GROUP BY 1, 2)"


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as documents, orders as places in them, parts as what is cited there."""
    return table(spark, sf, "lineitem").select(c("l_suppkey").alias("doc_id"), c("l_orderkey").alias("pos"), c("l_partkey").alias("key"))


@query(f"SELECT doc::BIGINT AS doc_id, key::BIGINT AS key, number FROM {_ORDER}")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return citations.citation_order(_citations(spark, sf))


@query(f"""WITH n AS (SELECT DISTINCT doc, pos, number FROM {_CITES} JOIN {_ORDER} USING (doc, key)), i AS (SELECT *, number - row_number() OVER (PARTITION BY doc, pos ORDER BY number) AS island FROM n),
r AS (SELECT doc, pos, min(number) AS a, max(number) AS b FROM i GROUP BY doc, pos, island)
SELECT doc::BIGINT AS doc_id, pos::BIGINT AS pos, '[' || string_agg(CASE WHEN b - a >= 2 THEN a || '–' || b WHEN b > a THEN a || ',' || b ELSE a::VARCHAR END, ',' ORDER BY a) || ']' AS label FROM r GROUP BY 1, 2""")
def number_ranges(spark: SparkSession, sf: str) -> DataFrame:
    cites = _citations(spark, sf)
    return citations.cite_labels(cites, citations.citation_order(cites))


_CITED = "(SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS key, p_brand AS author_label, p_size::VARCHAR AS pub_year, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""SELECT doc_id::BIGINT AS doc_id, key::BIGINT AS key, chr((96 + place)::INT) AS suffix FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(author_label), pub_year) AS n,
row_number() OVER (PARTITION BY doc_id, lower(author_label), pub_year ORDER BY lower(title), title, key) AS place FROM {_CITED}) WHERE n > 1 AND place <= 26""")
def year_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(c("p_partkey").alias("key"), c("p_brand").alias("author_label"), c("p_size").cast("string").alias("pub_year"), c("p_name").alias("title"))
    cited = table(spark, sf, "lineitem").select(c("l_suppkey").alias("doc_id"), c("l_partkey").alias("key")).distinct().join(part, "key")
    return citations.year_suffixes(cited).where(F.col("suffix") <= "z")


# ---------------------------------------------------------------- records of other catalogues

_INDEX = "(SELECT work_id, unnest(map_entries(abstract_inverted_index)) AS e FROM openalex_works)"


@query(f"""SELECT w.work_id, coalesce(t, '') AS abstract FROM openalex_works w LEFT JOIN (SELECT work_id, string_agg(word, ' ' ORDER BY place) AS t FROM (SELECT work_id, place, max(word) AS word FROM (SELECT work_id, e.key AS word, unnest(e.value) AS place FROM {_INDEX}) GROUP BY 1, 2) GROUP BY 1) x USING (work_id)""")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "openalex_works").select("work_id", records.abstract_from_index(c("abstract_inverted_index")).alias("abstract"))


@query(r"""SELECT work_id, trim(regexp_replace(title, '<[^>]+>', '', 'g')) AS title, regexp_extract(coalesce(ids.pmid, ''), '(\d{4,9})/?$', 1) AS pmid, nullif(regexp_extract(coalesce(ids.pmcid, ''), '(?i)(PMC\d+)', 1), '') AS pmcid,
lower(regexp_replace(doi, '(?i)^https?://(dx\.)?doi\.org/', '')) AS doi, coalesce(publication_year::VARCHAR, '') AS pub_year, coalesce(source_title, '') AS journal,
CASE WHEN coalesce(biblio.first_page, '') = '' THEN '' WHEN biblio.last_page <> '' AND biblio.last_page <> biblio.first_page THEN biblio.first_page || '-' || biblio.last_page ELSE biblio.first_page END AS pages, 'oa:' || split_part(oa_key, '/', -1) AS source_id
FROM openalex_works WHERE trim(regexp_replace(title, '<[^>]+>', '', 'g')) <> ''""")
def openalex_articles(spark: SparkSession, sf: str) -> DataFrame:
    return records.articles_from_openalex(table(spark, sf, "openalex_works")).select("work_id", "title", "pmid", "pmcid", "doi", "pub_year", "journal", "pages", "source_id")


@query(r"""SELECT crossref_id, trim(regexp_replace(coalesce(title[1], ''), '<[^>]+>', '', 'g')) AS title, lower(doi) AS doi, coalesce(issued.date_parts[1][1]::VARCHAR, '') AS pub_year, coalesce(short_container_title[1], container_title[1], '') AS journal,
regexp_replace(coalesce(page, ''), '[–—]', '-', 'g') AS pages, CASE WHEN doi <> '' THEN 'doi:' || lower(doi) END AS source_id FROM crossref_works""")
def crossref_articles(spark: SparkSession, sf: str) -> DataFrame:
    return records.articles_from_crossref(table(spark, sf, "crossref_works")).select("crossref_id", "title", "doi", "pub_year", "journal", "pages", "source_id")


@query(rf"""WITH i AS (SELECT article_id, rtrim(regexp_extract(lower(doi), '\b(10\.\d{{4,9}}/[^\s\"<>]+)', 1), '.,;)]') AS value FROM articles WHERE doi IS NOT NULL), d AS (SELECT DISTINCT lower(doi) AS value FROM crossref_works WHERE doi IS NOT NULL)
SELECT article_id, d.value IS NOT NULL AS found, CASE WHEN d.value IS NULL THEN CASE WHEN i.value = '' THEN '{records.NO_IDENTIFIER.replace("'", "''")}' ELSE '{records.NO_DOI}' END END AS error FROM i LEFT JOIN d ON d.value = i.value""")
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """The DOIs of articles routed to the DOI records."""
    articles = table(spark, sf, "articles")
    by_doi = records.articles_from_crossref(table(spark, sf, "crossref_works")).select("doi", "pmid", "title")
    inputs = articles.where(c("doi").isNotNull()).select("article_id", c("doi").alias("text"))
    out = records.looked_up(inputs, by_doi, articles.select("doi", "pmid", "title"))
    return out.select("article_id", c("found").isNotNull().alias("found"), "error")


@query("SELECT p_partkey::VARCHAR AS pmid, p_size::BIGINT AS citations, round(p_retailprice, 6) AS rcr FROM part")
def citation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics read from response payloads made of parts."""
    item = F.struct(c("p_partkey").alias("pmid"), c("p_size").alias("citation_count"), c("p_retailprice").alias("relative_citation_ratio"))
    payloads = table(spark, sf, "part").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("value"))
    return records.metrics(payloads)


@query("""SELECT n_nationkey::BIGINT AS k, (generate_subscripts(ids, 1) - 1)::BIGINT AS rank, unnest(ids) AS pmid FROM (SELECT n_nationkey, list(c_custkey::VARCHAR ORDER BY c_custkey) AS ids FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)""")
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked ids read from search responses made of nations and their customers."""
    ids = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")).alias("idlist"))
    payloads = ids.select("c_nationkey", F.to_json(F.struct(F.struct(F.size("idlist").cast("string").alias("count"), "idlist", c("c_nationkey").cast("string").alias("querytranslation")).alias("esearchresult"))).alias("value"))
    return records.search_hits(payloads).select(c("translation").cast("bigint").alias("k"), "rank", "pmid")


@query("SELECT l_partkey::VARCHAR AS dst, min(l_orderkey)::BIGINT AS pos FROM lineitem WHERE l_suppkey = 1 AND l_partkey <> 1 GROUP BY 1 ORDER BY 2, 1 LIMIT 50")
def linked_papers(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").groupBy(c("l_suppkey").cast("string").alias("src"), c("l_partkey").cast("string").alias("dst")).agg(F.min("l_orderkey").alias("first"))
    # ties of place are ordered by id, as a list has one place an entry
    links = edges.select("src", "dst", F.lit("similar").alias("kind"), F.struct("first", "dst").alias("pos"))
    return records.linked(links, "1", "similar").select("dst", c("pos.first").alias("pos"))
