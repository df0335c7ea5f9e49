"""Counts over papers: years, journals, evidence, orders and the overview of a list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.core.session import cut
from litforge.functions import text as tx
from litforge.operators.citations import authors_of
from litforge.operators.statistics import upper_median

c = F.col


def tally(labels: DataFrame, label: str, limit: int | None = 10, collation: str | None = None) -> DataFrame:
    """label, papers: the most frequent labels that are not blank; ties by label (in ``collation`` if one is named)."""
    counts = labels.where(tx.truthy(c(label))).groupBy(c(label).alias("label")).agg(F.count("*").alias("papers"))
    second = F.collate("label", collation) if collation else c("label")
    return counts.orderBy(F.desc("papers"), second).limit(limit) if limit else counts


def densify(counts: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """``counts(year, papers)`` with the years between its first and last (or lo and hi) that have none."""
    span = counts.agg(F.coalesce(lo, F.min("year")).alias("lo") if lo is not None else F.min("year").alias("lo"), F.coalesce(hi, F.max("year")).alias("hi") if hi is not None else F.max("year").alias("hi"))
    years = span.where(c("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("papers", F.lit(0)).alias("papers"))


def year_counts(papers: DataFrame, year: str = "pub_year") -> DataFrame:
    """Papers per year after 1800, gaps filled; values that are no year don't count."""
    number = c(year).try_cast("int")
    return densify(papers.where(number > 1800).groupBy(number.alias("year")).agg(F.count("*").alias("papers")))


def counts_by_year(papers: DataFrame, last: int, years: int = 25, year: str = "pub_year") -> DataFrame:
    """year, papers of the ``years`` calendar years that end with ``last``, zeros included."""
    number = c(year).try_cast("int")
    counts = papers.where(number.between(last - years + 1, last)).groupBy(number.alias("year")).agg(F.count("*").alias("papers"))
    span = papers.sparkSession.range(last - years + 1, last + 1).select(c("id").cast("int").alias("year"))
    return span.join(F.broadcast(counts), "year", "left").select("year", F.coalesce("papers", F.lit(0)).alias("papers"))  # one row a year


def evidence_mix(papers: DataFrame) -> DataFrame:
    """rank, label, papers of the evidence levels that occur."""
    counts = papers.groupBy(tx.evidence_rank(c("pub_types")).alias("rank")).agg(F.count("*").alias("papers"))
    return counts.select("rank", tx.level_name(c("rank"), 2).alias("label"), "papers")


def order_keys(order: str, citations: str = "citations") -> list[Column]:
    """Sort keys of an order of results; the search rank breaks ties. Papers without citation counts come last."""
    keys = {
        "pubmed": [],
        "evidence": [tx.evidence_rank(c("pub_types"))],
        "citations": [F.desc(F.coalesce(c(citations), F.lit(-1)))],
        "newest": [F.desc(F.coalesce(c("pub_year").try_cast("int"), F.lit(0)))],
    }
    return [*keys[order], c("rank")]


def order_articles(papers: DataFrame, order: str, metrics: DataFrame | None = None) -> DataFrame:
    """``papers`` in an order of results; metrics(pmid, citations) are joined where the order needs them."""
    rows = papers.join(metrics, "pmid", "left") if metrics is not None else papers.withColumn("citations", F.lit(None).cast("long"))
    return rows.orderBy(*order_keys(order))


# Names of the parts of an overview in its export, in order.
PARTS = {"years": "Year", "evidence": "Evidence", "designs": "Design", "journals": "Journal", "authors": "First author", "decisions": "Decision"}


def overview_lines(table: DataFrame) -> DataFrame:
    """ord1, ord2, papers, label, line: the export of an overview, header first; sort by ord1, ord2, papers (most first), label."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair]), c("group"))
    place = F.array_position(F.array(*[F.lit(k) for k in PARTS]), c("group")).cast("int")
    text = F.concat(name, F.lit(',"'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('",'), c("papers").cast("string"))
    rows = table.where(name.isNotNull()).select(place.alias("ord1"), c("ord").alias("ord2"), "papers", "label", text.alias("line"))
    head = table.sparkSession.createDataFrame([(0, 0, 0, "", "group,label,papers")], rows.schema)
    return head.unionByName(rows)


def overview(papers: DataFrame, cells: DataFrame, decisions: DataFrame, notes: DataFrame) -> DataFrame:
    """group, label, papers, ord: the summary of a list as one long table.

    papers have column key; cells(key, design), decisions(key, decision), notes(key, note). One join prepares narrow rows, which
    are cut, so that texts are read once; each part is one small aggregation of them.
    """
    rows = papers.join(cells, "key", "left").join(decisions, "key", "left").join(notes, "key", "left")
    first = F.get(authors_of(), F.lit(0))
    rows = rows.withColumn("people", tx.participants(tx.sample_size()))
    rows = cut(rows.select(
        "key", c("pub_year").try_cast("int").alias("year"), tx.evidence_rank(c("pub_types")).alias("rank"), c("journal"),
        F.coalesce(tx.given(F.trim("design")), F.nullif(tx.study_design(), F.lit("")), F.lit("Not stated")).alias("design"),
        F.when(first["collective"] != "", first["collective"]).otherwise(first["last"]).alias("author"),
        F.coalesce(tx.given(c("decision")), F.lit("undecided")).alias("decision"), (F.length(tx.strip(F.coalesce("abstract", F.lit("")))) > 0).alias("has_abstract"),
        F.coalesce("retracted", F.lit(False)).alias("retracted"), (F.length(tx.strip(F.coalesce("note", F.lit("")))) > 0).alias("has_note"), F.when(c("people") > 0, c("people")).alias("size"),
    ))
    shape = lambda df, group, label, papers_, order: df.select(F.lit(group).alias("group"), label.cast("string").alias("label"), papers_.cast("long").alias("papers"), order.cast("int").alias("ord"))
    zero = F.lit(0)
    years = shape(densify(rows.where(c("year") > 1800).groupBy("year").agg(F.count("*").alias("papers"))), "years", c("year"), c("papers"), c("year"))
    evidence = shape(rows.groupBy("rank").agg(F.count("*").alias("papers")), "evidence", tx.level_name(c("rank"), 2), c("papers"), c("rank"))
    tops = [shape(tally(rows, k, n), g, c("label"), c("papers"), zero) for g, k, n in (("designs", "design", 10), ("journals", "journal", 8), ("authors", "author", 8))]
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("include", "exclude", "unsure", "undecided")) for x in (k, i)]), c("decision"))
    decided = shape(rows.groupBy("decision").agg(F.count("*").alias("papers")), "decisions", c("decision"), c("papers"), order)
    sums = rows.agg(F.count("*").alias("total"), F.count_if("has_abstract").alias("with_abstract"), F.count_if("retracted").alias("retracted"), F.count_if("has_note").alias("with_notes"), F.sum("size").alias("participants"))
    totals = sums.select(F.expr("stack(5, 'total', total, 'with_abstract', with_abstract, 'retracted', retracted, 'with_notes', with_notes, 'participants', participants) AS (label, papers)"))
    totals = shape(totals, "totals", c("label"), c("papers"), zero)
    medians = [shape(upper_median(rows.where(c("year") > 1800), "year"), "totals", F.lit("median_year"), c("median"), zero), shape(upper_median(rows, "size"), "totals", F.lit("median_sample"), c("median"), zero)]
    return reduce(DataFrame.unionByName, [years, evidence, *tops, decided, totals, *medians])
