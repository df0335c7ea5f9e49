"""Terms found in papers: counting, canonical forms, top terms, co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.core.frames import join_on
from litforge.data import load
from litforge.functions import text as tx

c = F.col


def common_abbreviations() -> dict[str, str]:
    """Common clinical abbreviations and what they stand for, used where no paper defines them."""
    return {short: long for group in load("abbreviations").values() for short, long in group.items()}


def counted_mentions(entities: DataFrame, canonical: Column | None = None, doc: str = "article_id", seen: list[str] | None = None) -> DataFrame:
    """doc, category, text, term_key, seen of the mentions that count: not negated, keys of two characters and more."""
    key = tx.normalize_term(c("text")) if canonical is None else canonical
    order = F.struct(*[c(k).alias(f"k{i}") for i, k in enumerate(seen or [doc, *(k for k in ("pos", "entity_id") if k in entities.columns)])])
    rows = entities.where(~F.coalesce("negated", F.lit(False)) & c("text").isNotNull())
    return rows.select(c(doc).alias("doc"), "category", "text", key.alias("term_key"), order.alias("seen")).where(F.length("term_key") >= 2)


def tally(entities: DataFrame, canonical: Column | None = None, doc: str = "article_id", seen: list[str] | None = None) -> DataFrame:
    """category, term_key, display, docs, mentions of the terms that are not negated.

    display is the commonest written-out spelling (abbreviations come last, ties go to the one seen first in the order of
    the columns ``seen``). Spelling counts and distinct documents come from two aggregations on the same key.
    """
    rows = counted_mentions(entities, canonical, doc, seen)
    surfaces = rows.groupBy("category", "term_key", "text").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    shown = surfaces.groupBy("category", "term_key").agg(
        F.min_by("text", F.struct(tx.is_abbreviation(c("text")).alias("abbreviated"), (-c("n")).alias("n"), "first", "text")).alias("display"), F.sum("n").alias("mentions")
    )
    docs = rows.select("category", "term_key", "doc").distinct().groupBy("category", "term_key").agg(F.count("*").alias("docs"))
    return join_on(shown, docs, ["category", "term_key"]).select("category", "term_key", "display", "docs", "mentions")


def term_documents(entities: DataFrame, canonical: Column | None = None, doc: str = "article_id") -> DataFrame:
    """category, term_key, doc: the documents of every term, one row each, so that no term's documents stand in one cell."""
    return counted_mentions(entities, canonical, doc).select("category", "term_key", "doc").distinct()


def top_terms(stats: DataFrame, per: int = 12) -> DataFrame:
    """The first ``per`` terms of each category by papers, then mentions, then key, with their place.

    A filter on the place of a window is pushed into the sort by the planner, which keeps ``per`` rows a category of each
    task before the shuffle.
    """
    w = Window.partitionBy("category").orderBy(F.desc("docs"), F.desc("mentions"), "term_key")
    return stats.withColumn("place", F.row_number().over(w)).where(c("place") <= per)


def group_terms(entities: DataFrame, doc: str | None = None) -> DataFrame:
    """category, term_key, display (first spelling), n, negated (in every mention), ord of the terms, per document if named.

    ord has the order of display: category, mentions (most first), spelling in the language's order.
    """
    by = [*([doc] if doc else []), "category", "term_key"]
    rows = entities.where(c("text").isNotNull()).withColumn("term_key", tx.normalize_term(c("text")))
    order = F.struct(*([c(doc)] if doc else [c("article_id")]), "pos", "entity_id")
    out = rows.groupBy(*by).agg(F.min_by("text", order).alias("display"), F.count("*").alias("n"), F.bool_and(F.coalesce("negated", F.lit(False))).alias("negated"))
    rank = F.struct(tx.category_rank(c("category")).alias("category"), (-c("n")).alias("n"), F.lower("display").alias("name"))
    return out.withColumn("ord", rank)


def cooccurring(entities: DataFrame, category: str, term_key: str, limit: int = 8, doc: str = "article_id") -> DataFrame:
    """The terms that share most papers with one term: shared papers, own papers. The target's papers are a semi-join."""
    rows = term_documents(entities, doc=doc)
    target = (c("category") == category) & (c("term_key") == term_key)
    here = rows.where(target).select("doc", F.lit(1).alias("hit"))
    marked = rows.where(~target).join(here, "doc", "left")
    counts = marked.groupBy("category", "term_key").agg(F.count("hit").alias("shared"), F.count("*").alias("docs")).where(c("shared") > 0)
    return counts.orderBy(F.desc("shared"), F.desc("docs"), "category", "term_key").limit(limit)


def papers_with_term(articles: DataFrame, entities: DataFrame, category: str, term_key: str, evidence: int | None = None) -> DataFrame:
    """The articles that mention a term (not negated), of one level of evidence if a rank is named."""
    hits = entities.where((c("category") == category) & ~F.coalesce("negated", F.lit(False)) & (tx.normalize_term(c("text")) == term_key)).select("article_id").distinct()
    kept = articles if evidence is None else articles.where(tx.evidence_rank(c("pub_types")) == evidence)
    return kept.join(hits, "article_id", "left_semi")


def present_categories(entities: DataFrame) -> DataFrame:
    """category, label, ord of the categories that occur, in the order of display; one small aggregation."""
    found = entities.select("category").distinct()
    return found.select("category", tx.category_label(c("category")).alias("label"), tx.category_rank(c("category")).alias("ord")).where(c("ord").isNotNull())


# ---------------------------------------------------------------- abbreviations


def long_form(short: str, candidate: str) -> str | None:
    """The words of ``candidate`` that a short form stands for, its letters found from the end backwards.

    The first letter of the short form must begin a word (the algorithm of Schwartz and Hearst, 2003).
    """
    low, at = candidate.lower(), len(candidate)
    letters = [x for x in short.lower() if x.isascii() and x.isalnum()]
    for k in range(len(letters) - 1, -1, -1):
        first = k == 0 and short.lower()[0] == letters[0]
        while True:
            at = low.rfind(letters[k], 0, at)
            if at < 0:
                return None
            if not first or at == 0 or not (low[at - 1].isascii() and low[at - 1].isalnum()):
                break
    return candidate[low.rfind(" ", 0, max(at, 0)) + 1 :].strip()


def abbreviations_in(text: str) -> dict[str, str]:
    """Short and long forms that a text defines as "long form (SHORT)"; the last definition counts."""
    import regex

    found: dict[str, str] = {}
    for m in regex.finditer(r"\(([A-Za-z0-9-]{2,10})\)", text or ""):
        short = m[1]
        if not regex.search("[A-Z]", short):
            continue
        most = min(len(short) + 5, 2 * len(short))
        words = text[: m.start()].split()[-most:]
        candidate = regex.sub(r"^.*[.;:!?]\s+", "", " ".join(words))
        long = long_form(short, candidate)
        if long and len(long) > len(short) and len(long.split()) <= most:
            key = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z", "", regex.sub(r"\s+", " ", long.lower()))
            found[short.lower()] = key
    return found


def find_abbreviations(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, short, long of the definitions in each text; texts without a bracketed short form never reach Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, s, f) for d, t in zip(frame.doc, frame.text, strict=True) for s, f in abbreviations_in(t).items()]
            yield pd.DataFrame(rows, columns=["doc", "short", "long"])

    kind = texts.schema[doc].dataType.simpleString()
    return texts.where(c(text).rlike(r"\([A-Za-z0-9-]{2,10}\)")).select(c(doc).alias("doc"), c(text).alias("text")).mapInPandas(run, f"doc {kind}, short string, long string")


def abbreviation_map(definitions: DataFrame, common: dict[str, str] | None = None) -> DataFrame:
    """short, long: the definition most papers give, else the common one; ties go to the smallest document's."""
    votes = definitions.groupBy("short", "long").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    won = votes.groupBy("short").agg(F.min_by("long", F.struct((-c("n")).alias("n"), "first", "long")).alias("voted"))
    base = definitions.sparkSession.createDataFrame(sorted((common_abbreviations() if common is None else common).items()), "short string, common string")
    return base.join(won, "short", "full").select("short", F.coalesce("voted", "common").alias("long"))


def with_canonical(entities: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``entities`` with column canonical: normalised text, spelled out if it is a known abbreviation, last word singular."""
    known = abbreviations.select(c("short").alias("__k"), c("long").alias("__l"))
    rows = entities.withColumn("__k", tx.normalize_term(c("text"))).join(known, "__k", "left")
    return rows.withColumn("canonical", tx.singularize(F.coalesce("__l", "__k"))).drop("__k", "__l")


def terms_csv(stats: DataFrame, total: Column, documents: DataFrame | None = None) -> DataFrame:
    """category label, term, papers, mentions, share of papers (three decimals), as the export has them.

    With ``documents`` (:func:`term_documents`) the ids of a term's papers stand in one more column, in order, blanks between,
    as the export wants it: a cell then grows with the papers of its term, so give it the terms that are shown.
    """
    share = F.format_string("%.3f", c("docs") / total)
    row = [tx.category_label(c("category")).alias("category"), tx.normalize_term(c("display")).alias("term"), c("docs").alias("papers"), "mentions", share.alias("share")]
    if documents is None:
        return stats.select(*row)
    ids = join_on(documents, stats.select("category", "term_key"), ["category", "term_key"]).groupBy("category", "term_key").agg(F.array_join(F.array_sort(F.collect_list("doc")).cast("array<string>"), " ").alias("pmids"))
    return join_on(stats, ids, ["category", "term_key"], "left").select(*row, F.coalesce("pmids", F.lit("")).alias("pmids"))


#: Fixed value: the header of the export of terms.
CSV_HEADER = "category,term,papers,mentions,share,pmids"


def terms_lines(table: DataFrame) -> Column:
    """A row of :func:`terms_csv` as a line of the file."""
    return F.concat_ws(",", *[tx.csv_cell(c(k).cast("string")) for k in table.columns])
