"""Records of other catalogues as articles, and payload files of the bibliographic service."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.functions import text as tx

c = F.col
ARTICLE = (
    "pmid string, title string, abstract string, authors array<string>, journal string, pub_year string, pub_types array<string>, doi string, pmcid string, journal_title string, volume string, issue string, "
    "pages string, pub_month string, authors_full array<struct<last_name:string,fore_name:string,initials:string,collective:string>>, mesh_terms array<string>, retracted boolean, concern boolean, source_id string"
)
# Publication types of the two open catalogues.
OPEN_TYPES = {"article": "Journal Article", "review": "Review", "preprint": "Preprint", "letter": "Letter", "editorial": "Editorial", "book-chapter": "Book Chapter", "book": "Book", "dissertation": "Dissertation"}
DOI_TYPES = {"journal-article": "Journal Article", "posted-content": "Preprint", "book-chapter": "Book Chapter", "book": "Book", "proceedings-article": "Conference Paper"}


def initials(given: Column) -> Column:
    parts = F.filter(F.split(given, r"[\s.-]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), "")


def person(name: Column) -> Column:
    """A displayed name as last name (its last word), fore name and initials."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    n = F.size(words)
    fore = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    return F.struct(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last_name"), fore.alias("fore_name"), initials(fore).alias("initials"), F.lit("").alias("collective"))


def short_names(people: Column) -> Column:
    return F.transform(people, lambda p: F.when(p["collective"] != "", p["collective"]).otherwise(F.concat_ws(" ", tx.given(p["last_name"]), tx.given(p["initials"]))))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word to positions) in order of positions; gaps are skipped.

    Of two words at one place the later entry stays; entries whose word is a whole number count before all others, in
    numeric order.
    """
    whole = lambda e: F.when(e["key"].rlike(r"^(?:0|[1-9]\d{0,8})\z"), e["key"].try_cast("long"))
    entry = lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("at"), whole(e).isNull().alias("text"), F.coalesce(whole(e), i.cast("long")).alias("ord"), e["key"].alias("word")))
    ordered = F.array_sort(F.flatten(F.transform(F.map_entries(index), entry)))
    kept = F.filter(ordered, lambda x, i: (i + 1 >= F.size(ordered)) | (F.get(ordered, i + 1)["at"] != x["at"]))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: x["word"]), " "), F.lit(""))


def _map(table: dict[str, str], value: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(default))


def _untagged(text: Column, by: str = "") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", by)


_NO_TEXT = F.lit
_blank = lambda x: F.coalesce(x, F.lit(""))


def articles_from_openalex(works: DataFrame) -> DataFrame:
    """Works of the open catalogue as articles; works without a title are left out."""
    people = F.filter(F.transform("authorships", lambda a: person(_blank(a["author"]["display_name"]))), lambda p: p["last_name"] != "")
    first, last = c("biblio.first_page"), c("biblio.last_page")
    out = works.select(
        "work_id", _blank(tx.given(F.regexp_extract(_blank(c("ids.pmid")), r"(\d{4,9})/?\z", 1))).alias("pmid"), F.trim(_untagged(c("title"))).alias("title"), abstract_from_index(c("abstract_inverted_index")).alias("abstract"),
        short_names(people).alias("authors"), _blank(c("source_title")).alias("journal"), _blank(c("publication_year").cast("string")).alias("pub_year"), F.array(_map(OPEN_TYPES, _blank(c("work_type")), "Journal Article")).alias("pub_types"),
        F.lower(F.regexp_replace("doi", r"(?i)^https?://(?:dx\.)?doi\.org/", "")).alias("doi"), tx.given(F.regexp_extract(_blank(c("ids.pmcid")), r"(?i)(PMC\d+)", 1)).alias("pmcid"), _blank(c("source_title")).alias("journal_title"),
        _blank(c("biblio.volume")).alias("volume"), _blank(c("biblio.issue")).alias("issue"), F.when(~tx.truthy(first), "").when(tx.truthy(last) & (last != first), F.concat_ws("-", first, last)).otherwise(first).alias("pages"),
        F.lit("").alias("pub_month"), people.alias("authors_full"), F.array().cast("array<string>").alias("mesh_terms"), F.coalesce("is_retracted", F.lit(False)).alias("retracted"), F.lit(False).alias("concern"),
        F.concat(F.lit("oa:"), F.element_at(F.split("oa_key", "/"), -1)).alias("source_id"),
    )
    return out.where(c("title") != "")


def articles_from_crossref(works: DataFrame) -> DataFrame:
    """DOI records as articles."""
    at = lambda name: F.get(c(name), F.lit(0))
    someone = lambda a: F.when(tx.truthy(a["org_name"]), F.struct(F.lit("").alias("last_name"), F.lit("").alias("fore_name"), F.lit("").alias("initials"), a["org_name"].alias("collective"))).otherwise(F.struct(_blank(a["family"]).alias("last_name"), _blank(a["given"]).alias("fore_name"), initials(_blank(a["given"])).alias("initials"), F.lit("").alias("collective")))
    people = F.coalesce(F.transform("author", someone), F.expr("cast(array() as array<struct<last_name:string,fore_name:string,initials:string,collective:string>>)"))
    title = _blank(at("container_title"))
    abstract = F.trim(F.regexp_replace(F.trim(F.regexp_replace(_untagged(c("abstract"), " "), tx.WS + "+", " ")), r"(?i)^abstract\s*", ""))
    doi = F.lower("doi")
    return works.select(
        "crossref_id", F.lit("").alias("pmid"), F.trim(_untagged(at("title"))).alias("title"), abstract.alias("abstract"), short_names(people).alias("authors"), F.coalesce(at("short_container_title"), title).alias("journal"),
        _blank(F.get(F.get(c("issued.date_parts"), F.lit(0)), F.lit(0)).cast("string")).alias("pub_year"), F.array(_map(DOI_TYPES, _blank(c("work_type")), "Journal Article")).alias("pub_types"), doi.alias("doi"), F.lit(None).cast("string").alias("pmcid"),
        title.alias("journal_title"), _blank(c("volume")).alias("volume"), _blank(c("issue")).alias("issue"), F.regexp_replace(_blank(c("page")), "[–—]", "-").alias("pages"), F.lit("").alias("pub_month"), people.alias("authors_full"),
        F.array().cast("array<string>").alias("mesh_terms"), F.lit(False).alias("retracted"), F.lit(False).alias("concern"), F.when(tx.truthy(doi), F.concat(F.lit("doi:"), doi)).alias("source_id"),
    )


# ---------------------------------------------------------------- payload files


def _flat(node: ElementTree.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def parse_record(xml: str) -> dict | None:
    """One bibliographic record, None if it is malformed; text of inline elements counts, as do labels of abstract sections."""
    try:
        record = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    at = lambda path: _flat(record.find(path))
    article = "MedlineCitation/Article"
    sections = [((s.get("Label") + ": ") if s.get("Label") else "") + _flat(s) for s in record.iterfind(f"{article}/Abstract/AbstractText")]
    names = [{"last_name": _flat(a.find("LastName")), "fore_name": _flat(a.find("ForeName")), "initials": _flat(a.find("Initials")), "collective": _flat(a.find("CollectiveName"))} for a in record.iterfind(f"{article}/AuthorList/Author")]
    shown = [n["collective"] or " ".join(x for x in (n["last_name"], n["initials"]) if x) for n in names]
    date = f"{article}/Journal/JournalIssue/PubDate"
    medline = [w for w in at(f"{date}/MedlineDate").replace("-", " ").split() if w[:4].isdigit() and len(w) >= 4]
    ids = {i.get("IdType"): _flat(i) or None for i in record.iterfind("PubmedData/ArticleIdList/ArticleId")}
    types = [_flat(t) for t in record.iterfind(f"{article}/PublicationTypeList/PublicationType")]
    relations = {r.get("RefType") for r in record.iterfind("MedlineCitation/CommentsCorrectionsList/CommentsCorrections")}
    return {
        "pmid": at("MedlineCitation/PMID"), "title": at(f"{article}/ArticleTitle"), "abstract": "\n".join(sections), "authors": [n for n in shown if n],
        "journal": at(f"{article}/Journal/ISOAbbreviation") or at(f"{article}/Journal/Title"), "pub_year": at(f"{date}/Year") or (medline[0][:4] if medline else ""), "pub_types": types, "doi": ids.get("doi"), "pmcid": ids.get("pmc"),
        "journal_title": at(f"{article}/Journal/Title"), "volume": at(f"{article}/Journal/JournalIssue/Volume"), "issue": at(f"{article}/Journal/JournalIssue/Issue"), "pages": at(f"{article}/Pagination/MedlinePgn"), "pub_month": at(f"{date}/Month"),
        "authors_full": names, "mesh_terms": [_flat(d) for d in record.iterfind("MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName")],
        "retracted": "Retracted Publication" in types or "RetractionIn" in relations, "concern": "ExpressionOfConcernIn" in relations, "source_id": None,
    }


def articles_from_xml(records: DataFrame, xml: str = "value") -> DataFrame:
    """Articles of a column with one record element per row; malformed ones are left to :func:`malformed_xml`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for x in frame.xml if (r := parse_record(x)) is not None], columns=[p.split(" ")[0] for p in ARTICLE.split(", ")])

    return records.select(c(xml).alias("xml")).where(c("xml").isNotNull()).mapInPandas(run, ARTICLE)


def malformed_xml(records: DataFrame, xml: str = "value") -> DataFrame:
    """The rows of ``records`` whose record can't be read."""

    @F.pandas_udf(T.BooleanType())
    def bad(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x is not None and parse_record(x) is None)

    return records.where(c(xml).isNotNull() & bad(c(xml)))


def read_xml(spark: SparkSession, path: str, element: str = "PubmedArticle") -> DataFrame:
    """Articles of XML files; files are split at the end of each record, so a large file is read by many tasks."""
    parts = spark.read.option("lineSep", f"</{element}>").text(path)
    start = F.regexp_instr(c("value"), F.lit(f"<{element}[\\s>]"))
    whole = F.concat(F.substring(c("value"), start, F.length("value")), F.lit(f"</{element}>"))
    return articles_from_xml(parts.where(start > 0).select(whole.alias("value")))


def search_hits(payloads: DataFrame) -> DataFrame:
    """rank, pmid, total, translation of search responses (JSON text in column value); responses with an error raise."""
    shape = "esearchresult struct<count:string,idlist:array<string>,querytranslation:string,ERROR:string>"
    rows = payloads.select(F.from_json("value", shape).alias("r")).select("r.esearchresult.*")
    told = F.when(c("ERROR").isNotNull() | c("idlist").isNull(), F.raise_error(F.coalesce("ERROR", F.lit("unreadable search response")))).otherwise(c("idlist"))
    return rows.select(F.posexplode(told).alias("rank", "pmid"), c("count").cast("long").alias("total"), c("querytranslation").alias("translation"))


#: Ids of one request to a service.
BATCH = 200


def batches(hits: DataFrame, size: int = BATCH) -> DataFrame:
    """batch, pmids of ``hits(rank, pmid)``: the ids of each request, in order of rank."""
    return hits.groupBy(F.floor(c("rank") / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("rank", "pmid"))).alias("hits")).select("batch", F.transform("hits", lambda h: h["pmid"]).alias("pmids"))


def fetched(articles: DataFrame, hits: DataFrame) -> DataFrame:
    """Articles of the hits with their rank; the order of the search is the order of rank, hits without a record are left out."""
    return articles.join(hits.select("pmid", "rank"), "pmid")


def link_edges(payloads: DataFrame) -> DataFrame:
    """src, dst, kind, pos of link responses ``payloads(pmid, value)``; kind is similar or citedBy, other links are left out."""
    shape = "linksets array<struct<linksetdbs:array<struct<linkname:string,links:array<string>>>>>"
    sets = payloads.select(c("pmid").alias("src"), F.explode(F.get(F.from_json("value", shape)["linksets"], F.lit(0))["linksetdbs"]).alias("s"))
    kind = F.when(c("s.linkname") == "pubmed_pubmed", "similar").when(c("s.linkname") == "pubmed_pubmed_citedin", "citedBy")
    return sets.select("src", kind.alias("kind"), F.posexplode("s.links").alias("pos", "dst")).where(c("kind").isNotNull()).select("src", "dst", "kind", "pos")


def linked(links: DataFrame, pmid: str, kind: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` papers linked to one, itself left out, from ``links(src, dst, kind, pos)``."""
    return links.where((c("src") == pmid) & (c("kind") == kind) & (c("dst") != pmid)).orderBy("pos").limit(limit).select("dst", "pos")


def metrics(payloads: DataFrame) -> DataFrame:
    """pmid, citations, rcr of metrics responses (JSON text in column value)."""
    rows = payloads.select(F.explode(F.from_json("value", "data array<struct<pmid:long,citation_count:long,relative_citation_ratio:double>>")["data"]).alias("d"))
    return rows.select(c("d.pmid").cast("string").alias("pmid"), F.coalesce("d.citation_count", F.lit(0)).alias("citations"), c("d.relative_citation_ratio").alias("rcr"))


def spelling(payloads: DataFrame, query: str = "query", corrected: str = "corrected") -> DataFrame:
    """``payloads`` with suggestion: the correction where it differs from the query in more than case and edges."""
    other = F.lower(F.trim(corrected)) != F.lower(F.trim(query))
    return payloads.withColumn("suggestion", F.when(tx.truthy(c(corrected)) & other, c(corrected)))


def headings(table: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Subject headings ``table(heading, pos)`` that begin with a prefix of three letters or more."""
    if len(prefix.strip()) < 3:
        return table.limit(0)
    return table.where(F.lower("heading").startswith(prefix.strip().lower())).orderBy("pos").limit(limit)


def heading_suggestions(searches: DataFrame, summaries: DataFrame, limit: int = 8) -> DataFrame:
    """key, pos, heading: the first heading of each id a search found, in the order of the ids; ids without a heading are left out.

    ``searches(key, value)`` are search responses, ``summaries(value)`` summary responses; keys are what was typed, and those
    of less than three letters have none.
    """
    ids = searches.where(F.length(F.trim("key")) >= 3).select("key", F.posexplode(F.from_json("value", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]).alias("pos", "id"))
    terms = summaries.select(F.explode(F.from_json("value", "result map<string,struct<ds_meshterms:array<string>>>")["result"]).alias("id", "r")).select("id", F.get("r.ds_meshterms", F.lit(0)).alias("heading"))
    found = ids.join(terms.where(c("heading").isNotNull()).dropDuplicates(["id"]), "id")
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    return found.withColumn("place", place).where(c("place") <= limit).select("key", "pos", "heading")


# What is said of an identifier that leads to no record.
NO_IDENTIFIER = "That doesn't look like a DOI (10.xxxx/…) or a PubMed ID (digits)."
NO_DOI, NO_PMID = "There is no record for that DOI.", "PubMed has no record with PMID %s."


def looked_up(inputs: DataFrame, by_doi: DataFrame, by_pmid: DataFrame, text: str = "text") -> DataFrame:
    """``inputs`` with found (a struct of the record's columns) or error: pasted identifiers routed to the source of their kind.

    ``by_doi`` and ``by_pmid`` are articles of the two sources; one join each, on the kind and the value.
    """
    wanted = inputs.withColumn("__i", tx.identifier(c(text)))
    shape = [x for x in by_pmid.columns if x in by_doi.columns]
    record = F.struct(*shape)
    both = by_doi.where(c("doi").isNotNull()).select(F.lit("doi").alias("__kind"), F.lower("doi").alias("__value"), record.alias("found")).unionByName(
        by_pmid.where(tx.truthy(c("pmid"))).select(F.lit("pmid").alias("__kind"), c("pmid").alias("__value"), record.alias("found"))
    )
    both = both.dropDuplicates(["__kind", "__value"])
    joined = wanted.join(both, (c("__i.kind") == c("__kind")) & (c("__i.value") == c("__value")), "left")
    error = F.when(c("__i").isNull(), NO_IDENTIFIER).when(c("found").isNotNull(), F.lit(None)).when(c("__i.kind") == "doi", NO_DOI).otherwise(F.format_string(NO_PMID, c("__i.value")))
    return joined.select(*inputs.columns, "found", error.alias("error"))
