"""References in the usual formats, as column expressions over records, and citation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions import text as tx
from litforge.operators.statistics import prefix

c = F.col


def authors_of() -> Column:
    """array<struct<last, fore, initials, collective>>: the full names, else the short ones taken apart at the first space."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    make = lambda last, fore, initials, collective: F.struct(blank(last).alias("last"), blank(fore).alias("fore"), blank(initials).alias("initials"), blank(collective).alias("collective"))
    full = F.transform("authors_full", lambda x: make(x["last_name"], x["fore_name"], x["initials"], x["collective"]))
    short = F.transform("authors", lambda x: make(F.split_part(x, F.lit(" "), F.lit(1)), F.lit(""), F.split_part(x, F.lit(" "), F.lit(2)), F.lit("")))
    return F.when(F.size("authors_full") > 0, full).otherwise(F.coalesce(short, F.expr("cast(array() as array<struct<last:string,fore:string,initials:string,collective:string>>)")))


def _either(*options: Column) -> Column:
    return F.coalesce(*[tx.given(o) for o in options], F.lit(""))


def _part(name: str, before: str = "", after: str = "") -> Column:
    return F.when(tx.truthy(c(name)), F.concat(F.lit(before), c(name), F.lit(after))).otherwise("")


def _volume(before: str) -> Column:
    return F.when(tx.truthy(c("volume")), F.concat(F.lit(before), c("volume"), _part("issue", "(", ")"))).otherwise("")


def vancouver() -> Column:
    names = F.transform(authors_of(), lambda a: F.when(a["collective"] != "", a["collective"]).otherwise(tx.strip(F.concat_ws(" ", a["last"], a["initials"]))))
    authors = F.when(F.size(names) > 6, F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.lit(", et al."))).otherwise(F.concat(F.array_join(names, ", "), F.lit(".")))
    whole = F.concat(
        authors, F.lit(" "), tx.strip_period(c("title")), F.lit(". "), c("journal"), F.lit(". "), c("pub_year"), _part("pub_month", " "),
        _volume(";"), _part("pages", ":"), F.lit("."), _part("doi", " doi:", "."), _part("pmid", " PMID: ", "."),
    )
    return tx.squeeze(whole)


def apa() -> Column:
    dotted = lambda a: F.array_join(F.transform(F.filter(F.split(a["initials"], ""), lambda x: x != ""), lambda x: F.concat(x, F.lit("."))), " ")
    names = F.transform(authors_of(), lambda a: F.when(a["collective"] != "", a["collective"]).otherwise(F.concat(a["last"], F.lit(", "), dotted(a))))
    n = F.size(names)
    last = F.try_element_at(names, F.lit(-1))
    listed = (
        F.when(n == 0, "").when(n == 1, last)
        .when(n <= 20, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), last))
    )
    link = F.when(tx.truthy(c("doi")), F.concat(F.lit(" https://doi.org/"), c("doi"))).otherwise(_part("pmid", " https://pubmed.ncbi.nlm.nih.gov/", "/"))
    return tx.strip(F.concat(
        listed, F.lit(" ("), _either(c("pub_year"), F.lit("n.d.")), F.lit("). "), tx.strip_period(c("title")), F.lit(". "), _either(c("journal_title"), c("journal")),
        _volume(", "), _part("pages", ", "), F.lit("."), link,
    ))


def bib_key() -> Column:
    """Citation key: first author, year, and the pmid, the end of the DOI or the title's length and first letters."""
    first = F.get(authors_of(), F.lit(0))
    letters = lambda x: F.regexp_replace(tx.fold_marks(x), "[^A-Za-z]", "")
    name = _either(letters(_either(first["last"], first["collective"], F.lit("ref"))), F.lit("ref"))
    doi = F.right(F.regexp_replace("doi", "[^A-Za-z0-9]", ""), F.lit(10))
    title = F.concat(F.length("title").cast("string"), F.left(F.regexp_replace("title", "[^A-Za-z]", ""), F.lit(5)))
    return F.concat(name, c("pub_year"), F.lit("_"), F.when(tx.truthy(c("pmid")), c("pmid")).when(tx.truthy(c("doi")), doi).otherwise(title))


def ris() -> Column:
    """One record in RIS, lines ended by CR LF."""
    line = lambda tag, value: F.when(tx.truthy(value), F.concat(F.lit(f"{tag}  - "), value))
    names = F.transform(authors_of(), lambda a: F.concat(F.lit("AU  - "), F.when(a["collective"] != "", a["collective"]).otherwise(F.concat_ws(", ", tx.given(a["last"]), tx.given(F.when(a["fore"] != "", a["fore"]).otherwise(a["initials"]))))))
    keywords = F.transform(F.coalesce("mesh_terms", F.array().cast("array<string>")), lambda k: F.concat(F.lit("KW  - "), k))
    pages = F.split("pages", "-")
    one = lambda *columns: F.array_compact(F.array(*columns))
    lines = F.concat(
        F.array(F.lit("TY  - JOUR")), names,
        one(F.concat(F.lit("TI  - "), tx.strip_period(c("title"))), line("T2", _either(c("journal_title"), c("journal"))), line("J2", c("journal")), line("PY", c("pub_year")), line("VL", c("volume")), line("IS", c("issue")),
            F.when(tx.truthy(c("pages")), F.concat(F.lit("SP  - "), F.get(pages, F.lit(0)))), line("EP", F.get(pages, F.lit(1))), line("DO", c("doi")), line("AB", F.replace(c("abstract"), F.lit("\n"), F.lit(" ")))),
        keywords, one(F.when(tx.truthy(c("pmid")), F.concat(F.lit("AN  - PMID:"), c("pmid"))), line("UR", tx.paper_url()), F.lit("ER  - ")),
    )
    return F.array_join(lines, "\r\n")


def bibtex() -> Column:
    esc = tx.bib_escape
    names = F.transform(authors_of(), lambda a: F.when(a["collective"] != "", F.concat(F.lit("{"), esc(a["collective"]), F.lit("}"))).otherwise(esc(F.concat(a["last"], F.lit(", "), F.when(a["fore"] != "", a["fore"]).otherwise(a["initials"])))))
    field = lambda name, value: F.when(tx.truthy(value), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    pages = F.regexp_replace("pages", "^([^-]*)-", "$1--")
    body = F.array_compact(F.array(
        field("author", F.array_join(names, " and ")), field("title", F.concat(F.lit("{"), esc(tx.strip_period(c("title"))), F.lit("}"))), field("journal", esc(_either(c("journal_title"), c("journal")))),
        field("year", esc(c("pub_year"))), field("volume", esc(c("volume"))), field("number", esc(c("issue"))), field("pages", esc(pages)), field("doi", esc(c("doi"))), field("pmid", esc(c("pmid"))),
    ))
    return F.concat(F.lit("@article{"), bib_key(), F.lit(",\n"), F.array_join(body, ",\n"), F.lit("\n}"))


# The columns of the CSV export.
CSV_HEADER = "pmid title authors journal year volume issue pages doi publication_types url".split()


def csv_row() -> Column:
    blank = lambda x: F.coalesce(x, F.lit(""))
    values = [c("pmid"), tx.strip_period(c("title")), F.array_join("authors", "; "), c("journal"), c("pub_year"), c("volume"), c("issue"), c("pages"), c("doi"), F.array_join("pub_types", "; "), tx.paper_url()]
    return F.concat_ws(",", *[tx.csv_cell(blank(v)) for v in values])


def author_part() -> Column:
    """Who wrote it, in few words; the first words of the title where nobody is named."""
    people = F.transform(authors_of(), lambda a: F.when(a["collective"] != "", a["collective"]).otherwise(a["last"]))
    words = F.array_join(F.slice(F.split(c("title"), tx.WS + "+"), 1, 3), " ")
    at = lambda i: F.get(people, F.lit(i))
    return (
        F.when(F.size(people) == 0, F.concat(F.regexp_replace(words, r"[.,:;]+\z", ""), F.lit("…")))
        .when(F.size(people) == 1, at(0)).when(F.size(people) == 2, F.concat(at(0), F.lit(" & "), at(1)))
        .otherwise(F.concat(at(0), F.lit(" et al.")))
    )


def study_label() -> Column:
    return F.concat(author_part(), F.lit(", "), _either(c("pub_year"), F.lit("n.d.")))


def reference_list(articles: DataFrame, style: str = "vancouver", by: str = "rank") -> DataFrame:
    """number, reference: the references in order of ``by``, numbered for Vancouver (empty number for APA)."""
    made = articles.select(F.col(by).alias("by"), (vancouver() if style == "vancouver" else apa()).alias("reference"))
    if style != "vancouver":
        return made.select(F.lit("").alias("number"), "reference", "by")
    return numbered(made, "by").select(F.col("place").cast("string").alias("number"), "reference", "by")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with column place: 1, 2, … in the order of the distinct numeric values of ``by``; rows without a value are left out.

    A global row number without a global task: ranges are cut at quantiles of ``by``, so values may lie as unevenly as they
    like, numbered by themselves and shifted by the sizes of those before.
    """
    return prefix(rows.where(F.col(by).isNotNull()).withColumn("__one", F.lit(1).cast("long")), by, "__one").withColumn("place", F.col("before") + 1).drop("__one", "before")


def number_runs(numbers: Column) -> Column:
    """Distinct numbers in order, runs of three and more as first–last, the rest with commas ("1,2,4–6")."""
    seq = F.array_sort(F.array_distinct(numbers))
    runs = F.aggregate(
        seq,
        F.expr("cast(array() as array<struct<lo:int,hi:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] == x.cast("int") - 1),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), x.cast("int").alias("hi")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.cast("int").alias("lo"), x.cast("int").alias("hi"))))),
    )
    show = lambda r: F.when(r["hi"] - r["lo"] >= 2, F.concat_ws("–", r["lo"].cast("string"), r["hi"].cast("string"))).when(r["hi"] > r["lo"], F.concat_ws(",", r["lo"].cast("string"), r["hi"].cast("string"))).otherwise(r["lo"].cast("string"))
    return F.array_join(F.transform(runs, show), ",")


def citation_order(citations: DataFrame) -> DataFrame:
    """doc_id, key, number: keys of ``citations(doc_id, pos, key)`` numbered by first use within their document."""
    first = citations.groupBy("doc_id", "key").agg(F.min("pos").alias("first"))
    return first.select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "key")).alias("number"))


def year_suffixes(papers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, key, suffix (a, b, …) where two and more papers of a document share author label and year; titles in the language's order."""
    group = Window.partitionBy(doc, F.lower("author_label"), "pub_year")
    place = F.row_number().over(group.orderBy(F.collate("title", "UNICODE"), "key"))
    return papers.withColumn("n", F.count("*").over(group)).withColumn("suffix", F.char(96 + place)).where(F.col("n") > 1).select(doc, "key", "suffix")


def author_year_labels(citations: DataFrame, papers: DataFrame, suffixes: DataFrame) -> DataFrame:
    """doc_id, pos, label of every citation group in author-year style, e.g. (Lee et al., 2021; Smith, 2019b); unknown keys show as ?.

    ``papers`` has doc_id, key, author_label, pub_year; ``suffixes`` is :func:`year_suffixes`.
    """
    known = papers.join(suffixes, ["doc_id", "key"], "left").select("doc_id", "key", F.concat("author_label", F.lit(", "), _either(F.col("pub_year"), F.lit("n.d.")), F.coalesce("suffix", F.lit(""))).alias("name"))
    rows = citations.join(known, ["doc_id", "key"], "left").select("doc_id", "pos", F.coalesce("name", F.lit("?")).alias("name"))
    grouped = rows.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("low"), "name"))).alias("names"))
    return grouped.select("doc_id", "pos", F.concat(F.lit("("), F.array_join(F.transform("names", lambda x: x["name"]), "; "), F.lit(")")).alias("label"))


def cite_labels(citations: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, pos, label of every citation group in Vancouver style, e.g. [1,3–5]."""
    found = citations.join(order, ["doc_id", "key"]).groupBy("doc_id", "pos").agg(F.collect_set("number").alias("numbers"))
    return found.select("doc_id", "pos", F.concat(F.lit("["), number_runs(F.col("numbers")), F.lit("]")).alias("label"))
