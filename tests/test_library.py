"""Goldens of records, citations, lists, matrix, documents, exports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from litforge.core.graph import components
from litforge.functions import text as tx
from litforge.operators import citations, documents, library, trends
from litforge.sources import delimited, files, records, service
from litforge.streaming import runs

c = F.col

# Two records of a bibliographic service: one with inline markup and a structured abstract, one retracted and undated.
RECORDS = [
    """<PubmedArticle><MedlineCitation><PMID>111</PMID><Article><Journal><JournalIssue><Volume>388</Volume><Issue>2</Issue><PubDate><Year>2023</Year><Month>Jan</Month></PubDate></JournalIssue>
    <Title>The Journal of Examples</Title><ISOAbbreviation>J Ex</ISOAbbreviation></Journal><ArticleTitle>Drug in chronic kidney disease.</ArticleTitle><Pagination><MedlinePgn>117-127</MedlinePgn></Pagination>
    <Abstract><AbstractText Label="BACKGROUND">Inhibitors slow CKD.</AbstractText><AbstractText Label="RESULTS">Fewer events with <i>drug</i>.</AbstractText></Abstract>
    <AuthorList><Author><LastName>Herr</LastName><ForeName>William G</ForeName><Initials>WG</Initials></Author><Author><CollectiveName>KIDNEY Group</CollectiveName></Author></AuthorList>
    <PublicationTypeList><PublicationType>Journal Article</PublicationType><PublicationType>Randomized Controlled Trial</PublicationType></PublicationTypeList></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1056/example</ArticleId><ArticleId IdType="pmc">PMC999</ArticleId></ArticleIdList></PubmedData></PubmedArticle>""",
    """<PubmedArticle><MedlineCitation><PMID>222</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title>Example Journal</Title></Journal>
    <ArticleTitle>Metformin and eGFR.</ArticleTitle><AuthorList><Author><LastName>Smith</LastName><Initials>J</Initials></Author></AuthorList></Article>
    <CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"/></CommentsCorrectionsList></MedlineCitation></PubmedArticle>""",
]


@pytest.fixture(scope="module")
def articles(spark):
    rows = spark.createDataFrame([(x,) for x in [*RECORDS, "<broken>"]], "value string")
    return records.articles_from_xml(rows).orderBy("pmid")


def test_records(spark, articles):
    a, b = articles.collect()
    assert (a.pmid, a.title, a.journal, a.pub_year, a.pub_month, a.doi, a.pmcid, a.volume, a.issue, a.pages) == ("111", "Drug in chronic kidney disease.", "J Ex", "2023", "Jan", "10.1056/example", "PMC999", "388", "2", "117-127")
    assert a.abstract == "BACKGROUND: Inhibitors slow CKD.\nRESULTS: Fewer events with drug." and a.authors == ["Herr WG", "KIDNEY Group"] and not a.retracted
    assert (b.pub_year, b.abstract, b.journal, b.retracted) == ("2019", "", "Example Journal", True)
    rows = spark.createDataFrame([(x,) for x in [*RECORDS, "<broken>", None]], "value string")
    assert [r.value for r in records.malformed_xml(rows).collect()] == ["<broken>"]


def test_large_files_are_split_at_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>\n" + "\n".join(RECORDS) + "</PubmedArticleSet>")
    assert sorted(r.pmid for r in records.read_xml(spark, str(tmp_path)).collect()) == ["111", "222"]


def test_references(articles):
    a = articles.where("pmid = '111'")
    first = a.select(citations.vancouver().alias("v"), citations.apa().alias("a"), citations.ris().alias("r"), citations.bibtex().alias("b"), citations.csv_row().alias("c")).first()
    assert first.v == "Herr WG, KIDNEY Group. Drug in chronic kidney disease. J Ex. 2023 Jan;388(2):117-127. doi:10.1056/example. PMID: 111."
    assert first.a == "Herr, W. G., & KIDNEY Group (2023). Drug in chronic kidney disease. The Journal of Examples, 388(2), 117-127. https://doi.org/10.1056/example"
    assert "VL  - 388\r\nIS  - 2\r\nSP  - 117\r\nEP  - 127" in first.r and "AU  - Herr, William G\r\nAU  - KIDNEY Group" in first.r and first.r.rstrip().endswith("ER  -")
    assert first.b.startswith("@article{Herr2023_111,") and "author = {Herr, William G and {KIDNEY Group}}" in first.b and "pages = {117--127}" in first.b
    assert first.c.startswith("111,Drug in chronic kidney disease,Herr WG; KIDNEY Group,J Ex,2023,388,2,117-127,")
    listed = citations.reference_list(articles.withColumn("rank", c("pmid").cast("int"))).orderBy("by").collect()
    assert [r.number for r in listed] == ["1", "2"] and listed[1].reference == "Smith J. Metformin and eGFR. Example Journal. 2019. PMID: 222."


def test_numbers_of_skewed_places(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id") * F.col("id")).alias("k"))
    assert [r.place for r in citations.numbered(rows, "k").orderBy("k").collect()] == list(range(1, 1001))


def test_suffixes_and_author_year_labels(spark):
    rows = spark.createDataFrame([(1, "a", "Smith", "2020", "Beta study"), (1, "b", "Smith", "2020", "alpha study"), (1, "c", "Lee et al.", "2021", "Third")], "doc_id int, key string, author_label string, pub_year string, title string")
    found = citations.year_suffixes(rows)
    assert {r.key: r.suffix for r in found.collect()} == {"b": "a", "a": "b"}
    cites = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 9, "zz")], "doc_id int, pos int, key string")
    assert {r.pos: r.label for r in citations.author_year_labels(cites, rows, found).collect()} == {5: "(Lee et al., 2021; Smith, 2020b)", 9: "(?)"}


def test_number_runs(spark):
    cites = spark.createDataFrame([(1, p, k) for p, ks in enumerate(["b", "a", "ab", "bac", "db"]) for k in ks] + [(1, 0, "b"), (1, 3, "c")], "doc_id int, pos int, key string")
    order = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3), (1, "d", 4)], "doc_id int, key string, number int")
    assert [r.label for r in citations.cite_labels(cites, order).orderBy("pos").collect()] == ["[1]", "[2]", "[1,2]", "[1–3]", "[1,4]"]


# ---------------------------------------------------------------- other catalogues and the service


def test_inverted_index(spark):
    rows = spark.createDataFrame([({"Statins": [0], "reduce": [1], "risk": [2], "in": [3], "12000": [4], "patients": [5]},), ({"a": [0, 2], "b": [2]},), ({"b": [1], "7": [1]},), (None,)], "m map<string,array<int>>")
    assert [r.t for r in rows.select(records.abstract_from_index(c("m")).alias("t")).collect()] == ["Statins reduce risk in 12000 patients", "a b", "b", ""]


def test_identifier_lookup(spark, articles):
    dois = articles.where("doi IS NOT NULL").withColumn("doi", F.lit("10.1/x"))
    inputs = spark.createDataFrame([("PMID 111",), ("10.1/X",), ("10.9/none",), ("hello",), ("999999",)], "text string")
    # a DOI needs four digits after its first part
    inputs = inputs.replace("10.1/X", "10.1000/X").replace("10.9/none", "10.9000/none")
    found = {r.text: (r.found.pmid if r.found else None, r.error) for r in records.looked_up(inputs, dois.withColumn("doi", F.lit("10.1000/x")), articles).collect()}
    assert found["PMID 111"] == ("111", None) and found["10.1000/X"] == ("111", None)
    assert "no record for that DOI" in found["10.9000/none"][1] and "doesn't look like a DOI" in found["hello"][1] and found["999999"][1] == "PubMed has no record with PMID 999999."


def test_headings_links_and_spelling(spark):
    searches = spark.createDataFrame([("heart fail", json.dumps({"esearchresult": {"idlist": ["1", "3", "2"]}})), ("he", json.dumps({"esearchresult": {"idlist": ["1"]}}))], "key string, value string")
    answers = spark.createDataFrame([(json.dumps({"result": {"1": {"ds_meshterms": ["Heart Failure", "Cardiac Failure"]}, "2": {"ds_meshterms": ["Heart Failure, Diastolic"]}}}),)], "value string")
    assert [r.heading for r in records.heading_suggestions(searches, answers).orderBy("pos").collect()] == ["Heart Failure", "Heart Failure, Diastolic"]
    links = {"linksets": [{"linksetdbs": [{"linkname": "pubmed_pubmed_citedin", "links": ["5", "6"]}, {"linkname": "pubmed_pubmed", "links": ["111", "7"]}]}]}
    edges = records.link_edges(spark.createDataFrame([("111", json.dumps(links))], "pmid string, value string"))
    assert [r.dst for r in records.linked(edges, "111", "similar").collect()] == ["7"]
    assert [r.dst for r in records.linked(edges, "111", "citedBy").collect()] == ["5", "6"]
    rows = spark.createDataFrame([("diabtes", "diabetes"), ("diabetes", "Diabetes "), ("zzz", "")], "query string, corrected string")
    assert [r.suggestion for r in records.spelling(rows).collect()] == ["diabetes", None, None]


def test_search_source(spark):
    spark.dataSource.register(service.SearchSource)
    read = lambda query: spark.read.format("litforge_search").options(query=query, retmax="450", key="k", pause="0", opener="fake_service:answer").load()
    found = read("asthma").orderBy("rank").collect()
    assert len(found) == 449 and [r.pmid for r in found[:2]] == ["450", "449"] and found[0].title == "T450"
    with pytest.raises(Exception, match="Invalid query"):
        read("((").collect()


def test_requests_keep_their_distance(monkeypatch):
    slept = []
    monkeypatch.setattr(service.time, "sleep", slept.append)
    calls = service.Service({"opener": "fake_service:answer", "key": "k"})
    calls.search("x", 2, "relevance")
    calls.search("x", 2, "relevance")
    assert len(slept) == 1 and 0 < slept[0] <= service.PAUSE_WITH_KEY


# ---------------------------------------------------------------- pasted tables


def test_pasted_tables(spark):
    d = delimited.read_text(spark, 'age,sex,note\n40,M,"a, b"\n50,F,NA\n,F,x').orderBy("row_id")
    assert dict(d.dtypes)["age"] == "double" and [tuple(r)[1:] for r in d.collect()] == [(40.0, "M", "a, b"), (50.0, "F", None), (None, "F", "x")]
    assert [r.y for r in delimited.read_text(spark, "x\ty\n1\t2\n3\t4").orderBy("row_id").collect()] == [2.0, 4.0]
    assert [r.peso for r in delimited.read_text(spark, "peso;grupo\n70,5;A\n82,1;B").orderBy("row_id").collect()] == [70.5, 82.1]
    assert delimited.read_text(spark, "a,a\n1,2").columns == ["row_id", "a", "a (2)"]
    for bad in ("   ", "a,b"):
        with pytest.raises(ValueError, match="header"):
            delimited.read_text(spark, bad)
    rows = spark.createDataFrame([("1 234,5", True), ("12%", False), ("abc", False)], "x string, k boolean")
    assert [r.n for r in rows.select(F.when(c("k"), delimited.number(c("x"), True)).otherwise(delimited.number(c("x"), False)).alias("n")).collect()] == [1234.5, 12.0, None]


def test_files_keep_header_names_and_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,a,,b\n1,x,2,"q, r"\n\n3,y,4,z\n')
    found = delimited.read_file(spark, str(tmp_path / "t.csv"))
    assert found.columns == ["row_id", "a", "a (2)", "Column 3", "b"]
    assert [tuple(r)[1:] for r in found.orderBy("row_id").collect()] == [(1.0, "x", 2.0, "q, r"), (3.0, "y", 4.0, "z")]


# ---------------------------------------------------------------- lists and matrix

SAVED = "list_id string, key string, pos long, note string, added_at long"


def saved(spark, *rows):
    return spark.createDataFrame([(lst, key, i, "", i) for i, (lst, key) in enumerate(rows)], SAVED)


def keys(frame, list_id):
    return [r.key for r in frame.where(c("list_id") == list_id).orderBy("pos").collect()]


def test_lists(spark):
    lists = spark.createDataFrame([("default", "My reading list", 0, True)], "list_id string, name string, pos int, is_active boolean")
    two = library.created(library.created(lists, "l1", "Asthma"), "l2", " asthma ")
    assert [(r.name, r.is_active) for r in two.orderBy("pos").collect()] == [("My reading list", False), ("Asthma", False), ("asthma (2)", True)]
    assert [r.name for r in library.renamed(two, "l2", "   ").orderBy("pos").collect()][2] == "asthma (2)"
    taken = spark.createDataFrame([(0, "x"), (1, "x (2)"), (2, "X")], "pos int, name string")
    assert [r.name for r in library.unique_names(taken).orderBy("pos").collect()] == ["x", "x (2)", "X (3)"]
    active = library.with_active(two, "default").where("is_active").collect()
    assert [r.list_id for r in active] == ["default"]
    left, kept = library.without_list("l2", two, saved(spark, ("l2", "1"), ("l1", "2")))
    assert left.count() == 2 and keys(kept, "l1") == ["2"] and keys(kept, "l2") == []
    assert library.without_list("default", lists)[0].count() == 1
    assert {r.name: r.papers for r in library.list_counts(two, saved(spark, ("l1", "1"))).collect()} == {"My reading list": 0, "Asthma": 1, "asthma (2)": 0}


def test_toggle_copy_and_move(spark):
    rows = saved(spark, ("a", "7"), ("b", "8"))
    new = spark.createDataFrame([("a", "9", "", 5), ("a", "7", "", 5)], "list_id string, key string, note string, added_at long")
    assert keys(library.toggled(rows, new), "a") == ["9"]
    assert keys(library.added(rows, new), "a") == ["9", "7"]
    seven = spark.createDataFrame([("7",)], "key string")
    copied = library.copied(rows, "a", "b", seven)
    assert keys(copied, "b") == ["7", "8"] and keys(library.copied(copied, "a", "b", seven), "b") == ["7", "8"]
    moved = library.copied(copied, "a", "b", seven, move=True)  # out of the source even where the target has it
    assert keys(moved, "a") == [] and keys(moved, "b") == ["7", "8"]


def test_history(spark):
    shape = "state string, date int, total int, pmids array<string>"
    old = spark.createDataFrame([("asthma", 1, 10, ["1", "2"])], shape)
    assert [r.pmids for r in library.previous_run(old, "asthma").collect()] == [["1", "2"]] and library.previous_run(old, "x").count() == 0
    both = library.recorded(old, spark.createDataFrame([("asthma", 2, 12, ["3", "1"]), ("copd", 3, 5, ["9"])], shape))
    assert [(r.state, r.date) for r in both.collect()] == [("copd", 3), ("asthma", 2)]
    many = spark.range(40).select(c("id").cast("string").alias("state"), c("id").cast("int").alias("date"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("pmids"))
    assert library.recorded(old, many).count() == 30


@pytest.fixture(scope="module")
def papers(spark):
    base = spark.createDataFrame([("1", 0, "A study, with a comma.", "2019", ["Case Reports"], "Zed"), ("2", 1, "B", "2023", ["Meta-Analysis"], "Adams"), ("3", 2, "C", "2021", ["Journal Article"], "Moore")], "key string, pos int, title string, pub_year string, pub_types array<string>, last string")
    person = F.struct(c("last").alias("last_name"), F.lit("J").alias("fore_name"), F.lit("J").alias("initials"), F.lit("").alias("collective"))
    return base.select(
        "*", F.array(person).alias("authors_full"), F.array(F.concat("last", F.lit(" J"))).alias("authors"), F.lit("J Test").alias("journal"), c("key").alias("pmid"), F.lit(None).cast("string").alias("doi"),
        F.when(c("key") != "2", "text").otherwise("").alias("abstract"), (c("key") == "3").alias("retracted"), F.lit("").alias("journal_title"), F.lit("").alias("source_id"),
    )


@pytest.fixture(scope="module")
def decisions(spark):
    return spark.createDataFrame([("1", "exclude"), ("2", "include")], "key string, decision string")


def test_matrix(spark, papers, decisions):
    order = lambda sort, keep="all": [r.key for r in library.matrix_rows(papers, decisions, sort, keep).orderBy("order1", "order2").collect()]
    assert order("added") == ["1", "2", "3"] and order("year-desc") == ["2", "3", "1"] and order("author") == ["2", "3", "1"]
    assert order("evidence") == ["2", "1", "3"] and order("decision") == ["2", "3", "1"] and order("added", "include") == ["2"] and order("added", "none") == ["3"]
    assert library.decision_counts(papers, decisions).first().asDict() == {"include": 1, "unsure": 0, "undecided": 1, "exclude": 1}
    cells = spark.createDataFrame([("1", "finding", 'Said "yes"\nand more'), ("1", "design", "Case report")], "key string, col_id string, value string")
    table = library.matrix_table(papers.where("key = '1'"), cells, decisions, [("design", "Study design"), ("finding", "Key finding")])
    head, line = (r.line for r in library.matrix_lines(table).orderBy("pos").collect())
    assert head.startswith("﻿Study,Title,Journal,Year,PMID,DOI,Evidence level,Decision,Study design")
    assert '"A study, with a comma"' in line and '"Said ""yes""\nand more"' in line and "Case report,Exclude" in line
    assert "Said \"yes\" and more" in [r.line for r in library.matrix_lines(table, "\t").orderBy("pos").collect()][1]


def test_columns_and_suggestions(spark):
    labels = spark.createDataFrame([(0, "Funding source"), (1, "Funding source"), (2, "???")], "pos int, label string")
    assert [r.col_id for r in library.column_ids(labels).orderBy("pos").collect()] == ["funding-source", "funding-source-2", "column"]
    assert library.default_columns(spark.createDataFrame([("x",)], "list_id string")).count() == 7
    rows = spark.createDataFrame([("1", "T", "A randomized trial of 80 patients.", ["Randomized Controlled Trial"])], "key string, title string, abstract string, pub_types array<string>")
    cells = spark.createDataFrame([("1", "design", "My own text")], "key string, col_id string, value string")
    columns = spark.createDataFrame(library.DEFAULT_COLUMNS, "col_id string, label string")
    filled = library.with_suggestions(cells, library.suggestions(rows), columns)
    assert {r.col_id: (r.value, r.filled) for r in filled.collect()} == {"design": ("My own text", False), "size": ("80 patients", True)}
    again = library.with_suggestions(filled.select("key", "col_id", "value"), library.suggestions(rows), columns)
    assert again.where("filled").count() == 0
    assert [r.label for r in library.relabelled(columns, "size", "  ").where("col_id = 'size'").collect()] == ["Sample size"]


def test_overview(spark, papers):
    decisions = spark.createDataFrame([("1", "include")], "key string, decision string")
    notes = spark.createDataFrame([("1", "note")], "key string, note string")
    rows = trends.overview(papers, spark.createDataFrame([], "key string, design string"), decisions, notes)
    found = {(r.group, r.label): r.papers for r in rows.collect()}
    assert found["totals", "total"] == 3 and found["totals", "with_abstract"] == 2 and found["totals", "retracted"] == 1 and found["totals", "with_notes"] == 1
    assert found["decisions", "include"] == 1 and found["authors", "Zed"] == 1 and found["years", "2020"] == 0 and found["totals", "median_year"] == 2021
    lines = [r.line for r in trends.overview_lines(rows).orderBy("ord1", "ord2", F.desc("papers"), "label").collect()]
    assert lines[0] == "group,label,papers" and lines[1] == 'Year,"2019",1'


def test_orders_and_counts(spark):
    rows = spark.createDataFrame([(0, "1", ["Case Reports"], "2024"), (1, "2", ["Meta-Analysis"], "2018"), (2, "3", ["Randomized Controlled Trial"], "2021")], "rank int, pmid string, pub_types array<string>, pub_year string")
    cites = spark.createDataFrame([("3", 90), ("1", 5)], "pmid string, citations long")
    ids = lambda order, metrics=None: [r.pmid for r in trends.order_articles(rows, order, metrics).collect()]
    assert (ids("evidence"), ids("newest"), ids("citations", cites), ids("pubmed")) == (["2", "3", "1"], ["1", "3", "2"], ["3", "1", "2"], ["1", "2", "3"])
    assert [(r.rank, r.papers) for r in trends.evidence_mix(rows).orderBy("rank").collect()] == [(1, 1), (3, 1), (7, 1)]
    years = spark.createDataFrame([("2020",), ("2022",), ("2022",), ("",)], "pub_year string")
    assert [(r.year, r.papers) for r in trends.year_counts(years).orderBy("year").collect()] == [(2020, 1), (2021, 0), (2022, 2)]
    assert trends.year_counts(years.limit(0)).count() == 0
    assert trends.counts_by_year(years, 2022).count() == 25


def test_keys_of_papers(spark):
    rows = spark.createDataFrame([("5", None, None, "T"), ("", "10.1/AB", None, "T"), ("", None, "oa:W1", "T"), (None, "", "", "A  Title: x")], "pmid string, doi string, source_id string, title string")
    assert [r.k for r in rows.select(tx.article_key().alias("k")).collect()] == ["5", "doi:10.1/ab", "oa:W1", "title:a title x"]


# ---------------------------------------------------------------- documents and kept state


def node(kind, *content, **more):
    return {"type": kind, **({"content": list(content)} if content else {}), **more}


def words(text, *marks):
    return {"type": "text", "text": text, "marks": [{"type": m} if isinstance(m, str) else m for m in marks]}


def cite(*found):
    return {"type": "citation", "attrs": {"keys": list(found)}}


DOC = node(
    "doc", node("heading", words("Introduction"), attrs={"level": 1}),
    node("paragraph", words("It slows "), cite("222"), words(" and "), words("matters", "bold"), words(" "), cite("111", "222")),
    node("bulletList", node("listItem", node("paragraph", words("First point "))), node("listItem", node("paragraph", words("Second & more "), cite("333")))),
    node("orderedList", node("listItem", node("paragraph", words("Step one")))), node("blockquote", node("paragraph", words("A quote"))),
    node("paragraph", words("the site", {"type": "link", "attrs": {"href": "https://example.org/a_b"}})),
)
REFS = [
    {"key": "111", "name": "Herr2023_111", "label": "Herr & Baker, 2023", "reference": "Herr W, Baker A. Drug."},
    {"key": "222", "name": "Smith2019_222", "label": "Smith, 2019", "reference": "Smith J. Metformin and eGFR."},
]


def test_documents(spark):
    assert documents.citation_keys(DOC) == ["222", "111", "333"]
    text = json.dumps(DOC)
    md = documents.render(text, "My review", "markdown", refs=REFS)
    for part in ("# My review", "# Introduction", "It slows [1] and **matters** [1,2]", "- First point \n- Second & more [3]", "1. Step one", "> A quote", "[the site](https://example.org/a_b)", "## References\n\n1. Smith J. Metformin"):
        assert part in md
    assert documents.MISSING in md
    tex = documents.render(text, "My review", "latex", refs=REFS)
    for part in (r"\title{My review}", r"\section{Introduction}", r"\cite{Smith2019_222}", r"\cite{Herr2023_111,Smith2019_222}", r"\begin{thebibliography}{9}", r"Second \& more", r"\href{https://example.org/a_b}{the site}"):
        assert part in tex
    assert "natbib" not in tex and documents.tex_escape("50% of #1_a") == r"50\% of \#1\_a"
    apa = documents.render(text, "", "latex", "apa", REFS)
    assert r"\usepackage[round]{natbib}" in apa and r"\citep{Smith2019_222}" in apa and r"\bibitem[Herr \& Baker(2023)]{Herr2023_111}" in apa
    page = documents.render(text, "", "html", refs=REFS)
    assert '<span class="cite">[1]</span>' in page and "<strong>matters</strong>" in page and "<h2>References</h2>" in page
    assert "&lt;script&gt;" in documents.render(json.dumps(node("doc", node("paragraph", words("<script>x</script>")))), "", "html")
    assert documents.words(DOC) > 10
    rows = spark.createDataFrame([(1, "T", text, "vancouver", None), (2, "T", None, "vancouver", None)], "id int, title string, json string, style string, refs array<struct<key:string,name:string,label:string,reference:string>>")
    assert [r.id for r in documents.render_table(rows, "markdown").collect()] == [1]


def test_templates():
    assert [t["id"] for t in documents.templates()] == ["blank", "article", "case", "review"]
    headings = lambda key: [n["content"][0]["text"] for n in documents.template(key)["content"] if n["type"] == "heading"]
    assert headings("article") == ["Abstract", "Introduction", "Methods", "Results", "Discussion", "Conclusion"]
    assert "Informed consent" in headings("case") and "Search strategy" in headings("review") and headings("blank") == []


def test_document_store(spark):
    docs = spark.createDataFrame([("a", "First", 1), ("b", "Second", 2)], "id string, title string, updated_at int")
    docs = library.upserted(docs, spark.createDataFrame([("a", "First (edited)", 3)], docs.schema), ["id"], "updated_at")
    assert [r.title for r in library.newest_first(docs).collect()] == ["First (edited)", "Second"]
    pointer = spark.createDataFrame([("b",)], "id string")
    assert [r.id for r in library.last_opened(docs, pointer).collect()] == ["b"]
    docs, pointer = library.without_document(docs, pointer, "b")
    assert library.last_opened(docs, pointer).count() == 0 and pointer.count() == 0 and docs.count() == 1


def test_kept_files(spark, tmp_path, articles):
    assert files.write_state(articles, str(tmp_path / "kept")) is True
    (tmp_path / "file").write_text("x")
    assert files.write_state(articles, str(tmp_path / "file" / "below")) is False
    (tmp_path / "s.json").write_text('{"id": "a"}\nnot json\n')
    assert [r.id for r in files.read_state(spark, str(tmp_path / "s.json"), "id string").collect()] == ["a"]
    assert files.read_state(spark, str(tmp_path / "none.json"), "id string").count() == 0
    lists, kept = files.migrated_lists(spark.createDataFrame([("5", 0, "old", "2025-01-01")], "key string, pos int, note string, added_at string"))
    assert lists.first().name == "My reading list" and kept.first().list_id == "default"
    settings = files.with_defaults(spark.createDataFrame([(0.7,)], "threshold double"), {"threshold": 0.5, "findings": True, "detectors": ["disease", "drug"]}).first()
    assert (settings.threshold, settings.findings, settings.detectors) == (0.7, True, ["disease", "drug"])
    cited = spark.createDataFrame([("111",), ("111",), ("999",)], "key string")
    files.write_cited(cited, articles.withColumn("key", c("pmid")), str(tmp_path / "refs"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "refs").glob("part-*"))).count("@article{") == 1


# ---------------------------------------------------------------- streams and graphs


def test_new_papers_of_a_stream(spark, tmp_path):
    source, kept = tmp_path / "in", tmp_path / "kept"
    source.mkdir()
    (source / "1.json").write_text('{"pmid": "1"}\n{"pmid": "2"}\n{"pmid": "1"}\n')
    run = lambda: spark.readStream.schema("pmid string").json(str(source)).writeStream.foreachBatch(lambda b, _: runs.keep_new(b, str(kept))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    (source / "2.json").write_text('{"pmid": "2"}\n{"pmid": "3"}\n')
    run()
    assert sorted(r.pmid for r in spark.read.parquet(str(kept)).collect()) == ["1", "2", "3"]


def test_windows_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"ts": "2024-01-01T00:10:00", "kind": "a", "value": 1.0}\n{"ts": "2024-01-01T23:00:00", "kind": "a", "value": 2.0}\n')
    (source / "2.json").write_text('{"ts": "2024-01-03T00:00:00", "kind": "a", "value": 4.0}\n')
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).json(str(source))
    query = runs.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((str(r.start)[:10], r.n, r.total) for r in spark.table("windows").collect()) == [("2024-01-01", 2, 3.0), ("2024-01-03", 1, 4.0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
