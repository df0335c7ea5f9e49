"""Scalar column functions on text and on bibliographic records. All stay inside whole-stage code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from litforge.core.text import bind, normal_form
from litforge.data import load

#: White space as the records' origin defines it: ASCII white space, every separator, the byte-order mark.
WS = r"[\s\p{Z}\x{FEFF}]"
NOT_LETTER_DIGIT = r"[^\p{L}\p{N}]+"

# Strength of evidence, strongest first, with the publication types of each level (whole value, any case).
LEVELS = [
    (1, "synthesis", "Meta-analysis / systematic review", ["meta-analysis", "systematic review", "network meta-analysis"]),
    (2, "guideline", "Guideline", ["practice guideline", "guideline", "consensus development conference", "consensus development conference, nih"]),
    (3, "rct", "Randomized trial", ["randomized controlled trial", "equivalence trial", "pragmatic clinical trial", "clinical trial, phase iii", "clinical trial, phase iv"]),
    (4, "trial", "Clinical trial", ["clinical trial", "controlled clinical trial", "clinical trial, phase i", "clinical trial, phase ii", "clinical trial protocol", "adaptive clinical trial"]),
    (5, "observational", "Observational study", ["observational study", "comparative study", "multicenter study", "validation study", "evaluation study", "twin study", "cohort studies"]),
    (6, "review", "Review", ["review", "scoping review", "systematic review protocol"]),
    (7, "case", "Case report", ["case reports"]),
    (8, "opinion", "Editorial / letter", ["editorial", "comment", "letter", "news", "interview", "personal narrative"]),
    (9, "other", "Other article", []),
]
# Category of a detector label, the first pattern found in the upper-cased label wins; then display order and names.
CATEGORY_RULES = [
    ("FINDING|SIGN|SYMPTOM", "finding"),
    ("DISEASE|CONDITION|PATHOLOGY|CANCER", "condition"),
    ("CHEM|DRUG", "drug"),
    ("GENE|PROTEIN|DNA|RNA", "gene"),
    ("ORGAN(?!ISM)|TISSUE|ANATOMY", "anatomy"),
    ("ORGANISM|SPECIES", "organism"),
    ("CELL", "cell"),
]
CATEGORIES = [
    ("condition", "Condition"), ("finding", "Sign / symptom"), ("drug", "Drug / chemical"), ("gene", "Gene / protein"),
    ("anatomy", "Anatomy"), ("cell", "Cell"), ("organism", "Organism"), ("other", "Other"),
]

def squeeze(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def truthy(text: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def given(text: Column) -> Column:
    """The text, null if it is empty, for use in ``concat_ws`` and ``coalesce``."""
    return F.nullif(text, F.lit(""))


def strip_period(text: Column) -> Column:
    """Without one period at the end and the white space after it."""
    return F.regexp_replace(text, rf"\.{WS}*\z", "")


def normalize_term(term: Column) -> Column:
    return normal_form(term)


def singularize(term: Column) -> Column:
    """Singular form of the last word; short words and words on -ss, -us, -is and the like stay."""
    last = F.regexp_extract(term, r"(\p{L}+)\z", 1)
    head = F.substring(term, F.lit(1), F.length(term) - F.length(last))
    cut = lambda n, more="": F.concat(head, F.left(last, F.length(last) - n), F.lit(more))
    low = F.lower(last)
    kept = low.rlike(r"(?:ss|us|is|as|os|ys|es)\z") | (F.length(last) <= 4)
    return (
        F.when(last == "", term)
        .when(kept & low.endswith("ies") & (F.length(last) > 5), cut(3, "y"))
        .when(kept & low.rlike(r"(?:ches|shes|xes)\z"), cut(2))
        .when(~kept & low.endswith("s"), cut(1))
        .otherwise(term)
    )


def is_abbreviation(term: Column) -> Column:
    return term.rlike(r"^[A-Z0-9-]{2,10}s?\z")


def category_for(label: Column) -> Column:
    """Category of a detector label."""
    low = F.upper(label)
    first, *rest = CATEGORY_RULES
    return reduce(lambda c, r: c.when(low.rlike(r[0]), r[1]), rest, F.when(low.rlike(first[0]), first[1])).otherwise("other")


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k, _ in CATEGORIES]), category).cast("int")


def category_label(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES for x in pair]), category)


def evidence_rank(pub_types: Column) -> Column:
    """Rank 1 to 9 of the strongest publication type, 9 if there is none that counts."""
    ranks = F.create_map(*[F.lit(x) for rank, _, _, types in LEVELS for t in types for x in (t, rank)])
    return F.coalesce(F.array_min(F.transform(pub_types, lambda t: F.element_at(ranks, F.lower(strip(t))))), F.lit(9))


def level_name(rank: Column, which: int = 1) -> Column:
    """Key (which=1) or label (which=2) of an evidence rank."""
    return F.element_at(F.create_map(*[F.lit(x) for level in LEVELS for x in (level[0], level[which])]), rank)


def is_preprint(pub_types: Column) -> Column:
    return F.coalesce(F.exists(pub_types, lambda t: F.lower(t) == "preprint"), F.lit(False))


def article_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("abstract", F.lit("")))


def article_key() -> Column:
    """Primary key of a record: pmid, else DOI, else source id, else the first 80 characters of the normalised title."""
    title = F.left(F.trim(F.regexp_replace(F.lower("title"), NOT_LETTER_DIGIT, " ")), F.lit(80))
    return F.coalesce(given(F.col("pmid")), F.when(truthy(F.col("doi")), F.concat(F.lit("doi:"), F.lower("doi"))), given(F.col("source_id")), F.concat(F.lit("title:"), title))


def _phrase(text: Column, words: list[str]) -> Column:
    """Whether one of some phrases stands in a text as whole words."""
    return reduce(lambda a, b: a | b, [F.concat(F.lit(" "), F.regexp_replace(text, r"[^a-z0-9_]+", " "), F.lit(" ")).contains(f" {w} ") for w in words])


def _direction(text: Column) -> Column:
    """ "Prospective" or "Retrospective" with "cohort study" or "study": the first such word that a cohort within 40 characters
    of its sentence, or the words study or analysis, follow; null if there is none."""
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(r"\b((?:pro|retro)spective)\b"), 1), F.regexp_extract_all(text, F.lit(r"\b(?:pro|retro)spective\b(?=([^.]{0,47}))"), 1),
        lambda word, after: F.struct(word.alias("word"), after.alias("after")),
    )
    cohort = lambda x: F.regexp_extract(x["after"], r"^(.{0,40}?)\bcohort\b", 0) != ""
    plain = lambda x: F.regexp_extract(x["after"], r"^\s+(?:observational\s+)?(study|analysis)\b", 1) != ""
    first = F.get(F.filter(found, lambda x: cohort(x) | plain(x)), F.lit(0))
    return bind(first, lambda x: F.concat(F.initcap(x["word"]), F.when(cohort(x), " cohort study").otherwise(" study")))


def study_design(rules: list[dict] | None = None) -> Column:
    """Design suggested by publication types, title and text; empty if nothing tells. The first of ``rules`` that fits counts.

    A rule names its design and what tells it: ``types`` (whole publication types), ``title`` (in the title), ``text`` (in title
    or abstract), ``words`` (the same, as whole words); the rule "direction of time" finds pro- and retrospective studies.
    """
    types, title, text = F.transform("pub_types", lambda t: F.lower(t)), F.lower("title"), F.lower(article_text())
    found = []
    for rule in load("study_designs") if rules is None else rules:
        if "rule" in rule:
            found.append(_direction(text))
            continue
        tests = [F.array_contains(types, t) for t in rule.get("types", ())] + [title.contains(t) for t in rule.get("title", ())] + [text.contains(t) for t in rule.get("text", ())]
        tests += [_phrase(text, rule["words"])] if "words" in rule else []
        found.append(F.when(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), rule["design"]))
    return F.coalesce(*found, F.lit(""))


def _counted(text: Column, digits: str, words: list[str], adjectives: list[str], most: int) -> Column:
    """struct(number, word) of the first number that ``words`` follow, with up to ``most`` of ``adjectives`` between; else null.

    Numbers are found first, then the five words after each are read one by one: adjectives (one may be two words) are
    passed, and what comes then must be one of ``words``.
    """
    at = rf"\b({digits})\s+(?=((?:\S+\s*){{1,5}}))"
    pairs = [a for a in adjectives if " " in a]
    single = [a for a in adjectives if " " not in a]
    read = F.zip_with(
        F.regexp_extract_all(text, F.lit(at), 1), F.regexp_extract_all(text, F.lit(at), 2), lambda number, after: F.struct(number.alias("number"), F.split(F.lower(after), r"\s+").alias("w"))
    )
    step = lambda w, i: F.when(F.get(w, i).isin(*single), i + 1).when(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)).isin(*pairs), i + 2).otherwise(i)
    noun = lambda w, i: F.regexp_extract(F.get(w, i), r"^([a-z]+)(?![a-z0-9_])", 1)

    listed = lambda word: F.when(word.isin(*words), word)

    def word(w: Column, i: Column, left: int) -> Column:
        here = bind(noun(w, i), listed)
        return here if left == 0 else F.coalesce(here, bind(step(w, i), lambda j: word(w, j, left - 1)))

    named = F.transform(read, lambda x: F.struct(x["number"].alias("number"), word(x["w"], F.lit(0), most).alias("word")))
    return F.get(F.filter(named, lambda x: x["word"].isNotNull()), F.lit(0))


def sample_size() -> Column:
    """Sample size as the text states it ("n = 80", "312 patients", "24 trials"); empty if it states none."""
    lists, text = load("sample_words"), article_text()
    n = F.regexp_extract(text, r"\b[nN]\s*=\s*(\d[\d,]*)", 1)
    people = _counted(text, r"\d[\d,]{1,9}", lists["people"], lists["adjectives"], 2)
    studies = _counted(text, r"\d{1,4}", lists["studies"], lists["study adjectives"], 1)
    case = F.coalesce(F.exists("pub_types", lambda t: F.lower(t) == "case reports"), F.lit(False))
    shown = lambda found: bind(found, lambda x: F.concat(x["number"], F.lit(" "), x["word"]))
    # a bare year before people is none of them
    persons = bind(people, lambda x: F.when(~(F.length(x["number"]).eqNullSafe(4) & x["number"].try_cast("int").between(1900, 2099)), F.concat(x["number"], F.lit(" "), x["word"])))
    return F.coalesce(bind(n, lambda x: F.when(x != "", F.concat(F.lit("n = "), x))), persons, shown(studies), F.when(case, "1 patient"), F.lit(""))


def participants(size: Column) -> Column:
    """Number of people in a stated sample size; null where it counts studies or states nothing."""
    digits = lambda s: F.regexp_replace(F.regexp_extract(s, r"(\d[\d,]*)", 1), ",", "")
    counts = lambda s: reduce(lambda a, b: a | b, [F.lower(s).contains(w) for w in load("sample_words")["studies"]])
    return bind(size, lambda s: F.when((s != "") & ~counts(s), digits(s).try_cast("long")))


def _digits(text: Column, least: int) -> Column:
    """The text if it is a number of ``least`` to 9 digits, else null."""
    return F.when(F.length(text).between(least, 9) & (F.translate(text, "0123456789", "") == ""), text)


def identifier(text: Column) -> Column:
    """struct(kind, value) of a pasted DOI or PubMed id, null if it is neither.

    A DOI may stand anywhere and ends at white space, a quote or an angle bracket, closing punctuation left out; a PubMed id is
    labelled, stands alone, or follows the host of its page.
    """
    text = F.lower(strip(text))
    doi = F.rtrim(F.regexp_extract(F.translate(text, "\"<>", "   "), r"\b(10\.\d{4,9}/\S+)", 1), F.lit(".,;)]"))
    label = F.when(text.startswith("pmid"), F.ltrim(F.regexp_replace(F.substring(text, 5, 100), "^:", "")))
    page = F.regexp_extract(F.substring_index(text, "pubmed.ncbi.nlm.nih.gov/", -1), r"^(\d{1,9})", 1)
    url = F.when(text.contains("pubmed.ncbi.nlm.nih.gov/"), given(page))
    pmid = F.coalesce(_digits(label, 1), _digits(text, 4), url)
    make = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(doi != "", make("doi", doi)).when(pmid.isNotNull(), make("pmid", pmid))


def looks_romanian(query: Column) -> Column:
    """Whether a query has a letter of Romanian or one of its small words."""
    hints = load("romanian_hints")
    letters = F.length(F.translate(query, hints["letters"], "")) < F.length(query)
    return letters | F.arrays_overlap(F.split(F.lower(query), r"[^\p{L}]+"), F.array(*[F.lit(w) for w in hints["words"]]))


def paper_url() -> Column:
    return (
        F.when(truthy(F.col("pmid")), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/")))
        .when(truthy(F.col("doi")), F.concat(F.lit("https://doi.org/"), F.col("doi")))
        .otherwise("")
    )


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/?term="), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


def fold_table() -> tuple[str, str]:
    """Letters with marks and their base letters, by rule from the Unicode data."""
    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in range(0xC0, 0x2000)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_marks(text: Column) -> Column:
    """Letters without their marks (the decomposed form without combining characters)."""
    return F.regexp_replace(F.translate(text, *fold_table()), r"[̀-ͯ]", "")


def file_slug(text: Column, fallback: str = "document") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(fold_marks(text)), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.coalesce(given(F.regexp_replace(F.left(slug, F.lit(60)), r"-+\z", "")), F.lit(fallback))


def csv_cell(value: Column) -> Column:
    """A cell, in quotes only where it holds a comma, a quote or a line feed."""
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def bib_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([{}&%$#_])", r"\\$1")


def html_escape(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def current_phrase(query: Column) -> Column:
    """What is being typed: the part after the last connective or comma."""
    return strip(F.element_at(F.split(query, r"(?:\s(?:AND|OR|NOT)\s|,)"), -1))


def highlight(text: Column, spans: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Text with marks around spans (array of struct start, end); spans that start inside an earlier one are left out."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    fits = lambda a, s: (s["start"] >= a["at"]) & (s["end"] <= F.length(text))
    piece = lambda a, s: F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(before), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(after))
    step = lambda a, s: F.when(fits(a, s), F.struct(piece(a, s).alias("out"), s["end"].alias("at"))).otherwise(a)
    done = F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))), empty, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def marked_card(entities: Column) -> Column:
    """struct(title, abstract) of a record with its entities marked; an entity belongs to the part that it lies in whole.

    ``entities`` is array<struct<start, end>> with offsets into title, line feed and abstract.
    """
    size = F.length("title")
    title = highlight(F.col("title"), F.filter(entities, lambda e: e["end"] <= size))
    moved = F.transform(F.filter(entities, lambda e: e["start"] > size), lambda e: F.struct((e["start"] - size - 1).alias("start"), (e["end"] - size - 1).alias("end")))
    return F.struct(title.alias("title"), highlight(F.coalesce("abstract", F.lit("")), moved).alias("abstract"))


def short_authors(authors: Column) -> Column:
    """Authors in a row; of more than four the first three and the last."""
    return F.when(F.size(authors) > 4, F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.lit(", … "), F.element_at(authors, -1))).otherwise(F.array_join(authors, ", "))


# ---------------------------------------------------------------- numbers as shown to people


def shown_number(value: Column, digits: int = 2) -> Column:
    """A number with at most ``digits`` decimals and thousands separated, in powers of ten if it is too small for that, "–" if there is none."""
    value = value.cast("double")
    none = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    small = (value != 0) & (F.abs(value) < 10.0**-digits)
    power = F.regexp_replace(F.format_string("%.1e", value), r"e([+-])0+(?=\d)", "e$1")
    plain = F.call_function("format_number", F.round(value, digits), F.lit("#,##0." + "#" * digits if digits else "#,##0"))
    return F.when(none, "–").when(small, power).otherwise(plain)


def shown_p(p: Column, name: bool = False) -> Column:
    """A p-value with three decimals, "< 0.001" below; with ``name`` as an equation."""
    p = p.cast("double")
    none, low = p.isNull() | F.isnan(p), p < 0.001
    value = F.format_string("%.3f", p)
    if name:
        return F.when(none, "p = –").when(low, "p < 0.001").otherwise(F.concat(F.lit("p = "), value))
    return F.when(none, "–").when(low, "< 0.001").otherwise(value)


def shown_percent(share: Column, digits: int = 1) -> Column:
    share = share.cast("double")
    return F.when(share.isNull() | F.isnan(share), "–").otherwise(F.concat(F.format_string(f"%.{digits}f", share * 100), F.lit("%")))


def shown_interval(value: Column, lo: Column, hi: Column, digits: int = 2) -> Column:
    return F.concat(shown_number(value, digits), F.lit(" ("), shown_number(lo, digits), F.lit(" to "), shown_number(hi, digits), F.lit(")"))


def typed_count(text: Column) -> Column:
    """A typed count with white space left out, null if it is no number."""
    return F.regexp_replace(text, WS + "+", "").try_cast("double")
