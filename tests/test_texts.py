"""Goldens of the text functions, spans, terms and effects."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litforge.functions import text as tx
from litforge.operators import effects, search, spans, terms

c = F.col


def column(spark, make, *texts):
    """What a column function makes of some texts, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in rows.select("i", make(c("x")).alias("y")).orderBy("i").collect()]


def papers(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, abstract string, pub_types array<string>").orderBy("i")


# ---------------------------------------------------------------- spans


def test_short_text_is_one_chunk():
    assert spans.chunks("short note") == [(0, "short note")]


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="abc .;\n", max_size=400), st.integers(5, 60))
def test_chunks_are_pieces_of_the_text(text, most):
    found = spans.chunks(text, most)
    assert all(text[at : at + len(piece)] == piece and len(piece) <= most for at, piece in found)
    # what is left out between pieces is blank
    at = 0
    for start, piece in found:
        assert not text[at:start].strip()
        at = start + len(piece)
    assert not text[at:].strip()


def test_chunks_end_at_sentences():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    found = spans.chunks(text, 200)
    assert len(found) > 5 and "".join(p for _, p in found) == text and found[0][1].rstrip().endswith(".")


def test_spans_are_trimmed_and_given_categories():
    text = "Started (metformin), for type 2 diabetes."
    found = spans.resolve(text, [(8, 20, "CHEM", 0.9), (25, 41, "DISEASE", 0.95)])
    assert [(e[4], e[5]) for e in found] == [("metformin", "drug"), ("type 2 diabetes", "condition")]
    overlap = spans.resolve(text, [(25, 40, "DISEASE", 0.95), (32, 40, "CHEM", 0.4)])
    assert [e[2] for e in overlap] == ["DISEASE"]


def test_fragments_become_words():
    text = "Examination: no signs of meningeal irritation."
    at = text.index("meningeal")
    found = spans.resolve(text, [(at, at + 3, "DISEASE", 0.8), (at + 8, at + 20, "DISEASE", 0.7)])
    assert [(e[4], e[6]) for e in found] == [("meningeal irritation", True)]
    apart = spans.resolve("metformin, asthma", [(0, 9, "CHEM", 1.0), (11, 17, "DISEASE", 1.0)])
    assert [e[4] for e in apart] == ["metformin", "asthma"]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 38), st.integers(1, 12), st.sampled_from(["CHEM", "DISEASE"]), st.sampled_from([None, 0.2, 0.5, 0.9])), max_size=12))
def test_resolved_spans_never_overlap(raw):
    text = "alpha beta gamma-delta, epsilon (zeta) eta theta."
    found = spans.resolve(text, [(s, min(s + n, len(text)), label, score) for s, n, label, score in raw])
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(text[e[0] : e[1]] == e[4] and len(e[4]) >= 2 for e in found)


@pytest.mark.parametrize(
    ("text", "term", "expected"),
    [
        ("Patient denies chest pain.", "chest pain", True),
        ("Negative for C. difficile toxin.", "difficile", True),
        ("Pulmonary embolism was ruled out.", "Pulmonary embolism", True),
        ("Fără semne de iritație meningeană.", "iritație meningeană", True),
        ("Known type 2 diabetes. No fever.", "type 2 diabetes", False),
        ("Pneumonia, improved without complications.", "Pneumonia", False),
    ],
)
def test_negation(text, term, expected):
    at = text.index(term)
    assert spans.negated(text, at, at + len(term)) is expected


def findings(text):
    found = spans.resolve(text, spans.rule_findings()(text))
    return [e[4].lower() for e in found if not e[6]], [e[4].lower() for e in found if e[6]]


def test_signs_and_symptoms():
    text = "Underweight nutritional status. Hyperpigmented skin; pale mucous membranes, mildly dehydrated. Reduced subcutaneous fat, no rales, no murmurs, no oedema. Soft, non-tender. Liver 2 cm below the right costal margin and spleen non-palpable. No costovertebral angle tenderness; no signs of meningeal irritation."
    seen, denied = findings(text)
    assert seen == ["underweight nutritional status", "hyperpigmented skin", "pale mucous membranes", "mildly dehydrated", "reduced subcutaneous fat", "liver 2 cm below the right costal margin"]
    assert denied == ["rales", "murmurs", "oedema", "costovertebral angle tenderness", "meningeal irritation"]
    assert findings("Headache, dizziness, palpitations and leg oedema, without fever.") == (["headache", "dizziness", "palpitations", "leg oedema"], ["fever"])
    seen, _ = findings("Dyspnoea on exertion, productive cough and hemoptysis. Bilateral pitting edema, palpable cervical lymphadenopathy, slurred speech and left hemiparesis. Discharged home. The results fit the diagnosis.")
    assert seen == ["dyspnoea on exertion", "productive cough", "hemoptysis", "bilateral pitting edema", "palpable cervical lymphadenopathy", "slurred speech", "hemiparesis"]
    assert len(spans.signs_and_symptoms()) > 400


def test_detectors_and_models():
    assert [x["key"] for x in spans.detectors()] == ["disease", "drug"]
    assert [x["key"] for x in spans.detectors(["species", "gene"])] == ["gene", "species"]
    assert spans.model_id(spans.detectors()[0], "fast", "x/{family}-{size}") == "x/DiseaseDetect-33M"


def test_tagging_rebases_chunks_and_drops_low_scores(spark):
    class Lengths:
        """Marks the word asthma and remembers nothing; a piece never is longer than allowed."""

        def __call__(self, text):
            assert len(text) <= 50
            return [(m, m + 6, "DISEASE", 0.9) for m in [text.find("asthma")] if m >= 0] + [(0, 3, "CHEM", 0.1)]

    text = "Nothing of note is here at all. " * 3 + "Then asthma came. Fever too."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    rows = spans.tag(docs, [Lengths()], "doc_id", threshold=0.5, rules=[spans.rule_findings()], most=50).collect()
    assert [(r.doc_id, text[r.start_pos : r.end_pos], r.category) for r in rows] == [(1, "asthma", "condition"), (1, "Fever", "finding")]


# ---------------------------------------------------------------- terms


def entities(spark, *rows):
    full = [(i, doc, i, text, category, negated) for i, (doc, text, category, negated) in enumerate(rows)]
    return spark.createDataFrame(full, "entity_id long, article_id string, pos int, text string, category string, negated boolean")


def test_tally_counts_documents(spark):
    rows = [("1", "COPD", "condition", False)] * 3 + [("2", "Asthma", "condition", False), ("3", "asthma", "condition", False), ("3", "Fever", "finding", True), ("3", None, "finding", False), ("3", "x", "finding", False)]
    found = {r.term_key: r for r in terms.tally(entities(spark, *rows)).collect()}
    assert set(found) == {"copd", "asthma"}
    assert (found["asthma"].docs, found["copd"].mentions) == (2, 3)
    assert found["asthma"].display == "Asthma"  # seen first of two equally frequent spellings


def test_abbreviations_merge_with_long_forms(spark):
    texts = spark.createDataFrame([("1", "Chronic kidney disease (CKD) is common."), ("2", "CKD progression was slower.")], "article_id string, text string")
    known = terms.abbreviation_map(terms.find_abbreviations(texts, "article_id", "text"))
    rows = terms.with_canonical(entities(spark, ("1", "Chronic kidney disease", "condition", False), ("2", "CKD", "condition", False)), known)
    found = terms.tally(rows, c("canonical")).collect()
    assert [(r.display, r.docs) for r in found] == [("Chronic kidney disease", 2)]


def test_abbreviation_definitions():
    text = "Patients with chronic kidney disease (CKD) and type 2 diabetes (T2D) received sodium-glucose cotransporter 2 inhibitors (SGLT2i). CKD progressed less."
    assert terms.abbreviations_in(text) == {"ckd": "chronic kidney disease", "t2d": "type 2 diabetes", "sglt2i": "sodium-glucose cotransporter 2 inhibitors"}
    assert terms.abbreviations_in("in the elderly (n=120) and adults (95% CI) (p<0.05)") == {}


def test_commonest_definition_wins(spark):
    def chosen(*texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
        return {r.short: r.long for r in terms.abbreviation_map(terms.find_abbreviations(frame, "doc", "text")).collect()}

    both = chosen("acute kidney injury (AKI)", "acute kidney injury (AKI) again", "acute kidney insufficiency (AKI)")
    assert both["aki"] == "acute kidney injury" and both["copd"] == "chronic obstructive pulmonary disease"
    assert chosen("acute kidney insufficiency (AKI)")["aki"] == "acute kidney insufficiency"


def test_known_abbreviations(spark):
    rows = entities(spark, *[("1", t, "drug", False) for t in ("SGLT2 inhibitors", "SGLT2i", "CKD", "chronic kidney disease")])
    none = spark.createDataFrame([], "doc string, short string, long string")
    keys = {r.text: r.canonical for r in terms.with_canonical(rows, terms.abbreviation_map(none)).collect()}
    assert keys["SGLT2 inhibitors"] == keys["SGLT2i"] and keys["CKD"] == keys["chronic kidney disease"]


def test_singular_forms(spark):
    assert column(spark, tx.singularize, "sglt2 inhibitors", "therapies", "diabetes", "sepsis", "virus", "patients") == ["sglt2 inhibitor", "therapy", "diabetes", "sepsis", "virus", "patient"]


def test_terms_in_the_same_papers(spark):
    rows = [(d, "ckd", "condition", False) for d in "123"] + [(d, "diabetes", "condition", False) for d in "12"] + [("9", "asthma", "condition", False), ("3", "hta", "condition", False)]
    found = terms.cooccurring(entities(spark, *rows), "condition", "ckd").collect()
    assert [(r.term_key, r.shared) for r in found] == [("diabetes", 2), ("hta", 1)]
    assert terms.cooccurring(entities(spark, *rows), "condition", "none").count() == 0


def test_term_export(spark):
    rows = entities(spark, ("7", "Asthma", "condition", False), ("8", "asthma", "condition", False))
    table = terms.terms_csv(terms.tally(rows), F.lit(4), terms.term_documents(rows))
    assert [r.line for r in table.select(terms.terms_lines(table).alias("line")).collect()] == ["Condition,asthma,2,2,0.500,7 8"]
    assert [r.category for r in terms.present_categories(rows).collect()] == ["condition"]


# ---------------------------------------------------------------- effects, designs, sizes


@pytest.mark.parametrize(
    ("text", "kind", "numbers"),
    [
        ("Events fell (HR 0.72, 95% CI 0.61-0.85; P<0.001).", "HR", (0.72, 0.61, 0.85)),
        ("The odds ratio was 2.3 (95% confidence interval 1.1 to 4.8).", "OR", (2.3, 1.1, 4.8)),
        ("Risk was higher (RR = 1.45, 95% CI: 1.10–1.91).", "RR", (1.45, 1.1, 1.91)),
        ("hazard ratio, 0.80; 95% CI, 0.70 to 0.91", "HR", (0.8, 0.7, 0.91)),
        ("adjusted OR 1.8 (1.2-2.7)", "OR", (1.8, 1.2, 2.7)),
        ("relative risk 0.5 (95% CI 0.3 to 0.8)", "RR", (0.5, 0.3, 0.8)),
        ("Mean difference −2.3 (95% CI −4.1 to −0.5) mmHg.", "MD", (-2.3, -4.1, -0.5)),
        ("a mean difference of 3.1 (95% CI 1.0 to 5.2).", "MD", (3.1, 1.0, 5.2)),
        ("standardised mean difference 0.4 [0.1, 0.7]", "SMD", (0.4, 0.1, 0.7)),
    ],
)
def test_effects(text, kind, numbers):
    assert [(e[0], e[2:5]) for e in effects.effects_in(text)] == [(kind, numbers)]


@pytest.mark.parametrize("text", ["Patients or controls 5 (2-3) were seen.", "OR 3.0 (95% CI 4.0-5.0)", "No effect sizes here, only 45 patients.", "HR 0.7", "HR 0.7 (", "odds ratio", ""])
def test_no_effects(text):
    assert effects.effects_in(text) == []


def test_effects_of_papers(spark):
    text = "We enrolled 200 patients. Mortality fell (HR 0.72, 95% CI 0.61-0.85). Pain scores improved (mean difference -1.2, 95% CI -2.0 to -0.4). The HR 0.72 (95% CI 0.61-0.85) held."
    rows = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, abstract string")
    found = effects.extract_effects(rows, "id", c("abstract")).orderBy("pos").collect()
    assert [(r.id, r.kind) for r in found] == [(1, "HR"), (1, "MD")] and "Mortality fell" in found[0].sentence
    first = effects.primary_effect(effects.extract_effects(rows, "id", c("abstract")), "id", "difference").collect()
    assert [(r.id, r.kind) for r in first] == [(1, "MD")]


def test_study_designs(spark):
    rows = papers(
        spark, ("T", "", ["Randomized Controlled Trial"]), ("A meta-analysis of statins", "", []), ("T", "This retrospective cohort study included adults.", []), ("T", "A case-control study of 200 pairs.", []),
        ("T", "In this cross-sectional survey…", []), ("T", "", ["Case Reports"]), ("T", "We discuss things.", []), ("T", "A retrospective look. A prospective observational study.", []), ("T", "retrospective. cohort", []), ("T", "We report a case of it.", None),
    )
    assert [r.d for r in rows.select(tx.study_design().alias("d")).collect()] == [
        "Randomized controlled trial", "Meta-analysis", "Retrospective cohort study", "Case-control study", "Cross-sectional study", "Case report", "", "Prospective study", "Cohort study", "Case report",
    ]


def test_sample_sizes(spark):
    texts = ["Methods: n = 1,204 adults were enrolled.", "We enrolled 312 consecutive patients with sepsis.", "We pooled 24 randomized trials.", "In 2019 patients improved.", "", "80 critically ill adult patients", "5 very old men; 7 men", "In 2019 patients improved in 3 trials."]
    rows = papers(spark, *[("T", t, ["Case Reports"] if not t else []) for t in texts])
    found = rows.select(tx.sample_size().alias("s"), tx.participants(tx.sample_size()).alias("n")).collect()
    assert [r.s for r in found] == ["n = 1,204", "312 patients", "24 trials", "", "1 patient", "80 patients", "", "3 trials"]
    assert [r.n for r in found] == [1204, 312, None, None, 1, 80, None, None]


def test_identifiers(spark):
    texts = ["10.1056/NEJMoa2204233", "https://doi.org/10.1000/xyz123.", "doi: 10.1000/abc(1)", "PMID: 36331190", "PMID 111", "https://pubmed.ncbi.nlm.nih.gov/36331190/", "heart failure", "12", None, ""]
    found = [None if r is None else (r.kind, r.value) for r in column(spark, tx.identifier, *texts)]
    assert found == [("doi", "10.1056/nejmoa2204233"), ("doi", "10.1000/xyz123"), ("doi", "10.1000/abc(1"), ("pmid", "36331190"), ("pmid", "111"), ("pmid", "36331190"), None, None, None, None]


def test_categories_of_labels(spark):
    assert column(spark, tx.category_for, "SIMPLE_CHEMICAL", "GENE_OR_GENE_PRODUCT", "ORGANISM", "ORGAN", "CANCER", "cell", "x") == ["drug", "gene", "organism", "anatomy", "condition", "cell", "other"]


def test_shown_numbers(spark):
    rows = spark.createDataFrame([(1234.567,), (0.5,), (0.00012,), (None,), (float("nan"),), (0.0,)], "x double")
    assert [r.y for r in rows.select(tx.shown_number(c("x")).alias("y")).collect()] == ["1,234.57", "0.5", "1.2e-4", "–", "–", "0"]
    assert [r.y for r in rows.select(tx.shown_p(c("x"), name=True).alias("y")).collect()] == ["p = 1234.567", "p = 0.500", "p < 0.001", "p = –", "p = –", "p < 0.001"]
    assert spark.range(1).select(tx.shown_interval(F.lit(2.0), F.lit(1.0), F.lit(3.25)).alias("y"), tx.shown_percent(F.lit(0.1234)).alias("z")).first() == ("2 (1 to 3.25)", "12.3%")


# ---------------------------------------------------------------- searches


def test_query_with_every_filter(spark):
    rows = spark.createDataFrame(
        [("asthma", None, None, [], False, False, [], [], "", None, None), ("heart failure", 2020, None, ["rct", "meta"], True, True, ["english", "romanian"], ["aged"], "female", "therapy", "narrow"), ("x", 2015, 2020, ["sr"], False, True, [], [], "", None, None)], search.SEARCHES,
    )
    found = [r.q for r in rows.select(search.full_query().alias("q")).collect()]
    assert found[0] == "(asthma)"
    assert found[1] == '(heart failure) AND (meta-analysis[pt] OR randomized controlled trial[pt]) AND ("2020/01/01"[dp] : "3000/12/31"[dp]) AND free full text[sb] AND humans[mh] AND (english[la] OR romanian[la]) AND aged[mh] AND female[mh] AND Therapy/Narrow[filter]'
    chips = search.active_filters(rows.where("base = 'x'"), "base").orderBy("pos").collect()
    assert [r.label for r in chips] == ["2015–2020", "Systematic review", "Humans"]


def test_clinical_question(spark):
    rows = spark.createDataFrame([("heart failure, cardiac failure", "dapagliflozin", "placebo", "hospitalization; mortality"), ("asthma", "", "", None)], "p string, i string, k string, o string")
    assert [r.q for r in rows.select(search.pico_query(c("p"), c("i"), c("k"), c("o")).alias("q")).collect()] == ["((heart failure) OR (cardiac failure)) AND (dapagliflozin OR placebo) AND (hospitalization OR mortality)", "asthma"]


def test_translation(spark):
    g = search.Glossary.standard()
    assert search.translate("insuficiență cardiacă și diabet zaharat tip 2 la vârstnici", g)[:2] == ("heart failure AND type 2 diabetes mellitus la elderly", 3)
    assert search.translate("diagnostic accuracy of troponin", g) == ("diagnostic accuracy of troponin", 0, [])
    assert search.translate('"hipertensiune arterială"[tiab] și obezitate', g)[0] == '"hipertensiune arterială"[tiab] AND obesity'
    assert search.translate("tratament pentru rinichi polichistic", g)[2] == []
    assert search.translate("tratament pentru afecțiune rară", g)[2] == ["afecțiune", "rară"]
    assert search.translate("tratamentul insuficienței cardiace la copiilor", g)[0] == "treatment heart failure la children"
    own = search.Glossary.typed("troponină = troponin\nbad line\n x = y = z")
    assert search.translate("Troponină la copii", own + g)[0] == "Troponin la children"
    rows = spark.createDataFrame([(1, "copii și astm"), (2, "asthma"), (3, None)], "k int, q string")
    assert {r.k: r.text for r in search.translate_table(rows, "k", "q").collect()} == {1: "children AND asthma", 2: "asthma", 3: None}


def test_states_make_the_round_trip(spark):
    filters = search.EMPTY_FILTERS | {"types": ["rct"], "from_year": 2019}
    link = search.encode_state("asthma AND children", 100, "pub_date", filters)
    assert "free_full_text" not in link
    assert search.decode_state(link) == {"query": "asthma AND children", "count": 100, "sort": "pub_date", "filters": filters}
    assert search.decode_state("#nothing=1") is None
    assert search.decode_state("#q=x&f=%7Bbroken")["filters"] == search.EMPTY_FILTERS
    rows = spark.createDataFrame([("asthma AND children", 2019, None, ["rct"], False, False, [], [], "", None, None)], search.SEARCHES)
    made = rows.select(search.state_fragment(c("base"), F.lit(100), F.lit("pub_date"), search.changed_filters()).alias("s")).first().s
    assert search.decode_state(made)["filters"] == filters
