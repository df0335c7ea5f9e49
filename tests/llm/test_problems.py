"""Problems 3 and 5 to 10 on small tables, against brute force, SQL or an exact round trip."""

import itertools
import random

import oracle
import pytest
from pyspark.sql import functions as F

from litforge import llm
from litforge.llm import languages, lookalikes, mixing, namelink, sentences, termmap, together, tokens


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    oracle.same(llm.queries()[name](spark, oracle.FOLDER), oracle.connection(), llm.oracle_sql()[name])


def test_every_problem_has_queries():
    assert {name.split("_")[0] for name in llm.queries()} == {f"p{n}" for n in range(1, 11)}


# ---------------------------------------------------------------- 3


def test_pairs_of_a_hot_basket_equal_brute_force(spark):
    draw = random.Random(3)
    baskets = {0: {f"i{k}" for k in range(300)}} | {b: {f"i{draw.randrange(300)}" for _ in range(6)} for b in range(1, 40)}
    rows = [("x", b, i) for b, items in baskets.items() for i in items for _ in range(2)] + [("x", None, "i1"), ("x", 1, None), (None, 1, "i1")]
    found = {(r.item_a, r.item_b): (r.n, r.lift) for r in together.pair_lift(spark.createDataFrame(rows, "kind string, basket long, item string"), least=2, per_thousand=1, lift=1.0).collect()}
    counts, pairs = {}, {}
    for items in baskets.values():
        for i in items:
            counts[i] = counts.get(i, 0) + 1
        for p in itertools.combinations(sorted(items), 2):
            pairs[p] = pairs.get(p, 0) + 1
    n = len(baskets)
    assert found == {p: (k, round(k * n / (counts[p[0]] * counts[p[1]]), 6)) for p, k in pairs.items() if k >= 2 and k * n >= counts[p[0]] * counts[p[1]]}
    assert together.pair_lift(spark.createDataFrame([], "kind string, basket long, item string")).count() == 0


# ---------------------------------------------------------------- 4


def test_one_edit_is_told_like_the_metric_does():
    draw = random.Random(1)
    a = ["".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(4000)]
    b = ["".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(4000)]
    d = namelink.distances(a, b)
    assert [min(x, 2) for x in d.tolist()] == namelink.within_one(a, b).tolist()
    assert d.tolist()[:200] == [namelink.distance(x, y) for x, y in zip(a[:200], b[:200], strict=True)]


def test_radius_join_equals_brute_force(spark):
    draw = random.Random(2)
    names = sorted({"".join(draw.choices("abcd", k=draw.randint(2, 6))) for _ in range(400)})
    found = namelink.radius_pairs(spark.createDataFrame([("p", n) for n in names], "block string, name string")).collect()
    assert sorted((r.name_a, r.name_b) for r in found) == sorted((x, y) for x, y in itertools.combinations(names, 2) if namelink.distance(x, y) <= 1)


def test_name_edges(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("---",), ("Ana Popescu",), ("Ana Popescu",), ("x" * 5000,)], "name string")
    assert {r.name for r in namelink.link_names(rows).collect()} <= {"Ana Popescu", "x" * 5000}
    assert namelink.name_pairs(namelink.link_names(rows)).count() == 0


# ---------------------------------------------------------------- 5


TEXTS = {
    "en": ["The patients were treated with the drug for two weeks.", "We found that the risk was higher in older people.", "There was no difference between the groups."],
    "fr": ["Les patients ont reçu le traitement pendant deux semaines.", "Nous avons trouvé que le risque était plus élevé chez les personnes âgées.", "Il n'y avait aucune différence entre les groupes."],
    "ru": ["Пациенты получали лечение в течение двух недель.", "Мы обнаружили, что риск был выше у пожилых людей.", "Между группами не было различий."],
}


def test_held_out_sentences_get_their_language(spark):
    rows = [(i, lang, t[0], " ".join(t[:2])) for i, (lang, t) in enumerate(TEXTS.items())] * 3
    frame = spark.createDataFrame(rows, "id int, label string, title string, abstract string")
    known = languages.fit(frame, 1024)
    for lang, t in TEXTS.items():
        assert [s[2] for s in known.segments(t[2])] == [lang]
    mixed = known.segments(" ".join(TEXTS["en"] + TEXTS["fr"]))
    assert [(s[2], s[4]) for s in mixed] == [("en", 3), ("fr", 3)]
    odd = spark.createDataFrame([(1, "en", None, None), (2, "en", "", "n/a"), (3, None, "", " ".join(TEXTS["ru"]))], "id int, label string, title string, abstract string")
    assert [(r.id, r.lang_code) for r in languages.mislabelled(languages.segments(odd, known)).collect()] == [(3, "ru")]
    assert languages.segments(odd.limit(0), known).count() == 0


def test_two_separated_sentences_make_a_second_language(spark):
    shape = "id int, label string, field_name string, start_pos int, end_pos int, lang_code string, confidence double, n_sentences int"
    rows = [(1, "en", "abstract", 0, 9, "en", 0.9, 3), (1, "en", "abstract", 10, 19, "fr", 0.9, 1), (1, "en", "abstract", 20, 29, "en", 0.9, 2), (1, "en", "abstract", 30, 39, "fr", 0.9, 1)]
    assert languages.used_languages(spark.createDataFrame(rows, shape)).first().languages == ["en", "fr"]
    assert languages.used_languages(spark.createDataFrame(rows[:3], shape)).first().languages == ["en"]


def test_labels_in_other_notations(spark):
    assert [languages.code(x) for x in ("ENG", "pt-BR", "français", "la", "", None)] == ["en", "pt", "fr", None, None, None]


# ---------------------------------------------------------------- 6


def canonical(spark, *texts):
    rows = spark.createDataFrame([(i, "title", 0, t) for i, t in enumerate(texts)], "row_id int, field_name string, element int, value string")
    return [r.canonical for r in lookalikes.canonical_texts(rows).orderBy("row_id").collect()]


def test_equal_looking_texts_become_equal(spark):
    odd = ["Ｓｔｕｄｙ of café", "Stu​dy of café", "Study of café", "Ѕtudу of café", "ѕеріоuѕ", "plain – “text”", "исследование", "Ꮪtudy", "", None]
    assert canonical(spark, *odd) == ["Study of café", "Study of café", "Study of café", "Study of café", "sepious", "plain – “text”", "исследование", "Study", "", None]
    rows = spark.createDataFrame([(i, "title", t) for i, t in enumerate(odd)], "row_id int, field_name string, value string")
    assert sorted(r.row_id for r in lookalikes.odd_fields(rows).collect()) == [0, 1, 2, 3, 4, 7]


# ---------------------------------------------------------------- 7


TERMS = [(i, f"term{w}emia {k} disease", []) for i, (w, k) in enumerate(itertools.product("bcdf", ("alpha", "omega")))] + [(90, "kodovir", ["KDV-12"]), (91, "left gunral lobe", [])]


def mapped(spark, *values, terms=TERMS):
    listed = spark.createDataFrame(terms, "term_id int, preferred string, synonyms array<string>")
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "source_table string, row_id int, value string")
    return {values[r.row_id]: r.term_id for r in termmap.map_values(rows, listed).collect()}


def test_values_are_mapped(spark):
    found = mapped(spark, "Kodovir", "kodovr", "kodoivr tablets", "nothing like it", "lobe, left gunral", "left gunr. lobe", None, "", "...", "KDV12")
    assert found == {"kodovr": 90, "kodoivr tablets": 0, "nothing like it": 0, "lobe, left gunral": 91, "left gunr. lobe": 91, "KDV12": 90}


def test_decorations_come_from_the_values(spark):
    entries = [p for _, p, _ in TERMS]
    found = mapped(spark, *[f"probably {e}" for e in entries], "probably kodovr", "surely kodovr")
    assert found["probably kodovr"] == 90 and found["surely kodovr"] == 0


def test_long_values_are_searched_whole(spark):
    text = " ".join(["word"] * 40) + " left gunral lobe " + " ".join(["more"] * 40)
    assert mapped(spark, text) == {text: 91}


def test_lists_that_differ_in_synonyms_do_not_share_a_trie(spark):
    assert mapped(spark, "zzyxovir", terms=[(5, "kodovir", [])]) == {"zzyxovir": 0}
    assert mapped(spark, "zzyxovri", terms=[(5, "kodovir", ["zzyxovir"])]) == {"zzyxovri": 5}
    assert mapped(spark, "abc", terms=[]) == {"abc": 0}


def test_automaton_finds_what_brute_force_finds():
    draw = random.Random(4)
    entries = sorted({"".join(draw.choices("ab", k=draw.randint(3, 7))) for _ in range(60)})
    trie = termmap.TermTrie([(i, e, None) for i, e in enumerate(entries)])
    for value in ("".join(draw.choices("ab", k=draw.randint(3, 8))) for _ in range(60)):
        found = {(d, form) for d, form, _ in trie.within(value, 2) if form in entries}

        def osa(a, b):
            grid = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
            for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
                grid[i][j] = min(grid[i - 1][j] + 1, grid[i][j - 1] + 1, grid[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    grid[i][j] = min(grid[i][j], grid[i - 2][j - 2] + 1)
            return grid[-1][-1]

        assert found == {(osa(value, e), e) for e in entries if osa(value, e) <= 2}


# ---------------------------------------------------------------- 8 and 9


def test_ids_equal_those_of_the_public_encoder(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.NAME}")
    texts = ["Hello  world!", "naïve café 東京 \U0001f600", "<|endoftext|>", "a" * 3000, " \n\t ", "don't 1234", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [r.ids for r in tokens.encode(rows).orderBy("doc_id").collect()]
    assert found[-2:] == [[], []]
    for text, ids in zip(texts, found, strict=True):
        if text and "endoftext" not in text:
            assert ids == public.encode(text, add_special_tokens=False).ids
    assert len(found[2]) > 1  # a special token's text is ordinary text


def test_mix_meets_its_targets(spark):
    draw = random.Random(6)
    docs = [(i, draw.choice(["big"] * 8 + ["mid", "small", "none"]), draw.randint(1, 60)) for i in range(4000)] + [(9000, None, 5), (9001, "big", 0), (9002, "big", None)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.25, 3), ("empty", 0.05, 2)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(frame, targets)
    rows = {r.source: r for r in shares.collect()}
    for name, share in (("big", 0.4), ("mid", 0.3), ("small", 0.25)):
        assert abs(rows[name].share - share / 0.95) < 0.01 and rows[name].most_copies <= {"big": 1, "mid": 2, "small": 3}[name]
    assert sum(r.limits for r in rows.values()) == 1 and rows["empty"].missed and rows["empty"].share == 0
    assert copies.where("doc_id >= 9000 OR source = 'none'").count() == 0
    assert mixing.mix(frame.limit(0), targets)[1].agg(F.sum("share")).first()[0] == 0


# ---------------------------------------------------------------- 10


def split(text):
    return [text[s:e] for s, e in sentences.sentences(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("It rose by 2.5 mg. Dr. Smith agreed.", ["It rose by 2.5 mg.", "Dr. Smith agreed."]),
        ("“Is it worse?” asked the nurse. Yes.", ["“Is it worse?” asked the nurse.", "Yes."]),
        ("今天很好。明天呢？", ["今天很好。", "明天呢？"]),
        ("यह ठीक है। वह भी।", ["यह ठीक है।", "वह भी।"]),
        ("Dear all,\n\nThis is it. (See Fig. 2.) Done.", ["Dear all,", "This is it.", "(See Fig. 2.)", "Done."]),
        ("Steps:\n1. Wash.\n2. Dry.", ["Steps:", "1. Wash.", "2. Dry."]),
        ("", []),
        (" \n ", []),
    ],
)
def test_sentences(text, expected):
    assert split(text) == expected


def test_titles_of_any_length_are_one_unit():
    title = "Does it work? A review of " + "very many " * 60 + "things"
    assert split(title) == [title]


def test_open_marks_cost_no_second_look(spark):
    text = "Yes (no. " * 20_000
    assert len(sentences.sentences(text)) > 0
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two.")], "doc_id int, text string")
    assert [(r.doc_id, r.start_pos, r.end_pos) for r in sentences.split_sentences(rows).orderBy("start_pos").collect()] == [(3, 0, 4), (3, 5, 9)]
