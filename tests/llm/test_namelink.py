import itertools
import random
import time

from litforge.llm import namelink
from litforge.llm.namelink import candidates, distance, link_names, one_apart, radius_pairs

ATTESTED = ["Gerda Fuvubaez", "Fuvubaez, Gerda", "Fuvubaez G", "G. Fuvubaez", "Fuvubaez, G."]
FORMS = ["Fuvubaze G", "G. Fuvubaze", "Fuvubaze, G."]


def entities(spark, rows):
    found = link_names(spark.createDataFrame(rows, "name string, occurrences long")).collect()
    assert len(found) == len(rows)
    return {r["name"]: r["entity"] for r in found}


def test_a_mistyped_name_stays_linked_when_it_recurs(spark):
    # at every size the slip is 1 occurrence in 100, and in the larger ones it occurs in three forms
    for times in (1, 10, 1000):
        rows = [(x, 60 * times) for x in ATTESTED] + [(x, times) for x in FORMS]
        assert len(set(entities(spark, rows).values())) == 1


def test_twins_stay_apart(spark):
    twins = ["William Hefekemann", "Hefekemann, William", "Hefekemann W", "W. Hefekemann"]
    other = [x.replace("Hefekemann", "Hefekemans") for x in twins]
    found = entities(spark, [(x, 30) for x in twins] + [(x, 10) for x in other])
    assert {found[x] for x in twins}.isdisjoint({found[x] for x in other})
    # rare beside its twin with this initial, yet a family name of other people
    rows = [(x, 900) for x in twins] + [(x, 3) for x in ("Hefekemans W", "W. Hefekemans", "Hefekemans, W.")] + [("Zara Hefekemans", 500), ("Hefekemans, Zara", 500)]
    found = entities(spark, rows)
    assert found["Hefekemans W"] != found["Hefekemann W"]


def test_a_mistyped_given_name_stays_linked_when_it_recurs(spark):
    rows = [(x, 600) for x in ("Gerda Fuvubaez", "Fuvubaez, Gerda", "Gerda M. Fuvubaez", "GERDA Fuvubaez")]
    rows += [(x, 5) for x in ("Gedra Fuvubaez", "Fuvubaez, Gedra", "Gedra M. Fuvubaez")]
    assert len(set(entities(spark, rows).values())) == 1
    # the same counts, but both are given names of their own beside other family names
    rows += [("Gedra Somolek", 400), ("Gerda Somolek", 400)]
    found = entities(spark, rows)
    assert found["Gedra Fuvubaez"] != found["Gerda Fuvubaez"]


def test_many_names_of_one_length_are_compared_with_few(spark):
    # names of one block and nearly one length, most of them equally far from each other
    draw = random.Random(4)
    names = {"".join(draw.choices("bcdfghklmnprstvz", k=6)) + "moto" for _ in range(30_000)}
    names |= {n[:2] + n[3:] for n in sorted(names)[:300]} | {n[:3] + n[4] + n[3] + n[5:] for n in sorted(names)[300:600]}
    cells = {}
    for n in names:
        for form in {n, *(n[:i] + n[i + 1 :] for i in range(len(n)))}:
            cells.setdefault(form, []).append(n)
    right = {(a, b) for cell in cells.values() for a, b in itertools.combinations(sorted(cell), 2) if distance(a, b) <= 1}
    rows = spark.createDataFrame([("p", n) for n in sorted(names)], "block string, name string")
    began = time.monotonic()
    assert {(r.name_a, r.name_b) for r in radius_pairs(rows).collect()} == right
    assert time.monotonic() - began < 60
    assert candidates(rows).count() < len(names)


def test_radius_two_equals_brute_force(spark):
    draw = random.Random(5)
    names = sorted({"".join(draw.choices("abcd", k=draw.randint(0, 6))) for _ in range(150)})
    rows = spark.createDataFrame([(b, n) for b in "pq" for n in names], "block string, name string")
    found = sorted((r.block, r.name_a, r.name_b, r.distance) for r in radius_pairs(rows, 2).collect())
    assert found == sorted((b, x, y, distance(x, y)) for b in "pq" for x, y in itertools.combinations(names, 2) if distance(x, y) <= 2)


def test_shortcuts_tell_what_the_metric_tells():
    draw = random.Random(6)
    words = ["".join(draw.choices("abc", k=draw.randint(0, 6))) for _ in range(300)]
    assert all(one_apart(x, y) == (distance(x, y) <= 1) for x in words for y in words)
    known = namelink.GENERIC + namelink.FIELDS_OF
    slips = [k[:i] + x + k[i + n :] for k in known for i in range(len(k) + 1) for x in ("", "q", k[i : i + 2][::-1]) for n in (0, 1, 2)]
    near = lambda w: w if w in known else next((k for k in known if len(w) > 4 and len(k) > 4 and abs(len(k) - len(w)) <= 1 and distance(w, k) <= 1), None)
    assert [namelink._near(w, "any") for w in slips] == [near(w) for w in slips]
    many = sorted({w for w in words if w})
    close = namelink._close_names(many)
    assert all(set(close.get(g, ())) == {h for h in many if h != g and len(g) > 2 and distance(g, h) <= 1} for g in many)
