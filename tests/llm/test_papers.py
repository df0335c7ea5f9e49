import random

import pandas as pd

from litforge.llm.papers import _assign


def frame(rows):
    return pd.DataFrame(rows, columns=["a", "b", "score"]).assign(kind="ac")


def best(rows):
    """The greatest total by trying everything."""
    if not rows:
        return 0.0
    (a, b, s), rest = rows[0], rows[1:]
    return max(best(rest), s + best([r for r in rest if r[0] != a and r[1] != b]))


def one_to_one(found):
    return found.a.is_unique and found.b.is_unique


def test_a_large_component_is_solved_exactly():
    rows, blocks = [], 700
    for k in range(blocks):  # greedy takes 10 and 1 of each block, the optimum is 9 and 9
        a, b = 2 * k, 2 * k + 1
        rows += [(a, a, 10.0), (a, b, 9.0), (b, a, 9.0), (b, b, 1.0), (b, 2 * ((k + 1) % blocks), 0.1)]
    found = _assign(frame(rows))
    assert len(rows) > 2_000
    assert one_to_one(found)
    assert found.score.sum() == 18.0 * blocks


def test_totals_equal_those_of_trying_everything():
    draw = random.Random(7)
    for _ in range(300):
        cells = [(a, b) for a in range(draw.randint(1, 4)) for b in range(draw.randint(1, 4))]
        rows = [(a, b, draw.choice([1.0, 2.5, 3.0, 4.25, 9.0]) + draw.random() * draw.choice([0, 1])) for a, b in draw.sample(cells, min(len(cells), 10))]
        found = _assign(frame(rows))
        assert one_to_one(found)
        assert abs(found.score.sum() - best(rows)) < 1e-9
