"""Problem 7: map freely written values to the entries of a reference list.

The reference entries, their alias paths and nothing else are kept in a trie. A value is searched in the trie with
a Levenshtein automaton (bit-parallel, one bit per position of the value, with adjacent transpositions), which
returns every entry within a distance that depends on the value's length. Alias paths are spellings derived by
rule from an entry: the inverted form ("cortex, left"), the form without spaces and punctuation, initials of entries
of three and more words where they are unique, and wild-card paths for values with shortened words ("left gunr.
lobe"). Words around an entry (modifiers, doses, a bracketed acronym) are peeled off when what remains is an entry. Which
words these are is found from the values: those that stand before, or after, ``BESIDE`` and more different entries
(:func:`decorations`), or the caller names them.

Values are reduced to distinct normal forms before the search, so that its cost follows the number of spellings,
not of rows; exact forms are removed by an anti join first.

Defined results: null values and values whose normal form is empty have no row; values equal to an entry have no
row; unmatched values have term 0; among several nearest entries the one with the smaller distance after look-alike
digits count half wins, then the smaller id; a row delivered twice counts once, with its latest value; an empty
reference list leaves every value unmatched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.core.session import spread, table
from litforge.core.text import normal_form

#: Different entries that a word must stand before (or after) to say something about a mention without changing its term.
BESIDE = 5
#: Substitutions that cost half when nearest entries are compared: digits typed or scanned for letters.
ALIKE = {("0", "o"), ("1", "l"), ("1", "i"), ("5", "s")}
#: Values of this length and more may be three edits away when nothing else is found.
WIDE_FROM = 14
DOSE = regex.compile(r"\s\d+(?:[.,]\d+)?\s?(?:mg|ml|g|µg|mcg|%)?\Z")
BRACKET = regex.compile(r"\s*\((?:[^()]*)\)?\Z")
SQUASH = regex.compile(r"[^\p{L}\p{N}]+")
END = "\0"


def allowed(length: int) -> int:
    """Edits allowed for a value of so many characters."""
    return 0 if length < 6 else 1 if length < 9 else 2


def plain(text: str) -> str:
    """Normal form, as :func:`litforge.core.text.normal_form` gives it."""
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z", "", regex.sub(r"\s+", " ", text.lower()))


def weighted(a: str, b: str) -> float:
    """Edit distance with adjacent transpositions in which look-alike digits cost half."""
    before, row = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if (x, y) in ALIKE else 1.0
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


class TermTrie:
    """Trie of a reference list of (term_id, preferred, synonyms)."""

    def __init__(self, terms: list[tuple[int, str, list[str] | None]], before: Iterable[str] = (), after: Iterable[str] = ()):
        self.before, self.after = frozenset(before), frozenset(after)
        self.root: dict = {}
        self.exact: dict[str, set[int]] = {}
        squashed: dict[str, set[int]] = {}
        initials: dict[str, set[int]] = {}
        for term_id, preferred, synonyms in terms:
            for form in filter(None, (plain(x) for x in [preferred, *(synonyms or [])] if x)):
                self.exact.setdefault(form, set()).add(term_id)
                squashed.setdefault(SQUASH.sub("", form), set()).add(term_id)
                words = form.split(" ")
                if len(words) > 2:
                    initials.setdefault("".join(w[0] for w in words), set()).add(term_id)
        self.squashed = squashed
        self.longest = max((len(form.split(" ")) for form in self.exact), default=0)
        for form, ids in self.exact.items():
            self.add(form, ids)
            words = form.split(" ")
            if len(words) > 1:
                self.add(f"{words[-1]}, {' '.join(words[:-1])}", ids)
        for form, ids in squashed.items():
            if form not in self.exact:
                self.add(form, ids)
        self.initials = {k: next(iter(v)) for k, v in initials.items() if len(v) == 1 and k not in self.exact}

    def add(self, form: str, ids: set[int]) -> None:
        node = self.root
        for letter in form:
            node = node.setdefault(letter, {})
        node.setdefault(END, (form, set()))[1].update(ids)

    def within(self, value: str, most: int) -> list[tuple[int, str, set[int]]]:
        """Every (distance, entry form, term ids) of the trie within ``most`` edits of ``value``."""
        n = len(value)
        where: dict[str, int] = {}
        for i, letter in enumerate(value):
            where[letter] = where.get(letter, 0) | 1 << i
        full, accept = (1 << (n + 1)) - 1, 1 << n
        levels = most + 1
        found = []
        stack = [(self.root, tuple((1 << (d + 1)) - 1 for d in range(levels)), (0,) * levels)]
        while stack:
            node, states, swaps = stack.pop()
            for letter, child in node.items():
                if letter == END:
                    for d in range(levels):
                        if states[d] & accept:
                            found.append((d, *child))
                            break
                    continue
                mask = where.get(letter, 0)
                new, crossed, alive = [], [0], 0
                for d in range(levels):
                    bits = (states[d] & mask) << 1
                    if d:
                        lower = states[d - 1]
                        bits |= lower | lower << 1 | new[d - 1] << 1 | (swaps[d] & mask) << 2
                        crossed.append(lower & mask >> 1)
                    bits &= full
                    new.append(bits)
                    alive |= bits | crossed[d]
                if alive:
                    stack.append((child, tuple(new), tuple(crossed)))
        return found

    def shortened(self, value: str) -> set[int]:
        """Terms whose words start with the words of ``value``, of which some end with a period or are cut at the end."""
        tokens = value.split(" ")
        if "." not in value or any(len(t.rstrip(".")) < 2 for t in tokens):
            return set()
        found: set[int] = set()
        stack = [(self.root, 0, 0, False)]
        last = len(tokens) - 1
        while stack:
            node, k, i, skip = stack.pop()
            token = tokens[k].rstrip(".")
            wild = tokens[k].endswith(".") or k == last
            if not skip and i < len(token):
                if (child := node.get(token[i])) is not None:
                    stack.append((child, k, i + 1, False))
                continue
            if k == last and END in node:
                found |= node[END][1]
            if k < last and " " in node:
                stack.append((node[" "], k + 1, 0, False))
            if wild:
                stack += [(child, k, i, True) for letter, child in node.items() if letter not in (END, " ", ",")]
        return found

    def nearest(self, value: str) -> tuple[int, float] | None:
        """(term, distance) of the entry nearest to a value, or None."""
        best = None
        squashed = SQUASH.sub("", value)
        for form in dict.fromkeys((value, squashed)):
            if ids := self.exact.get(form) or self.squashed.get(form):
                return min(ids), 0.0
        for form in dict.fromkeys((value, squashed)):
            for _, entry, ids in self.within(form, allowed(len(form))):
                key = (weighted(form, entry), min(ids))
                if best is None or key < best:
                    best = key
        return (best[1], best[0]) if best else None

    def find(self, value: str) -> tuple[int, float]:
        """(term, distance) a normal form means; term 0 if none. Whole value first, then what peeling leaves."""
        if found := self.nearest(value):
            return found
        if term := self.initials.get(SQUASH.sub("", value)):
            return term, 0.0
        if len(ids := self.shortened(value)) == 1:
            return min(ids), 0.0
        forms, seen, at = [value], {value}, 0
        while at < len(forms):
            form = forms[at]
            at += 1
            words = form.split(" ")
            rest = [" ".join(words[n:]) for n in (1, 2) if len(words) > n and " ".join(words[:n]) in self.before]
            rest += [" ".join(words[:-n]) for n in (1, 2) if len(words) > n and " ".join(words[-n:]) in self.after]
            rest += [m for pattern in (DOSE, BRACKET) if (m := pattern.sub("", form)) != form]
            if form.count(",") == 1:
                tail, head = form.split(",")
                rest.append(f"{head.strip()} {tail.strip()}")
            for x in rest:
                x = plain(x)
                if x and x not in seen:
                    seen.add(x)
                    forms.append(x)
        for form in forms[1:]:
            if found := self.nearest(form):
                return found
            if len(ids := self.shortened(form)) == 1:
                return min(ids), 0.0
        # entries inside the value, of any length of it; no entry has more words than the longest
        words = value.split(" ")
        inner = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + self.longest, len(words)) + 1)}
        if hits := [form for form in inner if len(form) > 5 and form in self.exact]:
            return min(self.exact[min(hits, key=lambda x: (-len(x), x))]), 0.0
        if len(value) >= WIDE_FROM and (hits := self.within(value, 3)):
            distance, term = min((weighted(value, entry), min(ids)) for _, entry, ids in hits)
            return term, distance
        return 0, 0.0


_TRIES: dict[tuple, TermTrie] = {}


def decorations(forms: DataFrame, exact: DataFrame, least: int = BESIDE, most: int = 100_000) -> tuple[list[str], list[str]]:
    """(before, after): one or two words that stand before, or after, at least ``least`` different entries among ``forms(form)``.

    ``exact(form)`` are the entries' normal forms. A word needs ``least`` entries of its own, and two-word ones only count where
    the first (or last) word alone does not; more than ``most`` are refused, as the list is in every task.
    """
    words = F.split("form", " ")
    n = F.size(words)
    some = lambda a, k: F.array_join(F.slice(words, a, k), " ")
    cuts = [F.when(n > k, F.struct(F.lit(side).alias("side"), (some(F.lit(1), F.lit(k)) if side == "before" else some(n - k + 1, F.lit(k))).alias("word"), (some(F.lit(k + 1), n) if side == "before" else some(F.lit(1), n - k)).alias("rest"))) for side in ("before", "after") for k in (1, 2)]
    rows = forms.select("form").distinct().select(F.explode(F.array_compact(F.array(*cuts))).alias("x")).select("x.*")
    counted = rows.join(exact.withColumnRenamed("form", "rest"), "rest").groupBy("side", "word").agg(F.count_distinct("rest").alias("n")).where(F.col("n") >= least)
    found = counted.select("side", "word").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} words stand beside entries")
    return [r["word"] for r in found if r["side"] == "before"], [r["word"] for r in found if r["side"] == "after"]


def map_forms(forms: DataFrame, terms: DataFrame, before: Iterable[str] = (), after: Iterable[str] = (), most_terms: int = 100_000) -> DataFrame:
    """form, term_id, distance for the distinct values of ``forms(form)``; term_id 0 is unmatched.

    ``terms(term_id, preferred, synonyms)`` is the reference list; it goes to every task as a broadcast and is a trie there,
    about 10 KB an entry, so a list of more than ``most_terms`` entries is refused. ``before`` and ``after`` are words that may be
    peeled off.
    """
    rows = [tuple(r) for r in terms.select("term_id", "preferred", "synonyms").limit(most_terms + 1).collect()]
    if len(rows) > most_terms:
        raise ValueError(f"the reference list has more than {most_terms} entries")
    listed = sorted(((i, p, tuple(x or ())) for i, p, x in rows), key=lambda r: r[0])
    shared = forms.sparkSession.sparkContext.broadcast((tuple(listed), tuple(sorted(before)), tuple(sorted(after))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value  # the whole content: two lists that differ anywhere have two tries
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = TermTrie(*key)
        find = _TRIES[key].find
        for batch in batches:
            hits = [find(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.float64())], names=["form", "term_id", "distance"]
            )

    # the search is CPU work, which bytes don't show
    return forms.select("form").where(F.col("form") != "").distinct().repartition(spread(forms)).mapInArrow(run, "form string, term_id int, distance double")


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """source_table, row_id, term_id, distance for rows of ``values(source_table, row_id, value)`` that are no entry as they stand."""
    spellings = F.concat(F.array("preferred"), F.coalesce("synonyms", F.array().cast("array<string>")))
    exact = terms.select(F.explode(spellings).alias("form")).select(normal_form(F.col("form")).alias("form")).distinct()
    rows = values.select("source_table", "row_id", normal_form(F.col("value")).alias("form")).where(F.col("form") != "").join(exact, "form", "left_anti")
    return rows.join(map_forms(rows, terms, *decorations(rows, exact)), "form").select("source_table", "row_id", "term_id", "distance")


def term_values(spark, sf_dir: str) -> DataFrame:
    """Mentions and run terms, one row per id with its latest delivery."""
    latest = table(spark, sf_dir, "entities").groupBy("entity_id").agg(F.max_by("text", F.struct("loaded_at", "text")).alias("value"))
    groups = table(spark, sf_dir, "term_groups").groupBy("group_id").agg(F.max_by("term_key", F.struct("counted_at", "term_key")).alias("term_key"))
    after_colon = F.regexp_replace("term_key", "^[^:]*:", "")
    return latest.select(F.lit("entities").alias("source_table"), F.col("entity_id").alias("row_id"), "value").unionByName(
        groups.select(F.lit("term_groups").alias("source_table"), F.col("group_id").alias("row_id"), after_colon.alias("value"))
    )
