"""Problem 4: spellings of names typed by people that stand for one person or organisation.

Distinct spellings are parsed into a family name (or the coined part of an organisation's name) and given names or
initials; which word is the family name is decided by counts over all spellings (words that stand beside initials or
before a comma, words with few different partners). Spellings with one family name are grouped by given name, where
initials, nicknames and single typing errors agree.

Family names that differ by a typing error are found in the metric space of the Damerau-Levenshtein distance, a true
metric. Its cells are the strings that r deletions lead to: every name is copied to each cell within r deletions of it, two
names within r of each other share a cell (each edit of the metric is one deletion on either side at most), and the names of
a cell are compared with the metric. For r = 1 a cell holds at most one name for each letter and place, so cells stay
small however many names there are; cells around pivots held nearly all names of a length, as most names are equally
far from each other. A rare spelling is linked to a better attested name, never two attested names with each other. What is
rare is told from the occurrences of both names over all rows, so that a typing error that recurs stays one however much
there is to read, while twins, each with people of its own, stay apart.

Defined results: null and blank spellings have no pair; a spelling that occurs often gives its pairs once; spellings without
letters are equal only to themselves and have no pair; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.core.graph import components
from litforge.core.session import cut, table
from litforge.llm.lookalikes import CYRILLIC, CYRILLIC_LATIN, GREEK, GREEK_LATIN

#: Typing errors allowed in a family name.
RADIUS = 1
#: A name with at most this many spellings may be a mistyped form of a better attested one, and so may one that occurs
#: at most this often plus SHARE times as often as the better attested one (one slip is repeated by few per cent).
RARE, SHARE = 2, 0.05
# Short forms of given names.
NICKNAMES = """
alexandru sandu, andrei andy, anton toni, beatriz bia, benjamin ben, carlos carlitos, charlotte lottie, christopher chris, daniel dan, dmitri dima,
dorothea dora, edward ted, elizabeth liz, emilia emmy, eugenia jenny, francisco paco, frederik fred, gabriel gabi, giovanni gianni, helena lena,
isabel bela, iulia iuli, johannes hannes, jonathan jon, jose pepe, joseph joe, katherine kate, kristof kris, lucian luci, margaret peggy, maria mia,
michael mike, mihai misu, nikolaos nikos, octavian tavi, patricia pat, rajesh raj, richard dick, robert bob, roxana roxi, samuel sam, stefan fane,
svetlana sveta, theodor teo, thomas tom, timothy tim, ursula uschi, vanessa nessa, victor vic, wilhelm willi, william bill, zacharias zach
"""
# Words that belong to a family name, and words of organisations' names with their short forms.
PARTICLES = frozenset("van der den de di da du del della la le von zu dos das bin al el".split())
GENERIC = (
    "the of and for study studies group grp consortium conso network netwo registry regist collaborative collab collaboration project trial trials "
    "investigators inves initiative alliance committee"
).split()
FIELDS_OF = "kidney lung heart infection cancer brain liver".split()
TABLE = str.maketrans(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN) | {ord("ß"): "ss", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d", ord("ı"): "i"}
PARTS, PLAIN_PARTS = regex.compile(r"[\p{L}\p{M},]+"), re.compile(r"[A-Za-z,]+")


def fold(text: str) -> str:
    """Letters without accents, look-alike and invisible ones replaced; the case is kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}", "", text)).translate(TABLE)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


SHORT = {b: a for pair in NICKNAMES.split(",") for a, b in [pair.split()]}


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions (a metric)."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    grid = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        grid[i + 1][1] = i
    for j in range(len(b) + 1):
        grid[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            grid[i + 1][j + 1] = min(grid[i][j] + (x != y), grid[i + 1][j] + 1, grid[i][j + 1] + 1, grid[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return grid[-1][-1]


def one_apart(a: str, b: str) -> bool:
    """Whether the Damerau-Levenshtein distance of two words is at most 1, without the table."""
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    a, b = a[i:], b[i:]
    return a[1:] == b[1:] or a == b[1:] or a[1:] == b or a[2:] == b[2:] and a[:2] == b[1::-1]


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for row, word in zip(out, words, strict=True):
        row[: len(word)] = [ord(c) for c in word[:width]]
    return out


def within_one(a: list[str], b: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distances of the pairs (a[i], b[i]) that are 0 or 1, and 2 for all others, without the full table.

    Two words are one edit apart if what is left between their common beginning and common end is one letter on one side,
    one on each, or two that are swapped.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = int(max(la.max(initial=0), lb.max(initial=0))) + 1
    ca, cb = _codes(a, width), _codes(b, width)
    places = np.arange(width)
    shorter = np.minimum(la, lb)
    head = np.where((ca != cb).any(1), (ca != cb).argmax(1), width)
    head = np.minimum(head, shorter)
    ends = lambda codes, n: np.take_along_axis(codes, np.where(places < n[:, None], n[:, None] - 1 - places, width - 1), 1)
    differ = (ends(ca, la) != ends(cb, lb)) | (places >= shorter[:, None])
    tail = np.minimum(differ.argmax(1), shorter - head)
    left, right = la - head - tail, lb - head - tail
    rows = np.arange(len(la))
    at = np.minimum(head, width - 2)
    swap = (left == 2) & (right == 2) & (ca[rows, at] == cb[rows, at + 1]) & (ca[rows, at + 1] == cb[rows, at])
    one = (np.maximum(left, right) == 1) | swap
    return np.where((left == 0) & (right == 0), 0, np.where(one, 1, 2)).astype(np.int16)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distances of the pairs (a[i], b[i]), all pairs of different words at once."""
    differ = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    if len(differ) < len(a):
        out = np.zeros(len(a), np.int16)
        out[differ] = distances([a[i] for i in differ], [b[i] for i in differ])
        return out
    n = len(a)
    if not n:
        return np.zeros(0, np.int16)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wa, wb = int(la.max()), int(lb.max())
    ca, cb = _codes(a, wa), _codes(b, wb)
    far = (la + lb).astype(np.int16)
    grid = np.empty((wa + 2, wb + 2, n), np.int16)
    grid[0], grid[:, 0] = far, far
    grid[1:, 1] = np.arange(wa + 1, dtype=np.int16)[:, None]
    grid[1, 1:] = np.arange(wb + 1, dtype=np.int16)[:, None]
    rows = np.arange(n)
    # the last row before i in which each letter of b occurred in a, per pair
    before = np.zeros((wb, n), np.int32)
    for i in range(1, wa + 1):
        last = np.zeros(n, np.int32)
        x = ca[:, i - 1]
        for j in range(1, wb + 1):
            same = x == cb[:, j - 1]
            k = before[j - 1]
            swap = grid[k, last, rows] + (i - k - 1) + 1 + (j - last - 1)
            grid[i + 1, j + 1] = np.minimum(np.minimum(grid[i, j] + ~same, np.minimum(grid[i + 1, j], grid[i, j + 1]) + 1), swap)
            last = np.where(same, j, last)
        for j in range(wb):
            before[j] = np.where(x == cb[:, j], i, before[j])
    return grid[la + 1, lb + 1, rows]


# ---------------------------------------------------------------- parsing


def words_of(name: str) -> list[tuple[str, str, bool]]:
    """(role, key, before a comma) of the words of a spelling; role: i initials, p particle, w word."""
    text = fold(name)
    flat: list[tuple[str, bool]] = []
    for part in (PLAIN_PARTS if text.isascii() else PARTS).findall(text):
        if "," not in part:
            flat.append((part, False))
        elif part.strip(","):
            for piece in re.findall(r"[^,]+|,", part):
                if piece != ",":
                    flat.append((piece, False))
                elif flat:
                    flat[-1] = (flat[-1][0], True)
    out = []
    for i, (word, comma) in enumerate(flat):
        after = flat[i + 1][0] if i + 1 < len(flat) else ""
        if word.lower() in PARTICLES and len(after) > 2 - (after.lower() in PARTICLES) and (not word.isupper() or after.isupper()):
            role = "p"
        elif len(word) == 1 or len(word) <= 3 and word.isupper() and (len(word) == 2 or len(flat) == 2):
            role = "i"
        else:
            role = "w"
        out.append((role, word.lower(), comma))
    return out


def _ends(known: list[str]) -> dict[str, list[str]]:
    """Known words by their first and by their last two letters; one slip in a word of over four letters leaves one of the two as it is."""
    out = defaultdict(list)
    for k in known:
        for end in (k[:2], "-" + k[-2:]):
            out[end].append(k)
    return dict(out)


ANY_OF = GENERIC + FIELDS_OF
KNOWN = {known: (frozenset(words), _ends(words)) for known, words in (("any", ANY_OF), ("field", FIELDS_OF))}


def _near(word: str, known: str) -> str | None:
    """The word itself if known, else the first known word that is one typing error off."""
    words, ends = KNOWN[known]
    if word in words:
        return word
    if len(word) < 5 or not (near := [*ends.get(word[:2], ()), *ends.get("-" + word[-2:], ())]):
        return None
    return min((k for k in near if len(k) > 4 and one_apart(word, k)), key=ANY_OF.index, default=None)


def is_group(words: list[tuple[str, str, bool]]) -> bool:
    """Whether the words are those of an organisation: two of its generic words, typing errors allowed."""
    long = [w for _, w, _ in words if len(w) > 2]
    return len(long) > 1 and sum(_near(w, "any") is not None for w in long) > 1


def evidence(words: list[tuple[str, str, bool]]) -> list[tuple[str, str | None]]:
    """(word, None) of each word that must be a family name and (word, partner) of words beside others, for the counts over all spellings."""
    if is_group(words):
        return []
    long = [(w, c or i > 0 and words[i - 1][0] == "p") for i, (r, w, c) in enumerate(words) if r == "w"]
    sure = len(long) == 1 and len(words) > 1
    return [(w, None) for w, c in long if sure or c] + [(w, v) for w, _ in long for v, _ in long if v != w]


def undecided(words: list[tuple[str, str, bool]]) -> list[tuple[int, str]]:
    """(place, word) of the words of which the counts over all spellings tell which is the family name; empty if the spelling tells."""
    long = [(i, w) for i, (r, w, _) in enumerate(words) if r == "w"]
    if len(long) < 2 or any(words[i][2] or i and words[i - 1][0] == "p" for i, _ in long) or is_group(words):
        return []
    return long


def parse(words: list[tuple[str, str, bool]], at: int | None) -> tuple[str, str, str, str, str] | None:
    """(kind, family, initial, given, middle initial) of a spelling's words; kind o or p, or None when it holds no letters.

    ``at`` is the place of the family name where the spelling does not tell it.
    """
    if is_group(words):
        field = next((f for _, w, _ in words if (f := _near(w, "field"))), "")
        own = [w for _, w, _ in words if len(w) > 2 and _near(w, "any") is None]
        return ("o", max(own, key=len), field, "", "") if own else None
    long = [i for i, (r, _, _) in enumerate(words) if r == "w"]
    if not long:
        return None
    led = [i for i in long if i and words[i - 1][0] == "p"]
    commas = [i for i in long if words[i][2]]
    if told := led or commas or (long if len(long) == 1 else []):
        at = told[-1]
    family = words[at][1]
    given, middle, initial = "", "", ""
    for i, (r, w, _) in enumerate(words):
        if i == at or r == "p":
            continue
        if initial:
            middle = middle or w[0]
        elif r == "i":
            initial, middle = w[0], w[1:2]
        else:
            given = SHORT.get(w, w)
            initial = given[0]
    return "p", family, initial, given, middle


# ---------------------------------------------------------------- grouping spellings of one family name


def _close_names(names: list[str]) -> dict[str, list[str]]:
    """Per name of over two letters the others that are one edit apart."""
    if len(names) < 10:
        return {g: [h for h in names if h != g and abs(len(g) - len(h)) < 2 and one_apart(g, h)] for g in names if len(g) > 2}
    cells = defaultdict(list)
    for g in names:
        for form in {g, *(g[:i] + g[i + 1 :] for i in range(len(g)))}:
            cells[form].append(g)
    near: dict[str, set[str]] = defaultdict(set)
    for cell in cells.values():
        for g in cell if len(cell) > 1 else ():
            if len(g) > 2:
                near[g].update(h for h in cell if h != g and h not in near[g] and one_apart(g, h))
    return {g: list(x) for g, x in near.items()}


def group_given(rows: list[tuple[str, str, str, int, int, int]]) -> list[str]:
    """The part that each row of one family name belongs to: its given name or, where that is not known, its initial.

    Rows are (initial, given, middle initial, spellings, occurrences, occurrences of the given name beside all family
    names), by which last a given name of its own is known from a mistyped one. Full given names are joined when they
    are one edit apart and one of them is rare; rows with initials only join the given names that start with the initial, told
    apart by middle initials if there are several.
    """
    counts: Counter = Counter()
    seen: Counter = Counter()
    everywhere = {}
    for _, g, _, n, occurrences, given_seen in rows:
        if g:
            counts[g] += n
            seen[g] += occurrences
            everywhere[g] = given_seen
    near = _close_names(list(counts)) if len(counts) > 1 else {}

    def slip(g: str, h: str) -> bool:
        return seen[g] < seen[h] and seen[g] <= RARE + SHARE * seen[h] and everywhere[g] <= RARE + SHARE * everywhere[h]

    late = {g for g in near if counts[g] > RARE and any(slip(g, h) for h in near[g])}
    home: dict[str, str] = {}
    #: names that others are joined to, in the order in which they were met
    full: dict[str, int] = {}
    for g in sorted(counts, key=lambda g: (g in late, -counts[g], g)):
        fits = [h for h in near.get(g, ()) if h in full and (counts[g] <= RARE or g in late and slip(g, h))]
        home[g] = min(fits, key=full.__getitem__) if fits else g
        full.setdefault(home[g], len(full))
    middles = {(home[g], m) for _, g, m, *_ in rows if g and m}
    starts: dict[str, list[str]] = defaultdict(list)
    for h in full:
        starts[h[0]].append(h)
    part = []
    for i, g, m, *_ in rows:
        if g:
            part.append(home[g])
            continue
        fits = starts.get(i, [])
        if len(fits) > 1 and m:
            fits = [h for h in fits if (h, m) in middles] or fits
        part.append(fits[0] if len(fits) == 1 else i)
    return part


# ---------------------------------------------------------------- metric-space partitioning


def candidates(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """block, name_a < name_b: the pairs of distinct names of one block of ``names(block, name)`` that share a cell."""

    def cells(form: Column, left: int) -> Column:
        """Hashes of the strings that at most ``left`` deletions lead to."""
        if not left:
            return F.array(F.xxhash64("block", form))
        places = F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1)))
        shorter = F.transform(places, lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form))))
        if left == 1:
            return F.concat(F.array(F.xxhash64("block", form)), F.transform(shorter, lambda x: F.xxhash64("block", x)))
        return F.concat(F.array(F.xxhash64("block", form)), F.flatten(F.transform(F.array_distinct(shorter), lambda x: cells(x, left - 1))))

    copies = names.select("block", "name").distinct().select("block", "name", F.explode(F.array_distinct(cells(F.col("name"), radius))).alias("cell"))
    held = copies.repartition("cell").groupBy("cell").agg(F.collect_list(F.struct("block", "name")).alias("held")).where(F.size("held") > 1)
    # equal hashes of different strings only add pairs, which the metric tells
    one = held.select(F.explode("held").alias("x"), "held")
    two = one.select("x", F.explode(F.filter("held", lambda y: (y["block"] == F.col("x.block")) & (y["name"] > F.col("x.name")))).alias("y"))
    return two.select(F.col("x.block").alias("block"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()


def radius_pairs(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """block, name_a < name_b, distance: all pairs of distinct names of one block of ``names(block, name)`` within ``radius``."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 20_000):
                part = frame.iloc[at : at + 20_000]
                x, y = list(part.name_a), list(part.name_b)
                d = within_one(x, y) if radius == 1 else distances(x, y)
                yield part.assign(distance=d.astype(np.int32))[d <= radius]

    return candidates(names, radius).mapInPandas(measure, "block string, name_a string, name_b string, distance int")


# ---------------------------------------------------------------- the operator


def parsed(names: DataFrame) -> DataFrame:
    """name, occurrences, key of distinct ``names(name, occurrences)``; key is kind|family|initial|given|middle initial."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for name in batch["name"].to_pylist() for t in evidence(words_of(name))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string())], ["word", "partner"])

    def open_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, i, w) for name in batch["name"].to_pylist() for i, w in undecided(words_of(name))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["name", "place", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(words_of(name), at) for name, at in zip(batch["name"].to_pylist(), batch["at"].to_pylist(), strict=True)]
            keys = pa.array([r and "|".join(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch["name"], batch["occurrences"], keys], ["name", "occurrences", "key"])

    # a spelling is taken apart anew in each pass, which costs less than to keep its words
    seen = cut(names.mapInArrow(tokens, "word string, partner string").groupBy("word", "partner").agg(F.count("*").alias("n")))
    sure = seen.where(F.col("partner").isNull()).select("word", F.col("n").alias("sure"))
    beside = seen.where(F.col("partner").isNotNull()).join(sure.select(F.col("word").alias("partner"), F.lit(1).alias("known")), "partner", "left")
    # a given name has a great many partners, of which an estimate is enough
    given = beside.groupBy("word").agg(F.sum(F.when(F.col("known").isNotNull(), F.col("n")).otherwise(0)).alias("given"), F.approx_count_distinct("partner", 0.1).alias("partners"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    known = given.join(sure, "word", "left").select("word", zero("sure").alias("sure"), "given", "partners")
    # the word most often a family name for sure, else one never beside such a word, with most partners, the last
    alone = zero("given") == 0
    order = F.struct(
        F.when(zero("sure") > 0, F.col("sure") / (F.col("sure") + zero("given") + 1)).otherwise(-1.0).alias("sure"), alone.alias("alone"), F.when(alone, zero("partners")).otherwise(-zero("partners")).alias("partners"), "place",
    )
    told = names.select("name").mapInArrow(open_words, "name string, place int, word string").join(known, "word", "left").groupBy("name").agg(F.max_by("place", order).alias("at"))
    return names.join(told, "name", "left").mapInArrow(run, "name string, occurrences long, key string").where(F.col("key").isNotNull())


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, entity and, in one row of an entity, its numbers, from rows sorted by kind and family."""
    columns = ("key", "head", "initial", "given", "middle", "n", "seen", "given_seen")
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in columns), strict=True))
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        kinds = (("key", pa.string()), ("entity", pa.string()), ("n", pa.int64()), ("seen", pa.int64()), ("family_seen", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    for head, family in groupby(rows, key=lambda r: r[1]):
        own = list(family)
        parts = group_given([r[2:] for r in own])
        n, seen = Counter(), Counter()
        for r, part in zip(own, parts, strict=True):
            n[part] += r[5]
            seen[part] += r[6]
        whole = sum(seen.values())
        for r, part in zip(own, parts, strict=True):
            # the numbers stand beside the first key only
            out.append((r[0], f"{head}|{part}", n.pop(part, None), seen.pop(part, None), whole))
        if len(out) >= 10_000:
            yield batch_of()
            out.clear()
    yield batch_of()


def link_names(spellings: DataFrame) -> DataFrame:
    """name, entity: every spelling of ``spellings(name)`` with the entity it stands for (a string of no other meaning).

    A column ``occurrences`` says how often a spelling occurs; without it each row is one occurrence.
    """
    often = F.sum("occurrences") if "occurrences" in spellings.columns else F.count("*")
    names = cut(spellings.where(F.col("name").isNotNull() & F.col("name").rlike(r"\p{L}")).groupBy("name").agg(often.alias("occurrences")))
    found = cut(parsed(names))
    # what follows depends on a spelling by its key alone
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.sum("occurrences").alias("seen"))
    field = F.split("key", r"\|", -1)
    keys = keys.select("key", F.substring_index("key", "|", 2).alias("head"), field[2].alias("initial"), field[3].alias("given"), field[4].alias("middle"), "n", "seen")
    full = keys.where(F.col("given") != "")
    given = full.groupBy("given").agg(F.sum("seen").alias("given_seen"))
    keys = full.join(given, "given").unionByName(keys.where(F.col("given") == "").withColumn("given_seen", F.lit(0).cast("long")))
    split = cut(keys.repartition("head").sortWithinPartitions("head").mapInArrow(_entities, "key string, entity string, n long, seen long, family_seen long"))
    part = F.split("entity", r"\|", -1)
    sizes = split.where(F.col("n").isNotNull()).select("entity", part[0].alias("kind"), part[1].alias("family"), part[2].alias("part"), "n", "seen", "family_seen")
    first = F.when(F.col("kind") == "o", F.col("part")).otherwise(F.substring("part", 1, 1))
    sizes = sizes.withColumn("block", F.concat("kind", first))
    near = radius_pairs(sizes.select("block", F.col("family").alias("name")))
    both = near.select("block", F.explode(F.array(F.struct(F.col("name_a").alias("x"), F.col("name_b").alias("y")), F.struct(F.col("name_b").alias("x"), F.col("name_a").alias("y")))).alias("p")).select("block", "p.x", "p.y")
    rare = sizes.select("block", F.col("family").alias("x"), F.col("part").alias("part_x"), F.col("n").alias("n_x"), F.col("seen").alias("seen_x"), F.col("family_seen").alias("family_x"), F.col("entity").alias("a"))
    known = sizes.select("block", F.col("family").alias("y"), F.col("part").alias("part_y"), F.col("n").alias("n_y"), F.col("seen").alias("seen_y"), F.col("family_seen").alias("family_y"), F.col("entity").alias("b"))
    same = (F.col("part_x") == F.col("part_y")) | (F.length("part_x") <= 1) | (F.length("part_y") <= 1) | (F.levenshtein("part_x", "part_y") <= 2)
    better = (F.col("n_y") > F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("y") < F.col("x")))
    # a slip is rare beside its name, with this given name and with all: a family name of other people is none
    slip = (F.col("seen_x") < F.col("seen_y")) & (F.col("seen_x") <= RARE + SHARE * F.col("seen_y")) & (F.col("family_x") <= RARE + SHARE * F.col("family_y"))
    # an umlaut written with e is the same letter, however often it is written so
    umlaut = F.regexp_replace("x", "(?<=[aou])e", "") == F.regexp_replace("y", "(?<=[aou])e", "")
    fit = F.struct((F.col("part_x") == F.col("part_y")).alias("equal"), "n_y", "b")
    links = both.join(rare, ["block", "x"]).join(known, ["block", "y"]).where(same & (better & ((F.col("n_x") <= RARE) | umlaut) | slip)).groupBy("a").agg(F.max_by("b", fit).alias("b"))
    # an entity without a link is a component of its own
    joined = components(links).select(F.col("node").alias("entity"), "component")
    whole = split.select("key", "entity").join(joined, "entity", "left").select("key", F.coalesce("component", "entity").alias("entity"))
    return found.select("name", "key").join(whole, "key").select("name", "entity")


def name_pairs(linked: DataFrame) -> DataFrame:
    """name_a < name_b: the pairs of spellings of one entity."""
    b = linked.select(F.col("name").alias("name_b"), "entity")
    return linked.select(F.col("name").alias("name_a"), "entity").join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def author_spellings(spark, sf_dir: str) -> DataFrame:
    """name, occurrences: spellings of authors and study groups in the three places that hold them."""
    articles, works = table(spark, sf_dir, "articles"), table(spark, sf_dir, "crossref_works")
    full: Column = F.transform("authors_full", lambda x: F.when(F.coalesce(x["collective"], F.lit("")) != "", x["collective"]).otherwise(F.concat(x["fore_name"], F.lit(" "), x["last_name"])))
    cross: Column = F.transform("author", lambda x: F.coalesce(x["org_name"], F.concat(x["given"], F.lit(" "), x["family"])))
    return (
        articles.select(F.explode("authors").alias("name"))
        .union(articles.select(F.explode(full)))
        .union(works.select(F.explode(cross)))
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.count("*").alias("occurrences"))
    )
