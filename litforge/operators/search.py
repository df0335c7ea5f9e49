"""Search expressions compiled from a table of searches, translation of terms, and shareable search states."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qs, urlencode

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.data import load
from litforge.functions.text import given, looks_romanian, strip, truthy

c = F.col

# Filters with their labels and search clauses.
ARTICLE_TYPES = [
    ("meta", "Meta-analysis", "meta-analysis[pt]"), ("sr", "Systematic review", "systematic review[pt]"), ("rct", "Randomized controlled trial", "randomized controlled trial[pt]"),
    ("trial", "Clinical trial", "clinical trial[pt]"), ("guideline", "Guideline", "(guideline[pt] OR practice guideline[pt])"), ("review", "Review", "review[pt]"),
    ("obs", "Observational study", "observational study[pt]"), ("case", "Case report", "case reports[pt]"),
]
LANGUAGES = [(k.lower(), k) for k in "English Romanian French German Spanish Italian".split()]
AGES = [("child", "Children (0–18)", "(infant[mh] OR child[mh] OR adolescent[mh])"), ("adult", "Adults (19–64)", "(adult[mh] OR middle aged[mh])"), ("aged", "Older adults (65+)", "aged[mh]")]
CLINICAL = [("therapy", "Therapy", "Therapy"), ("diagnosis", "Diagnosis", "Diagnosis"), ("etiology", "Etiology / harm", "Etiology"), ("prognosis", "Prognosis", "Prognosis"), ("prediction", "Clinical prediction guides", "Clinical Prediction Guides")]
#: Schema of a row of searches.
SEARCHES = "base string, from_year int, to_year int, types array<string>, free_full_text boolean, humans boolean, languages array<string>, ages array<string>, sex string, clinical string, scope string"
EMPTY_FILTERS = {"from_year": None, "to_year": None, "types": [], "free_full_text": False, "humans": False, "languages": [], "ages": [], "sex": "", "clinical": None, "scope": None}


def any_of(clauses: Column) -> Column:
    """Alternatives joined by OR, in parentheses if there are several; null if there are none."""
    joined = F.array_join(clauses, " OR ")
    return F.when(F.size(clauses) == 1, joined).when(F.size(clauses) > 1, F.concat(F.lit("("), joined, F.lit(")")))


def _picked(options: list[tuple], column: str, which: int) -> Column:
    """Values of the options whose key is in an array column, in the options' order."""
    return F.array_compact(F.array(*[F.when(F.array_contains(column, o[0]), F.lit(o[which])) for o in options]))


def full_query(base: Column | None = None) -> Column:
    """The search of a row: its terms and every active filter, joined by AND."""
    base = strip(c("base") if base is None else base)
    years = F.format_string('("%d/01/01"[dp] : "%d/12/31"[dp])', F.coalesce("from_year", F.lit(1800)), F.coalesce("to_year", F.lit(3000)))
    tag = F.element_at(F.create_map(*[F.lit(x) for k, _, t in CLINICAL for x in (k, t)]), c("clinical"))
    return F.concat_ws(
        " AND ", F.when(truthy(base), F.concat(F.lit("("), base, F.lit(")"))), any_of(_picked(ARTICLE_TYPES, "types", 2)),
        F.when(c("from_year").isNotNull() | c("to_year").isNotNull(), years), F.when(c("free_full_text"), "free full text[sb]"), F.when(c("humans"), "humans[mh]"),
        any_of(F.transform("languages", lambda x: F.concat(x, F.lit("[la]")))), any_of(_picked(AGES, "ages", 2)), F.when(truthy(c("sex")), F.concat(c("sex"), F.lit("[mh]"))),
        F.concat(tag, F.when(c("scope") == "narrow", "/Narrow[filter]").otherwise("/Broad[filter]")),
    )


def active_filters(searches: DataFrame, key: str) -> DataFrame:
    """key, pos, filter, label of the active filters of each search, in display order."""
    pair = lambda k, label: F.struct(k.alias("filter"), label.alias("label"))
    lit = F.lit
    years = F.when(c("from_year").isNotNull() & c("to_year").isNotNull(), F.concat_ws("–", c("from_year").cast("string"), c("to_year").cast("string"))).when(c("from_year").isNotNull(), F.concat(lit("From "), c("from_year"))).otherwise(F.concat(lit("Until "), c("to_year")))
    many = lambda options, column, prefix: [F.when(F.array_contains(column, o[0]), pair(lit(f"{prefix}-{o[0]}"), lit(o[1]))) for o in options]
    name = F.coalesce(F.element_at(F.create_map(*[lit(x) for k, label, _ in CLINICAL for x in (k, label)]), c("clinical")), c("clinical"))
    chips = F.array_compact(F.array(
        F.when(c("from_year").isNotNull() | c("to_year").isNotNull(), pair(lit("years"), years)), *many(ARTICLE_TYPES, "types", "type"),
        F.when(c("free_full_text"), pair(lit("fft"), lit("Free full text"))), F.when(c("humans"), pair(lit("humans"), lit("Humans"))),
        *many(LANGUAGES, "languages", "lang"), *many(AGES, "ages", "age"),
        F.when(truthy(c("sex")), pair(lit("sex"), F.initcap("sex"))), F.when(c("clinical").isNotNull(), pair(lit("clinical"), F.concat(lit("Clinical query: "), name, lit(" ("), c("scope"), lit(")")))),
    ))
    return searches.select(key, F.posexplode(chips).alias("pos", "chip")).select(key, "pos", "chip.*")


def pico_query(p: Column, i: Column, comparison: Column, o: Column) -> Column:
    """P AND (I OR C) AND O; a field may list alternatives with commas or semicolons."""

    def group(field: Column) -> Column:
        terms = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), "[,;]"), lambda t: strip(t)), lambda t: t != "")
        return any_of(F.transform(terms, lambda t: F.when(t.rlike(r"\s") & ~t.rlike(r'[\[\]"()]'), F.concat(F.lit("("), t, F.lit(")"))).otherwise(t)))

    both = group(i), group(comparison)
    middle = F.when(both[0].isNotNull() & both[1].isNotNull(), F.concat(F.lit("("), both[0], F.lit(" OR "), both[1], F.lit(")"))).otherwise(F.coalesce(*both))
    return F.concat_ws(" AND ", group(p), middle, group(o))


def narrow(query: Column, term: Column) -> Column:
    return F.concat(F.lit("("), query, F.lit(') AND "'), term, F.lit('"[tiab]'))


# ---------------------------------------------------------------- translation

_ACCENTS = {"a": "aăâ", "i": "iî", "s": "sșş", "t": "tțţ"}
_CONNECTIVES = {"și": "AND", "si": "AND", "sau": "OR", "fără": "NOT", "fara": "NOT"}
_KEPT = regex.compile(r'"[^"]*"(?:\[[^\]]*\])?|\[[^\]]*\]')
_WORD = regex.compile(r"(?<!\p{L})(?:" + "|".join(_CONNECTIVES) + r")(?!\p{L})", regex.I)
_LEFT_OVER = regex.compile(r"[\p{L}-]*[ăâîșțşţ][\p{L}-]*", regex.I)


class Glossary:
    """Replaces known terms in list order; letters match with and without marks, capitals are kept.

    A term in capitals (2 to 5) matches as written. With ``endings`` the last vowel of each longer word may be left out
    or be another ending, so inflected forms are known by rule.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]], endings: Iterable[str] = ()):
        self.plain = {m: base for base, marks in _ACCENTS.items() for m in marks}
        self.endings = "|".join(self._loose(e) for e in sorted(endings, key=len, reverse=True))
        self.entries = []
        for term, english in pairs:
            exact = term.isupper() and 2 <= len(term) <= 5
            body = regex.escape(term) if exact else r"\s+".join(self._word(w) for w in term.lower().split())
            self.entries.append((regex.compile(rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])", 0 if exact else regex.I), english, exact))

    def _loose(self, text: str) -> str:
        return "".join(f"[{_ACCENTS[self.plain[x]]}]" if x in self.plain else regex.escape(x) for x in text)

    def _word(self, word: str) -> str:
        if not self.endings or len(word) < 4:
            return self._loose(word)
        stem = word[:-1] if word[-1] in "aăâeiu" else word
        return f"{self._loose(stem)}(?:{self.endings})?"

    @classmethod
    def standard(cls) -> Glossary:
        """The built-in list, longest terms first."""
        data = load("glossary")
        return cls(sorted((data["terms"] | data["abbreviations"]).items(), key=lambda p: -len(p[0])), data["endings"])

    @classmethod
    def typed(cls, text: str) -> Glossary:
        """Entries typed one "term = english" per line, the longest first; other lines are left out."""
        pairs = [tuple(x.strip() for x in line.split("=")) for line in text.splitlines()]
        return cls(sorted((p for p in pairs if len(p) == 2 and all(p)), key=lambda p: -len(p[0])))

    def __add__(self, other: Glossary) -> Glossary:
        """Both lists, this one's terms first."""
        both = Glossary(())
        both.entries = self.entries + other.entries
        return both

    def apply(self, text: str) -> tuple[str, int]:
        """The text with terms replaced, and how many; text inside square brackets stays."""
        count = 0
        for pattern, english, exact in self.entries:

            def swap(m: regex.Match, english: str = english, exact: bool = exact) -> str:
                nonlocal count
                if m.string.rfind("[", 0, m.start()) > m.string.rfind("]", 0, m.start()):
                    return m[0]
                count += 1
                return english[:1].upper() + english[1:] if not exact and m[0][0].isupper() else english

            text = pattern.sub(swap, text)
        return text, count


def romanian(query: str) -> bool:
    """Whether a query has a letter of Romanian or one of its small words, as :func:`litforge.functions.text.looks_romanian` tells for a column."""
    hints = load("romanian_hints")
    return any(x in hints["letters"] for x in query) or not set(hints["words"]).isdisjoint(regex.split(r"[^\p{L}]+", query.lower()))


def translate(query: str, glossary: Glossary) -> tuple[str, int, list[str]]:
    """(text, replaced, untranslated) of a Romanian query; quoted phrases and field tags stay, others are left alone."""
    if not romanian(query):
        return query, 0, []
    out, at, replaced = [], 0, 0
    for m in [*_KEPT.finditer(query), None]:
        piece, n = glossary.apply(query[at : m.start() if m else len(query)])
        replaced += n
        out.append(_WORD.sub(lambda w: _CONNECTIVES[w[0].lower()], piece))
        if m:
            out.append(m[0])
            at = m.end()
    text = regex.sub(r"\s+", " ", "".join(out)).strip()
    return text, replaced, list(dict.fromkeys(_LEFT_OVER.findall(text)))


def translate_table(searches: DataFrame, key: str, query: str, pairs: dict[str, str] | None = None) -> DataFrame:
    """key, text, replaced, untranslated of every query; only queries that look Romanian reach Python."""
    kind = searches.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        glossary = Glossary.standard() if pairs is None else Glossary(pairs.items())
        for frame in frames:
            yield pd.DataFrame([(k, *translate(q, glossary)) for k, q in zip(frame.key, frame.q, strict=True)], columns=["key", "text", "replaced", "untranslated"])

    rows = searches.select(c(key).alias("key"), c(query).alias("q"))
    found = rows.where(looks_romanian(c("q"))).mapInPandas(run, f"key {kind}, text string, replaced int, untranslated array<string>")
    rest = rows.where(~F.coalesce(looks_romanian(c("q")), F.lit(False))).select("key", c("q").alias("text"), F.lit(0).alias("replaced"), F.array().cast("array<string>").alias("untranslated"))
    return found.unionByName(rest).withColumnRenamed("key", key)


# ---------------------------------------------------------------- states


def encode_state(query: str, count: int = 50, sort: str = "relevance", filters: dict | None = None) -> str:
    """A search as a link fragment; only filters that differ from none are in it."""
    changed = {k: v for k, v in (filters or {}).items() if EMPTY_FILTERS.get(k) != v}
    parts = {"q": query, "n": count, "s": sort} | ({"f": json.dumps(changed, separators=(",", ":"), ensure_ascii=False)} if changed else {})
    return "#" + urlencode(parts)


def decode_state(fragment: str) -> dict | None:
    """The search of a fragment, None without a query; a count that is none is 50, malformed filters are ignored."""
    parts = {k: v[0] for k, v in parse_qs(fragment.lstrip("#")).items()}
    if not parts.get("q"):
        return None
    try:
        filters = EMPTY_FILTERS | json.loads(parts.get("f", "{}"))
    except (ValueError, TypeError):
        filters = dict(EMPTY_FILTERS)
    count = parts.get("n", "")
    return {"query": parts["q"], "count": int(count) if count.isdigit() and int(count) > 0 else 50, "sort": "pub_date" if parts.get("s") == "pub_date" else "relevance", "filters": filters}


def state_fragment(query: Column, count: Column, sort: Column, filters: Column | None = None) -> Column:
    """The fragment of a search as a column; ``filters`` is the JSON text of what differs from none (null or "{}": nothing)."""
    base = F.concat(F.lit("#q="), F.url_encode(query), F.lit("&n="), count.cast("string"), F.lit("&s="), given(sort))
    if filters is None:
        return base
    return F.concat(base, F.when(F.coalesce(filters, F.lit("{}")) != "{}", F.concat(F.lit("&f="), F.url_encode(filters))).otherwise(""))


def changed_filters() -> Column:
    """JSON text of the filters of a row of searches that differ from none; the clinical question is one object of category and scope."""
    some = lambda name: F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) > 0, c(name)).alias(name)
    yes = lambda name: F.when(c(name), c(name)).alias(name)
    clinical = F.when(c("clinical").isNotNull(), F.struct(c("clinical").alias("category"), "scope")).alias("clinical")
    return F.to_json(F.struct("from_year", "to_year", some("types"), yes("free_full_text"), yes("humans"), some("languages"), some("ages"), given(c("sex")).alias("sex"), clinical))


def history_key(query: Column, sort: Column, filters: Column | None = None) -> Column:
    """Key of a search in the history: its fragment without the number of papers asked for."""
    return state_fragment(query, F.lit(0), sort, filters)
