"""Effect estimates that abstracts report: a name, a number, an interval, each read by its own step.

Texts without the name of a measure are passed over by one search in the JVM; the rest goes through one Arrow pass, in which
a scanner walks on from every name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# The measures with their labels, long names (any case) and short names (as written).
MEASURES = {
    "OR": ("Odds ratio", ["odds ratio"], ["OR", "aOR"]),
    "HR": ("Hazard ratio", ["hazard ratio"], ["HR", "aHR"]),
    "RR": ("Risk ratio", ["incidence rate ratio", "rate ratio", "relative risk", "risk ratio"], ["IRR", "RR", "aRR"]),
    "SMD": ("Standardised mean difference", ["standardised mean difference", "standardized mean difference"], ["SMD"]),
    "MD": ("Mean difference", ["mean difference", "weighted mean difference"], ["MD", "WMD"]),
    "RD": ("Risk difference", ["risk difference"], ["ARR", "RD"]),
}
RATIOS = ("OR", "HR", "RR")
#: Characters between a name and its estimate, and of a sentence that is shown.
FILLER, SHOWN = 35, 240
MINUS = "-\u2212\u2013"
DASHES = "-\u2013\u2014"

_LONG = {name: kind for kind, (_, names, _) in MEASURES.items() for name in names}
_SHORT = {name: kind for kind, (_, _, names) in MEASURES.items() for name in names}
_NAME = regex.compile(r"(?<![A-Za-z])(?:(?i:\L<long>)|\L<short>)(?![A-Za-z0-9_])", long=list(_LONG), short=list(_SHORT))
_NUMBER = regex.compile(r"\d+(?:\.\d+)?")
_LEVEL = regex.compile(r"95\s*%?\s*")


class Scanner:
    """Reads one text from a place on. Every step gives what it read, or None and stays where it was."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def blanks(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def one_of(self, letters: str) -> str | None:
        if (letter := self.peek()) and letter in letters:
            self.at += 1
            return letter
        return None

    def word(self, *words: str) -> bool:
        for w in words:
            if self.text.startswith(w, self.at):
                self.at += len(w)
                return True
        return False

    def filler(self, signed: bool) -> bool:
        """What stands between a name and its number: no period, dash or digit, unless a dash is the number's sign."""
        for step in range(FILLER + 2):
            letter = self.text[self.at + step : self.at + step + 1]
            if letter.isdecimal() or letter in MINUS:
                # an equals sign or colon before the number, and the blanks after it, are no filler
                passed = self.text[self.at : self.at + step].rstrip()
                if step > FILLER and not (passed.endswith(("=", ":")) and len(passed) <= FILLER + 1):
                    return False
                self.at += step
                return bool(letter) and (signed or letter.isdecimal())
            if letter == ".":
                return False
        return False

    def number(self, signed: bool) -> float | None:
        start = self.at
        negative = signed and self.one_of(MINUS) is not None
        if not (m := _NUMBER.match(self.text, self.at)):
            self.at = start
            return None
        self.at = m.end()
        return -float(m[0]) if negative else float(m[0])

    def label(self) -> bool:
        """The name of the interval, with or without its level."""
        start = self.at
        m = _LEVEL.match(self.text, self.at)
        if m:
            self.at = m.end()
        low = self.text[self.at : self.at + 19].lower()
        for name in ("confidence interval", "confidence limits") if m else ():
            if low.startswith(name):
                self.at += len(name)
                return True
        if low.startswith("ci"):
            self.at += 2
            return True
        self.at = start
        return False

    def opening(self) -> bool:
        """A bracket, with or without a label, or a comma or semicolon with one."""
        self.blanks()
        bracket = self.one_of("([")
        if not bracket and not self.one_of(",;"):
            return False
        self.blanks()
        if self.label():
            self.blanks()
            self.one_of(":=,")
            self.blanks()
            return True
        return bracket is not None

    def between(self, signed: bool) -> bool:
        self.blanks()
        found = self.word("to", ",", ";") or (not signed and self.one_of(DASHES) is not None)
        self.blanks()
        return found


def read_effect(text: str, at: int, kind: str) -> tuple[float, float, float, int] | None:
    """(estimate, lower, upper, end) of what follows the name of a measure, None if it is no estimate with an interval."""
    signed = kind not in RATIOS
    scan = Scanner(text, at)
    if not scan.filler(signed):
        return None
    estimate = scan.number(signed)
    if estimate is None or not scan.opening():
        return None
    lower = scan.number(signed)
    if lower is None or not scan.between(signed):
        return None
    upper = scan.number(signed)
    return None if upper is None else (estimate, lower, upper, scan.at)


def sentence_around(text: str, start: int, end: int) -> str:
    """The sentence (between ". ") that holds a match, shortened to SHOWN characters."""
    first, last = text.rfind(". ", 0, start + 1), text.find(". ", end)
    sentence = text[first + 2 if first >= 0 else 0 : last + 1 if last >= 0 else len(text)].strip()
    return sentence if len(sentence) <= SHOWN else sentence[: SHOWN - 3] + "…"


def effects_in(text: str) -> list[tuple[str, str, float, float, float, str]]:
    """(kind, scale, est, lo, hi, sentence) of the plausible estimates of a text, in order, repeats of the three numbers left out."""
    text = regex.sub(r"\s+", " ", text)
    found = []
    for m in _NAME.finditer(text, overlapped=True):
        kind = _SHORT.get(m[0]) or _LONG[m[0].lower()]
        if (hit := read_effect(text, m.end(), kind)) is None:
            continue
        est, lo, hi, end = hit
        if lo <= est <= hi and (kind not in RATIOS or (lo > 0 and hi / lo < 1000)):
            found.append((m.start(), list(MEASURES).index(kind), kind, est, lo, hi, end))
    out = {}
    for start, _, kind, est, lo, hi, end in sorted(found):
        out.setdefault((est, lo, hi), (kind, "ratio" if kind in RATIOS else "difference", est, lo, hi, sentence_around(text, max(start - 1, 0), end)))
    return list(out.values())


def extract_effects(papers: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, kind, scale, est, lo, hi, sentence of the plausible estimates of each text, in order, repeats left out.

    Null texts have none; no shuffle.
    """
    names = "(?i)" + "|".join([*_LONG, *(rf"\b{n}\b" for n in _SHORT)])
    rows = papers.select(c(key).alias("key"), text.alias("t")).where(c("t").rlike(names))
    kind = papers.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, *e) for k, t in zip(frame.key, frame.t, strict=True) for i, e in enumerate(effects_in(t))]
            yield pd.DataFrame(found, columns=["key", "pos", "kind", "scale", "est", "lo", "hi", "sentence"])

    return rows.mapInPandas(run, f"key {kind}, pos int, kind string, scale string, est double, lo double, hi double, sentence string").withColumnRenamed("key", key)


def primary_effect(effects: DataFrame, key: str, scale: str) -> DataFrame:
    """The first effect of each text on a scale."""
    rest = [x for x in effects.columns if x not in (key, "scale")]
    best = effects.where(c("scale") == scale).groupBy(key).agg(F.min_by(F.struct(*rest), "pos").alias("e"))
    return best.select(key, F.lit(scale).alias("scale"), "e.*")


def measure_label(kind: Column) -> Column:
    return reduce(lambda w, k: w.when(kind == k, MEASURES[k][0]), list(MEASURES)[1:], F.when(kind == "OR", MEASURES["OR"][0]))
