"""Problem 10: sentence boundaries across languages and scripts.

A pushdown automaton runs over the marks of a text (terminators, quotation marks, brackets, line breaks, list
markers). Its stack holds the closing mark expected for each open quotation or bracket; a terminator ends a
sentence only when the stack is empty after the closing marks that follow it. A second stack holds the markers of the
list levels that are open: a known marker closes the levels above its own, a new one opens a level. Periods are looked up in a trie of
reversed abbreviations. Scripts without capitals, without spaces or without terminators have their own rules.
Offsets are Unicode code points, counted from 0, end exclusive.

Defined results: null, empty and blank texts have no sentences; whole texts are read, whatever their length;
repeated texts give equal offsets; a mark that is never closed is taken as ordinary text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations after which a sentence goes on even before a capital or a digit.
NEVER = """
abb adv al approx art bd bl bsp bzgl bzw ca cap cf cfr ch chap co col comp corp dl dna doc dott dr dra dipl ed eds ej
eq ev evtl ex ext fig figs gen geb gl hr hrsg inc ing jh kap lt ltd med mgr mlle mme mons mr mrs ms mt nº nr núm num no
op pag pág par pl pp p prof profa rel resp rev sec sect sen sig sog spp sr sra srta st ste str sv tab tabl tel tr univ
us v var vgl vol vs z zit
см рис табл проф акад доц им напр ср стр гл ред изд
δρ βλ εικ πίν κ σελ καθ πχ
د أ م ص
डॉ श्री प्रो
""".split()
# Abbreviations that may also end a sentence, before a capital or an opening mark.
MAY = "etc usw uä ua ff ecc al d.r jr sr inc ltd corp am pm г гг др т.д т.п κ.λπ κλπ bid tid qid ad".split()
# Month names that follow an ordinal number with a period.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez jänner".split()

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‹": "›", "‚": "‘’", "»": "«"}
CLOSE = set(")]}）］】〕」』》〉»“”›«\"")
BRACKETS = set(")]}）］】〕")
WIDE = "。！？｡।॥؟۔．"
BLANK = regex.compile(r"(?>\r\n|[\n\r \x85])[^\S\r\n \x85]*(?:(?>\r\n|[\n\r \x85])\s*)+| \s*")
MARK = regex.compile(r"""[.!?…;;。！？｡।॥؟۔．]+|[()\[\]{}（）［］【】〔〕「」『』《》〈〉«»„“”‹›"]|[\n\r \x85]\s*|(?<=[฀-ๅ็-໿])[   -​ 　\t]+""")
LABEL = regex.compile(r"(?:[\p{Lu}][\p{Lu}\p{M} /&-]{2,40}|[\p{Lo}\p{M}][\p{Lo}\p{M} ]{1,24}|\p{Lu}\p{Ll}+(?: \p{L}+){0,2})[:：](?=\s|\p{Lo})")
BULLET = regex.compile(r"(?:[-–*]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)])[^\S\r\n]+(?=\S)")
DOT = regex.compile(r"[•‣▪◦●]\s*")
MARKER_ONLY = regex.compile(r"\s*(?:[-–*•]\s*)?\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})\Z")
THAI = regex.compile(r"[฀-໿]")
INITIAL = regex.compile(r"(?:^|[\s(\[„“«\"'’\-.])\p{L}\Z")
ACRONYM = regex.compile(r"(?:^|[\s(\[„“«\"'])(?:\p{L}\.)+\p{L}\Z")
CASELESS = regex.compile(r"[\p{Lo}\p{M}][)\]”»]?\Z")
LOWER_WORD = regex.compile(r"(?:\p{Ll}{2,}|\d\p{Ll}|[\p{Lo}\p{M}]+|\d|[)%\]»”])\Z")
ORDINAL = regex.compile(r"(?:^|\s)\d{1,2}\Z")
DAY = regex.compile(r"\b(?:[aA]m|[vV]om|[zZ]um|[bB]eim|[dD]e[nmrs])\s+\d{1,2}\Z")
GREEK = regex.compile(r"\p{Greek}")
HIRAGANA = regex.compile(r"[ぁ-ゟ]")
CASELESS_NEXT = regex.compile(r"\p{Ll}[\p{L}\p{M}]*\s+\p{Lo}")
TITLE_WORD = regex.compile(r"\p{Lu}(?:\p{Ll}|\s|['’])")
UNSEEN = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
#: Cyrillic and Greek letters that look like Latin ones, so that abbreviations are known in such spellings too.
LATIN = str.maketrans("аеорсухіјѕοναЕТ", "aeopcyxijsovaET")
GO_ON = set(",，、；;:：—–-·，")


def _trie(words: list[str], value: str, root: dict) -> None:
    for word in words:
        node = root
        for letter in reversed(word):
            node = node.setdefault(letter, {})
        node.setdefault("", value)


ABBREVIATIONS: dict = {}
_trie(MAY, "may", ABBREVIATIONS)
_trie(NEVER, "never", ABBREVIATIONS)


def abbreviation(text: str, start: int, dot: int) -> str | None:
    """What the trie says of the word before the period at ``dot``: "may" end, "never" ends, or None."""
    node, found, i = ABBREVIATIONS, None, dot - 1
    while True:
        while i >= start and text[i] in UNSEEN:
            i -= 1
        if "" in node and (i < start or not (text[i].isalnum() or text[i] == "." or regex.match(r"\p{M}", text[i]))):
            found = node[""]
        if i < start:
            return found
        node = node.get(unicodedata.normalize("NFKC", text[i]).translate(LATIN).lower())
        if node is None:
            return found
        i -= 1


class Automaton:
    """One run over one block (text between blank lines)."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.last: dict[str, int] = {}

    def closes(self, mark: str, at: int) -> bool:
        """Whether a mark stands in the block from ``at`` on; its last place is looked up once."""
        if mark not in self.last:
            self.last[mark] = self.text.rfind(mark, self.start, self.end)
        return self.last[mark] >= at

    @staticmethod
    def level(marker: str) -> str:
        """What the markers of one list level have in common: the bullet, or digit, letter or numeral with what follows it."""
        kind = marker.strip()
        return regex.sub(r"\d+", "1", regex.sub(r"[ivx]{2,}", "i", regex.sub(r"[a-z](?![a-z])", "a", kind))) if len(kind) > 1 else kind

    def next_at(self, at: int) -> int:
        text, end = self.text, self.end
        while at < end and (text[at].isspace() or text[at] in UNSEEN):
            at += 1
        return at

    def starts(self, at: int) -> str:
        """Class of what begins at ``at``: U upper, l lower, c caseless, d digit, o other; opening marks are passed."""
        text, end, seen = self.text, self.end, False
        while at < end and (text[at] in OPEN or text[at] in "¿¡\"'’‘" or text[at].isspace() and seen):
            seen, at = True, at + 1
        if at >= end:
            return "o"
        c = text[at]
        if c.isdigit():
            return "d"
        if c.isalpha():
            return "U" if c.isupper() or c.istitle() else "l" if c.islower() else "c"
        return "o"

    def ends(self, sent: int, run_start: int, run_end: int, at: int, closed: bool) -> bool:
        """Whether the terminators run_start..run_end, with closing marks up to ``at``, end the sentence begun at ``sent``."""
        text = self.text
        run = text[run_start:run_end]
        nxt = self.next_at(at)
        if nxt >= self.end:
            return True
        follows, gap = text[nxt], nxt > at
        if any(c in WIDE for c in run):
            if follows in GO_ON:
                return False
            return not (closed and not gap and HIRAGANA.match(follows))
        if set(run) <= {";", ";"}:
            return gap and self.is_greek(run_start)
        if follows in GO_ON:
            return False
        kind = self.starts(nxt)
        dot = run == "."
        if not gap:
            acronym = dot and TITLE_WORD.match(text, nxt) and ACRONYM.search(text, max(sent, run_start - 30), run_start)
            if kind not in "Uc" or not (acronym or LOWER_WORD.search(text, max(sent, run_start - 40), run_start)):
                return False
            left = run_start
            while left > sent and not text[left - 1].isspace():
                left -= 1
            token = text[left : run_start + 12]
            if "@" in token or "://" in token or token.lower().startswith("www."):
                return False
        if kind == "l" and CASELESS_NEXT.match(text, nxt):
            kind = "c"
        if kind == "l" and not CASELESS.search(text, max(sent, run_start - 2), run_start):
            return False
        if dot and not closed:
            if MARKER_ONLY.match(text[sent:run_start]):
                return False
            what = abbreviation(text, sent, run_start)
            if ACRONYM.search(text, max(sent, run_start - 30), run_start):
                return kind in "Uc" and what != "never"
            if what == "may":
                return kind in "Uco"
            if what == "never" or INITIAL.search(text, max(sent, run_start - 4), run_start):
                return False
            if DAY.search(text, max(sent, run_start - 10), run_start):
                return False
            if ORDINAL.search(text, max(sent, run_start - 4), run_start):
                word = regex.match(r"\p{L}+", text[nxt : nxt + 16])
                if word and word[0].lower() in MONTHS:
                    return False
        return True

    def is_greek(self, at: int) -> bool:
        near = regex.findall(r"\p{L}", self.text[max(self.start, at - 60) : at])
        return sum(bool(GREEK.match(c)) for c in near) * 2 > len(near)

    def run(self) -> list[tuple[int, int]]:
        text, end = self.text, self.end
        out: list[tuple[int, int]] = []
        sent, at, stack, levels = self.start, self.start, [], []
        soft: list[bool] = []
        while at < end and (mark := MARK.search(text, at, end)):
            m, c = mark.start(), text[mark.start()]
            at = mark.end()
            if c.isspace() or c == "​":
                if c in "\n\r \x85":
                    item = DOT.match(text, at, end) or BULLET.match(text, at, end)
                    before = text[sent:m].rstrip()
                    last = before[-1:] if before else ""
                    stops = bool(item and (DOT.match(text, at, end) or levels or last in ":;：；.!?。")) or bool(LABEL.match(text, at, end) and last and last not in ",，、;")
                    if stops:
                        mark_ = self.level(item[0]) if item else ""
                        levels = [*levels[: levels.index(mark_) if mark_ in levels else len(levels)], mark_] if item else []
                        stack.clear()
                    if not stops and not stack and THAI.match(text, m - 1) and at < end:
                        stops = THAI.match(text, at) is not None or text[at].isupper()
                    if stops and before:
                        out.append((sent, m))
                        soft.append(False)
                        sent = at
                elif not stack and at < end and (THAI.match(text, at) or text[at].isupper() or regex.match(r"[\p{Lo}]", text[at])):
                    out.append((sent, m))
                    soft.append(False)
                    sent = at
                continue
            if c in ".!?…;;" or c in WIDE:
                j, closed, depth = at, False, list(stack)
                while depth:
                    k = j
                    while k < end and text[k].isspace() and text[k] not in "\n\r":
                        k += 1
                    if k < end and text[k] in depth[-1]:
                        depth.pop()
                        j, closed = k + 1, True
                    else:
                        break
                if depth:
                    continue
                while j < end and text[j] in CLOSE and text[j] not in OPEN and text[j] != '"':
                    j, closed = j + 1, True
                stack = depth
                at = j
                if self.ends(sent, m, mark.end(), j, closed):
                    out.append((sent, j))
                    soft.append(all(x in "!?" for x in text[m : mark.end()]))
                    sent = j
                continue
            if stack and c in stack[-1]:
                stack.pop()
            elif c in BRACKETS or c in "”»›" and c not in OPEN:
                if any(c in x for x in stack):
                    while c not in stack.pop():
                        pass
            elif c == '"':
                if self.closes('"', at):
                    stack.append('"')
            elif c in OPEN:
                if any(self.closes(x, at) for x in OPEN[c]):
                    stack.append(OPEN[c])
        if sent < end:
            out.append((sent, end))
            soft.append(False)
        if len(out) > 1 and all(soft[:-1]) and self.title():
            return [(self.start, end)]
        return out

    def title(self) -> bool:
        """Whether the block has no terminator at its end, as titles have."""
        tail = self.text[self.start : self.end].rstrip().rstrip("".join(CLOSE) + " ")
        return tail[-1:] not in ".!?…" + WIDE + ("" if not GREEK.search(tail) else ";")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text."""
    if not text:
        return []
    out, at = [], 0
    blocks = []
    for gap in BLANK.finditer(text):
        blocks.append((at, gap.start()))
        at = gap.end()
    blocks.append((at, len(text)))
    for a, b in blocks:
        for s, e in Automaton(text, a, b).run() if a < b else ():
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: ``key``, start_pos, end_pos (int). No shuffle; other columns are not carried."""
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for s, e in sentences(value):
                    rows.append(i)
                    starts.append(s)
                    stops.append(e)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=[key, "start_pos", "end_pos"])

    return source.mapInArrow(run, schema)
