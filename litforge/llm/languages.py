"""Problem 5: the language of documents and of the segments of mixed ones.

Hyperdimensional profiles: every letter has a random vector of +1 and -1 drawn from its code point, an n-gram is the
product of its letters' vectors, each rotated by its place, a text is the sum (bundle) of its n-grams, a language
prototype the sum of the unit bundles of its texts. Prototypes are centred on their mean, which takes out what all
languages share (names of substances, numbers), and a sentence is compared with them by cosine.

The prototypes are bundled from all rows whose declared label names a language, then once more from their sentences
whose language by the first prototypes is the declared one or nearly so, so that wrong labels and mixed texts wash out. Each task
bundles its own rows and sends one vector per language; only languages x dimensions numbers reach the driver.

A run of sentences in one language is found by the cheapest path through the sentences, in which a change of
language has a price. A second language of an abstract counts from ``LEAST_SENTENCES`` sentences on, a title by itself, unless it is a
single word.

Confidence is the margin of the cosine over the next language's, scaled to 0.5 to 1; it orders segments and is no probability.
Texts in a language that no label names get the nearest of those that labels name.

Defined results: null, empty, blank and placeholder fields have no language and no segment; rows without any usable
text get no row; repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.llm.sentences import sentences

#: Dimensions of the vectors; a parameter of the fit.
DIMENSIONS = 2048
#: Price of a change of language between two sentences, in units of (cosine x root of words).
CHANGE = 0.55
LEAST_SENTENCES = 2
#: How much nearer another language must be before the second pass takes a declared label for wrong.
DOUBT = 0.12
#: Word bundles remembered by one Python worker; emptied when full.
MEMO = 15_000
# Codes and names of the languages in other notations.
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español castellano",
    "fr": "fr fra fre french français",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語",
    "pt": "pt por portuguese português",
    "ro": "ro ron rum romanian română mo",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi cmn chinese 中文",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
PLACEHOLDER = regex.compile(r"[\W\d_]*(?:n/?a|none|null|unknown|not available|no abstract(?: available)?)?[\W\d_]*\Z", regex.I)
WORD = regex.compile(r"[\p{Han}々]+|[\p{Hiragana}\p{Katakana}ー]+|(?:[^\W\d_\p{Han}\p{Hiragana}\p{Katakana}]\p{M}*)+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
LATIN = regex.compile(r"\p{Latin}")
UNSEEN = regex.compile(r"\p{Cf}")
LABEL = regex.compile(r"\s*\p{Lu}[\p{Lu}\p{M} ]+:|\s*[\p{Han}\p{Hiragana}\p{Katakana}]{2,5}[:：]")


def code(label: str | None) -> str | None:
    """Two-letter code of a declared label in any notation; None if it names none of the languages."""
    if not label:
        return None
    return CODES.get(regex.split(r"[-_\s(]", label.strip().lower())[0])


class Space:
    """The random letter vectors of one number of dimensions and what is built from them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[str, list[np.ndarray]] = {}
        self.words: dict[str, np.ndarray] = {}

    def letter(self, letter: str) -> list[np.ndarray]:
        """The letter's vector rotated by 0, 1, 2 and 3 places."""
        if letter not in self.letters:
            bits = np.random.default_rng(1_000_003 + ord(letter)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            self.letters[letter] = [np.roll(bits, place) for place in range(4)]
        return self.letters[letter]

    def word(self, word: str) -> np.ndarray:
        """Bundle of the n-grams of a word: 1 to 2 letters where a letter is a word, else 2 to 4 with its edges."""
        found = self.words.get(word)
        if found is None:
            sizes, text = ((1, 2), word) if CJK.match(word) else ((2, 3, 4), f" {word} ")
            found = np.zeros(self.dimensions, np.int16)
            for n in sizes:
                for i in range(len(text) - n + 1):
                    gram = self.letter(text[i])[n - 1]
                    for k in range(1, n):
                        gram = gram * self.letter(text[i + k])[n - 1 - k]
                    found += gram
            if len(word) > 24:
                return found
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = found
        return found

    def parts(self, text: str) -> list[str]:
        """Words of a text; where much of it is in another script than Latin, only those, as foreign names are in Latin."""
        words = WORD.findall(UNSEEN.sub("", text).lower())
        other = [w for w in words if not LATIN.match(w)]
        if sum(map(len, other)) >= 3 and len(other) * 2 >= len(words) or any(CJK.match(w) for w in other):
            return other
        return words

    def weighed(self, word: str) -> np.ndarray:
        """Bundle of a word; of long ones, no more than that of ten letters, and less the longer, as they are names and compounds."""
        return self.word(word) if len(word) <= 10 or CJK.match(word) else self.word(word) * np.float32(10 / len(word) ** 1.5)

    def text(self, text: str) -> tuple[np.ndarray | None, int]:
        """Unit bundle of a text and its number of words."""
        words = self.parts(text)
        if not words:
            return None, 0
        total = np.zeros(self.dimensions, np.float32)
        for w in words:
            total += self.weighed(w)
        size = float(np.linalg.norm(total))
        return (total / size if size else None), len(words)


_SPACES: dict[int, Space] = {}


def space(dimensions: int) -> Space:
    return _SPACES.setdefault(dimensions, Space(dimensions))


def units(text: str | None, whole: bool = False) -> list[tuple[int, int]]:
    """Offsets of the sentences of a field (of its text as one, if ``whole``), none if it is blank or a placeholder."""
    if not text or PLACEHOLDER.match(text):
        return []
    if whole:
        return [(len(text) - len(text.lstrip()), len(text.rstrip()))]
    return [(s, e) for s, e in sentences(text) if regex.search(r"\p{L}", text[s:e])]


def body(text: str) -> str:
    """A sentence without the section label before it."""
    return LABEL.sub("", text, count=1) or text


class Profiles:
    """Centred prototypes and their use."""

    def __init__(self, sums: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
        self.space = space(dimensions)
        self.names = sorted(sums)
        rows = np.array([sums[n] / max(np.linalg.norm(sums[n]), 1e-9) for n in self.names], np.float32)
        rows = rows - rows.mean(0) if len(rows) > 1 else rows
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine with every prototype and number of words, per text."""
        vectors, sizes = np.zeros((len(texts), self.space.dimensions), np.float32), np.zeros(len(texts))
        for i, text in enumerate(texts):
            vector, n = self.space.text(text)
            if vector is not None:
                vectors[i], sizes[i] = vector, n
        return vectors @ self.rows.T, sizes

    def path(self, cosines: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The cheapest sequence of languages through the sentences of a field."""
        gain = cosines * np.minimum(np.sqrt(sizes), 4)[:, None]
        best, came = gain[0].copy(), []
        for row in gain[1:]:
            top = int(best.argmax())
            moved = best[top] - CHANGE
            came.append(np.where(best >= moved, np.arange(len(best)), top))
            best = np.maximum(best, moved) + row
        at = int(best.argmax())
        out = [at]
        for back in reversed(came):
            at = int(back[at])
            out.append(at)
        return out[::-1]

    def segments(self, text: str | None, whole: bool = False) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, sentences) of the runs of one language in a field; 0 sentences: one word."""
        spans = units(text, whole)
        if not spans:
            return []
        cosines, sizes = self.cosines([body(text[s:e]) for s, e in spans])
        if not sizes.any():
            return []
        out: list[list] = []
        for (s, e), which, row, size in zip(spans, self.path(cosines, sizes), cosines, sizes, strict=True):
            rest = np.delete(row, which).max() if len(row) > 1 else -1.0
            sure = float(np.clip((row[which] - rest) * 2.5, -1, 1)) * 0.5 + 0.5
            if out and out[-1][2] == which:
                out[-1][1] = e
                out[-1][3].append((sure, max(size, 1)))
            else:
                out.append([s, e, which, [(sure, max(size, 1))]])
        if whole and sum(len(w) if CJK.match(w) else 2 for w in WORD.findall(text)) < 4:
            return [(s, e, self.names[w], round(c[0][0], 4), 0) for s, e, w, c in out]
        return [(s, e, self.names[w], round(sum(a * b for a, b in c) / sum(b for _, b in c), 4), len(c)) for s, e, w, c in out]


def _bundle(rows: DataFrame, dimensions: int, first: Profiles | None) -> Profiles:
    """Prototypes from ``rows(label, title, abstract)``: by declared label, without the sentences that ``first`` doubts."""
    shared = rows.sparkSession.sparkContext.broadcast(None if first is None else (first.names, first.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        room = space(dimensions)
        known = None
        if shared.value is not None:
            known = Profiles.__new__(Profiles)
            known.space, known.names, known.rows = room, *shared.value
        for batch in batches:
            for label, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                declared = code(label)
                if known is None and declared is None:
                    continue
                texts = [body(t[s:e]) for t, whole in zip(fields, (True, False), strict=True) for s, e in units(t, whole)]
                for text in texts:
                    vector, n = room.text(text)
                    if vector is None:
                        continue
                    name = declared
                    if known is not None:
                        scores = known.rows @ vector
                        name = known.names[int(scores.argmax())]
                        if name != declared:
                            if declared not in known.names or scores.max() - scores[known.names.index(declared)] > DOUBT:
                                continue
                            name = declared
                    if name not in sums:
                        sums[name] = np.zeros(dimensions, np.float64)
                    sums[name] += vector
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["name", "vector"])

    return _gathered(rows.select("label", "title", "abstract").mapInArrow(run, "name string, vector array<double>"), dimensions)


def _gathered(parts: DataFrame, dimensions: int) -> Profiles:
    """Profiles from the sums of all tasks, ``parts(name, vector)``; languages x dimensions numbers reach the driver."""
    totals = parts.select("name", F.posexplode("vector").alias("at", "x")).groupBy("name", "at").agg(F.sum("x").alias("x"))
    found = {r["name"]: np.array([x["x"] for x in sorted(r["v"], key=lambda x: x["at"])]) for r in totals.groupBy("name").agg(F.collect_list(F.struct("at", "x")).alias("v")).collect()}
    return Profiles(found, dimensions) if found else Profiles({"en": np.zeros(dimensions)}, dimensions)


def fit(rows: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from all ``rows(label, title, abstract)``: by label, then without the sentences the first ones doubt.

    First prototypes made of counted words instead of sentences cost less but tell short titles apart worse (18 more rows of
    2,089 at sf0.1, nearly all wrong), so both passes bundle sentences.
    """
    return _bundle(rows, dimensions, _bundle(rows, dimensions, None))


def segments(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """id, label, field_name, start_pos, end_pos, lang_code, confidence, n_sentences of ``rows(id, label, title, abstract)``."""
    shared = rows.sparkSession.sparkContext.broadcast((profiles.names, profiles.rows))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles.__new__(Profiles)
        known.names, known.rows = shared.value
        known.space = space(known.rows.shape[1])
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            titles, abstracts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, fields in enumerate(zip(titles, abstracts, strict=True)):
                for name, text in zip(("title", "abstract"), fields, strict=True):
                    for found in known.segments(text, name == "title"):
                        for column, x in zip(out, (i, name, *found), strict=True):
                            column.append(x)
            at = pa.array(out[0], pa.int64())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True))],
                names=["id", "label", "field_name", "start_pos", "end_pos", "lang_code", "confidence", "n_sentences"],
            )

    schema = f"id {kind}, label string, field_name string, start_pos int, end_pos int, lang_code string, confidence double, n_sentences int"
    return rows.select("id", "label", "title", "abstract").mapInArrow(run, schema)


def used_languages(found: DataFrame) -> DataFrame:
    """id, label, languages (sorted array): the languages of each row's text, as its segments show them."""
    word = F.col("n_sentences") == 0  # a title of one word, which counts only where there is nothing else
    found = found.withColumn("words", F.max(~word).over(Window.partitionBy("id"))).where(~word | ~F.col("words"))
    most = F.max_by("lang_code", F.struct("n_sentences", "confidence", "lang_code"))
    per = found.groupBy("id", "label", "field_name", "lang_code").agg(F.sum("n_sentences").alias("n_sentences"), F.max("confidence").alias("confidence"))
    counted = per.groupBy("id", "label", "field_name").agg(
        most.alias("main"), F.collect_list(F.struct("lang_code", "n_sentences")).alias("all")
    )
    kept = F.transform(F.filter("all", lambda x: (x["lang_code"] == F.col("main")) | ((F.col("field_name") == "abstract") & (x["n_sentences"] >= LEAST_SENTENCES))), lambda x: x["lang_code"])
    return counted.groupBy("id", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(kept)))).alias("languages"))


def declared(label: Column) -> Column:
    """Two-letter code of a label as a column expression, null where it names none of the languages."""
    names = F.create_map(*[F.lit(x) for pair in sorted(CODES.items()) for x in pair])
    return F.element_at(names, F.element_at(F.split(F.lower(F.trim(label)), r"[-_\s(]"), 1))


def mislabelled(found: DataFrame) -> DataFrame:
    """id, lang_code: the languages of every row whose label isn't the one and only language of its text."""
    used = used_languages(found)
    right = (F.size("languages") == 1) & (F.element_at("languages", 1) == declared(F.col("label")))
    return used.where(~F.coalesce(right, F.lit(False))).select("id", F.explode("languages").alias("lang_code"))
