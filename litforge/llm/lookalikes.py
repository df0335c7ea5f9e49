"""Problem 6: one consistent form for text that looks the same but is made of other characters.

Every value is cut into pieces at plain spaces and line breaks. Pieces that hold a character outside ASCII (only
those can hold one that is not plain) are mapped: invisible characters go, spaces and hyphens become plain,
full-width and half-width forms, ligatures and mathematical letters become ordinary ones, letters of a foreign
script that look like letters of the word's own script are exchanged. Mapped pieces are grouped under the
accent- and case-sensitive Unicode collation in SQL, under which composed and decomposed spellings are equal; the
canonical member of a class is its shortest, then smallest member by code point, composed where no member is.
The canonical members are joined back to the pieces.

Only distinct pieces are shuffled for the grouping, after map-side deduplication, so repeated or hot pieces cost
one row per task. The join back is on distinct pieces as well.

Defined results: null and empty values have no rows in ``odd_fields`` and keep their value in ``canonical_texts``;
repeated rows give equal results; columns other than those named are not read.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like Latin letters, and those letters.
CYRILLIC = "аеорсухіјѕԁһԛԝӏАВЕЅІЈКМНОРСТХУԌ"
CYRILLIC_LATIN = "aeopcyxijsdhqwlABESIJKMHOPCTXYG"
GREEK = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_LATIN = "ovABEZHIKMNOPTYX"
# Letters of scripts and phonetic alphabets whose shapes are those of Latin letters, and those letters, as the
# public lists of confusable characters have them.
OTHERS = "\u0251\u0261\u0269\u0456\u04CF\u0501\u051B\u051D\u0570\u0578\u057D\u0585\u0581\u0566\u054D\u053C\u0555\u13AA\u13F4\u13DF\u13A0\u13AC\u13C0\u13BB\u13AB\u13E6\u13DE\u13B7\u13E2\u13DA\u13A2\u13D9\u13B3\u13C3\u2C82\u2C88\u2C8E\u2C92\u2C94\u2C98\u2C9A\u2C9E\u2CA2\u2CA6\u2CA8\u2CAC\uA4D0\uA4D3\uA4DA\uA4D1\uA4E2\uA4F2\uA4F3"
OTHERS_LATIN = "agiildqwhnuogqSLOABCDEGHJKLMPSTVWZBEHIKMNOPTYXBDCPSIO"
# The same for words of a Cyrillic or Greek text that hold Latin letters.
LATIN_FOR_CYRILLIC = "aeopcyxABEKMHOPCTX"
CYRILLIC_FOR_LATIN = "аеорсухАВЕКМНОРСТХ"
LATIN_FOR_GREEK = "ovABEZHIKMNOPTYX"
GREEK_FOR_LATIN = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
#: Letters that only Cyrillic (Greek) has: a value with one of them is written in that script.
CYRILLIC_ONLY = "[бгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]"
GREEK_ONLY = "[βγδεζηθικλμξπρςστφχψωάέήίόύώΓΔΘΛΞΠΣΦΨΩΆΈΉΊΌΎΏ]"
INVISIBLE = r"[\p{Cf}\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F͏ᅟᅠ឴឵᠋-᠎ㅤ︀-️ﾠ]"
SPACES = r"[\p{Zs}\t\u0085  &&[^ ]]"
HYPHENS = "[\\u2010\\u2011\\uFE63\\uFF0D]"
MARKS = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]"
WORDS = r"([^ \n\r]+)"
#: What a value or piece that may hold a character which is not plain matches.
ODD = r"[^\x00-\x7F]|[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]"
PIECES = r"([ \n\r]+|[^ \n\r]+)"
#: Turkish is the language whose words do have the cedilla letters.
TURKISH = "[ğĞıİ]"


def width_table() -> tuple[str, str]:
    """Letters and digits whose compatibility form is one other letter or digit, with that form.

    Made by rule from the Unicode data (full width, mathematical, circled and the like); ordinal indicators
    stay, as they are in use in Portuguese, Spanish and Italian.
    """
    odd, plain = [], []
    for point in range(0x00C0, min(sys.maxunicode, 0x1F000)):
        letter = chr(point)
        if unicodedata.category(letter)[0] not in "LN" or letter in "ªº":
            continue
        form = unicodedata.normalize("NFKC", letter)
        kind = unicodedata.decomposition(letter).split(" ")[0]
        if len(form) == 1 and form != letter and form.isalnum() and kind in ("<wide>", "<narrow>", "<font>"):
            odd.append(letter)
            plain.append(form)
    return "".join(odd), "".join(plain)


# Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}


def with_mapped(pieces: DataFrame) -> DataFrame:
    """``pieces(piece, cyrillic, greek, turkish)`` with the look-alike-mapped form of each piece as column mapped.

    The flags say what script and language the value of the piece is written in. Steps are separate columns, so
    that none is written out several times in the next.
    """
    odd, plain = width_table()
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("piece", HYPHENS, "-"), INVISIBLE, ""), SPACES, " ")
    text = F.translate(text, odd, plain)
    # letters of other scripts and of phonetic alphabets stand for Latin ones only inside a word that has Latin letters
    kept = "".join(c for c in OTHERS if c not in CYRILLIC)
    text = F.when(text.rlike(f"\\p{{IsLatin}}[{kept}]|[{kept}]\\p{{IsLatin}}"), F.translate(text, kept, "".join(b for c, b in zip(OTHERS, OTHERS_LATIN, strict=True) if c in kept))).otherwise(text)
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    out = pieces.withColumn("mapped", text)
    comma = F.regexp_replace(F.translate("mapped", "\u015f\u0163\u015e\u0162", "\u0219\u021b\u0218\u021a"), "(?<=[sStT])\u0327", "\u0326")
    out = out.withColumn("mapped", F.when(F.col("turkish"), F.col("mapped")).otherwise(comma))
    out = out.withColumn("bare", F.regexp_replace("mapped", MARKS, ""))
    cross = F.col("bare").rlike(r"\p{IsCyrillic}\p{IsGreek}|\p{IsGreek}\p{IsCyrillic}")
    for script, foreign, own, is_script, back_foreign, back_own, only in (
        ("Cyrillic", CYRILLIC, CYRILLIC_LATIN, "cyrillic", LATIN_FOR_CYRILLIC, CYRILLIC_FOR_LATIN, CYRILLIC_ONLY),
        ("Greek", GREEK, GREEK_LATIN, "greek", LATIN_FOR_GREEK, GREEK_FOR_LATIN, GREEK_ONLY),
    ):
        run = rf"\p{{Is{script}}}"
        mixed = F.col("bare").rlike(rf"\p{{IsLatin}}{run}|{run}\p{{IsLatin}}") | cross
        alike = F.length(F.translate(F.regexp_replace("bare", rf"\P{{Is{script}}}", ""), foreign, "")) == 0
        back = F.col(is_script) & F.col("bare").rlike(only)
        step = (
            F.when(mixed & back, "own").when(F.col("bare").rlike(run) & alike & (mixed | ~F.col(is_script)), "latin").otherwise("")
        )
        out = out.withColumn("step", step).withColumn(
            "mapped",
            F.when(F.col("step") == "own", F.translate("mapped", back_foreign, back_own))
            .when(F.col("step") == "latin", F.translate("mapped", foreign, own))
            .otherwise(F.col("mapped")),
        )
    return out.drop("bare", "step")


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


FLAGS = ["cyrillic", "greek", "turkish"]


def _flagged(values: DataFrame) -> DataFrame:
    """Values outside ASCII with their flags, found once per value, before the pieces are taken apart."""
    flags = {n: F.col("value").rlike(p) for n, p in zip(FLAGS, (CYRILLIC_ONLY, GREEK_ONLY, TURKISH), strict=True)}
    return values.where(F.col("value").rlike(ODD)).withColumns(flags)


def canonical_pieces(values: DataFrame) -> DataFrame:
    """piece, cyrillic, greek, turkish, canonical: every distinct piece outside ASCII of ``values(value)`` with its form."""
    pieces = with_mapped(
        _flagged(values)
        .select(F.explode(F.regexp_extract_all("value", F.lit(WORDS), 1)).alias("piece"), *FLAGS)
        .where(F.col("piece").rlike(ODD))
        .distinct()
    )
    decomposed = F.col("member").rlike(MARKS)
    members = pieces.select(F.col("mapped").alias("member")).distinct()
    classes = (
        members.groupBy(F.collate("member", "UNICODE").alias("class"))
        .agg(F.min(F.struct(decomposed.alias("decomposed"), F.length("member").alias("length"), F.col("member").alias("member"))).alias("best"))
        .select("class", "best.*")
    )
    composed = F.when(F.col("decomposed"), _composed("member")).otherwise(F.col("member"))
    chosen = classes.select("class", composed.alias("canonical"))
    return (
        pieces.withColumn("class", F.collate("mapped", "UNICODE"))
        .join(chosen, "class")
        .select("piece", *FLAGS, "canonical")
    )


KEYS = ["piece", *FLAGS]


def odd_fields(values: DataFrame) -> DataFrame:
    """row_id, field_name of ``values(row_id, field_name, value)`` that hold a character which is not plain."""
    known = canonical_pieces(values.select("value"))
    odd = known.where(F.col("piece") != F.col("canonical")).select(*KEYS)
    pieces = (
        _flagged(values)
        .select("row_id", "field_name", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(WORDS), 1))).alias("piece"), *FLAGS)
        .where(F.col("piece").rlike(ODD))
    )
    return pieces.join(odd, KEYS, "left_semi").select("row_id", "field_name").distinct()


def canonical_texts(values: DataFrame) -> DataFrame:
    """row_id, field_name, element, value, canonical for every row of ``values(row_id, field_name, element, value)``."""
    known = canonical_pieces(values.select("value")).where(F.col("piece") != F.col("canonical"))
    cut = F.regexp_extract_all("value", F.lit(PIECES), 1)
    places = (
        _flagged(values)
        .select("row_id", "field_name", "element", F.posexplode(cut).alias("at", "piece"), *FLAGS)
        .where(F.col("piece").rlike(ODD))
        .join(known, KEYS)
        .groupBy("row_id", "field_name", "element")
        .agg(F.map_from_entries(F.collect_set(F.struct("at", "canonical"))).alias("changes"))
    )
    rebuilt = F.array_join(F.transform(cut, lambda piece, at: F.coalesce(F.element_at("changes", at), piece)), "")
    return values.join(places, ["row_id", "field_name", "element"], "left").select(
        "row_id", "field_name", "element", "value", F.when(F.col("changes").isNull(), F.col("value")).otherwise(rebuilt).alias("canonical")
    )


def article_values(articles: DataFrame) -> DataFrame:
    """title, abstract and each element of authors as rows (row_id, field_name, element, value)."""
    fields = F.concat(
        F.array(
            F.struct(F.lit("title").alias("field_name"), F.lit(0).alias("element"), F.col("title").alias("value")),
            F.struct(F.lit("abstract").alias("field_name"), F.lit(0).alias("element"), F.col("abstract").alias("value")),
        ),
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("authors").alias("field_name"), (i + 0).alias("element"), x.alias("value"))),
    )
    return articles.select(F.col("article_id").alias("row_id"), F.explode(fields).alias("f")).select("row_id", "f.field_name", "f.element", "f.value")
