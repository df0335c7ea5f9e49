"""Problems 1 and 2: records of one paper across sources, and the best record of each group of duplicates.

Matching is a sorted neighbourhood. Every record gives several composite keys (title with year and page, the rare
words of the title, identifiers, place of publication, first author with year and volume). All keys of all records
are sorted together by range partitioning, every row gets its place in the whole order from the sizes of the
partitions, and rows are compared with the next ``WINDOW`` rows of the order. Blocks of equal size are cut from the
order with the next block's first rows repeated, so windows cross every border and no block depends on how often a
key occurs.

What is sorted is the record's number and a sketch of its fields (hashes, a few bits). From two sketches comes an upper
bound of the score, never less than it, so pairs whose bound is under the threshold can be left out at once and lose
nothing. The pairs left are made distinct, the fields are joined to them, and each is scored once: weighted field
similarities add up to log odds, whose logistic value is the confidence.

Records with the same values in every compared field are reduced to one before sorting, so that copies of one record,
however many, do not push other records out of a window. They are one paper if the record is so with itself, that is,
if its fields say enough: records without content match nothing, not even each other.

Records of one source that match are joined to clusters. Between each two sources, clusters are assigned one to one
so that total confidence is greatest: mutual best pairs without a rival are settled by aggregation, the conflicts
left are bipartite components, small as a rule, which are solved exactly whatever their size, each by itself.

Words that many organisations have in their names ("study", "group", "heart") say nothing about who wrote a paper. They are
counted over the organisations of all sources (:func:`common_words`), or given by the caller.

Defined results: null and blank fields add nothing to a score; a record without any key matches nothing; repeated
rows match each other if they have content; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.core.graph import components
from litforge.core.session import cut, spread, table
from litforge.core.text import bind
from litforge.llm.lookalikes import CYRILLIC, CYRILLIC_LATIN, GREEK, GREEK_LATIN, LIGATURES, width_table

#: Rows that a row of the sorted order is compared with.
WINDOW = 10
#: Rows of a block of the order.
BLOCK = 4096
#: Score (log odds) from which two records are one paper.
MATCH = 3.0
#: Share of all organisations' names from which a word in them is common.
COMMON = 0.01


def accent_table() -> tuple[str, str]:
    """Letters with a mark and the same letters without, made by rule from the Unicode data."""
    odd, plain = [], []
    for point in range(0x00C0, 0x2000):
        letter = chr(point)
        if unicodedata.category(letter)[0] == "L":
            base = unicodedata.normalize("NFD", letter)[0]
            if base != letter and "LATIN" in unicodedata.name(base, ""):
                odd.append(letter)
                plain.append(base)
    extra = {"ß": "s", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}
    return "".join(odd) + "".join(extra), "".join(plain) + "".join(extra.values())


def folded(text: Column) -> Column:
    """Lower case without accents, invisible characters and look-alike letters: for comparing, not for showing."""
    odd, plain = ("".join(x) for x in zip(*[(a, b) for a, b in zip(*width_table(), strict=True) if b.isascii()], strict=True))
    accents, bare = accent_table()
    text = F.translate(F.regexp_replace(text, r"\p{Cf}", ""), odd + CYRILLIC + GREEK, plain + CYRILLIC_LATIN + GREEK_LATIN)
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.translate(F.lower(F.regexp_replace(text, r"[̀-゙゚ͯ]", "")), accents + CYRILLIC, bare + CYRILLIC_LATIN)


def title_key(title: Column) -> Column:
    """Folded words of a title, single spaces between; empty for placeholders."""
    text = F.regexp_replace(title, r"<[^>]{1,12}>", "")
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "))


def first_page(pages: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(pages), r"^\s*(e?[1-9]\d*)", 1), F.lit(""))


def number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*([1-9]\d*)\s*\z", 1), F.lit(""))


def journal_key(journal: Column) -> Column:
    """First letters of the first and the last word, which full and abbreviated names share."""
    words = F.split(F.trim(F.regexp_replace(folded(journal), r"[^\p{L}]+", " ")), " ")
    return F.when(F.length(F.trim(journal)) > 3, F.concat(F.substring(F.element_at(words, 1), 1, 3), F.substring(F.element_at(words, -1), 1, 3)))


def doi_key(doi: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(doi), r"(10\.\d{4,9}/[^\s]+)", 1), r"[.,;)\]]+\z", ""), F.lit(""))


def name_words(names: Column) -> Column:
    """Distinct words of four and more letters of all names, letters of each sorted, so that swapped ones are equal."""
    words = F.split(F.regexp_replace(folded(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " ")), r"[^\p{L}]+", " "), " ")
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.array_join(F.array_sort(F.split(w, "")), ""))))


def common_words(organisations: DataFrame, share: float = COMMON) -> list[str]:
    """Words (letters sorted) that at least ``share`` of all rows of ``organisations(name)`` have.

    At most words-per-name / ``share`` of them exist, however many rows there are, so the list is bounded.
    """
    rows = organisations.where(F.length(F.trim("name")) > 0).select(name_words(F.array("name")).alias("w"))
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r["w"] for r in counts.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("w").collect())  # one row crossed


FIELDS = ["title", "cut", "year", "doi", "pmid", "pmcid", "volume", "page", "issue", "journal", "names"]


def _features(df: DataFrame, source: str, rec: str, title: Column, year: Column, doi: Column, pmid: Column, pmcid: Column, volume: Column, page: Column, issue: Column, journal: Column, names: Column, common: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    digits = lambda c, n: none if c is None else F.nullif(F.regexp_extract(c, rf"(?<!\d)([1-9]\d{{{n}}})(?!\d)", 1), F.lit(""))
    return df.select(
        F.col(rec).cast("long").alias("rec"),
        F.lit(source).alias("source"),
        F.coalesce(title_key(title), F.lit("")).alias("title"),
        F.coalesce(F.trim(title).rlike(r"(?:\.\.\.|…)\W*\z"), F.lit(False)).alias("cut"),
        year.alias("year"),
        doi_key(doi).alias("doi"),
        digits(pmid, "6,8").alias("pmid"),
        digits(pmcid, "6").alias("pmcid"),
        number(volume).alias("volume"),
        first_page(page).alias("page"),
        F.nullif(F.lower(F.trim(issue)), F.lit("")).alias("issue"),
        journal_key(journal).alias("journal"),
        F.array_except(name_words(names), F.array(*[F.lit(w) for w in common]).cast("array<string>")).alias("names"),
    )


def article_features(articles: DataFrame, common: list[str] | None = None) -> DataFrame:
    year = F.regexp_extract("pub_year", r"^\s*(\d{4})\s*\z", 1).try_cast("int")
    journal = F.when(F.length(F.trim("journal")) > 3, F.col("journal")).otherwise(F.col("journal_title"))
    c = F.col
    return _features(articles, "a", "article_id", c("title"), year, c("doi"), c("pmid"), c("pmcid"), c("volume"), c("pages"), c("issue"), journal, c("authors"), common or [])


def openalex_features(works: DataFrame, common: list[str] | None = None) -> DataFrame:
    names = F.transform("authorships", lambda x: x["author"]["display_name"])
    c = F.col
    return _features(works, "o", "work_id", c("title"), c("publication_year"), c("doi"), c("ids.pmid"), c("ids.pmcid"), c("biblio.volume"), c("biblio.first_page"), c("biblio.issue"), c("source_title"), names, common or [])


def crossref_features(works: DataFrame, common: list[str] | None = None) -> DataFrame:
    first = lambda name: F.get(F.col(name), F.lit(0))
    year = F.get(F.get(F.col("issued.date_parts"), F.lit(0)), F.lit(0))
    names = F.transform("author", lambda x: F.concat_ws(" ", x["given"], x["family"], x["org_name"]))
    journal = F.coalesce(first("container_title"), first("short_container_title"))
    c = F.col
    return _features(works, "c", "crossref_id", first("title"), year, c("doi"), None, None, c("volume"), c("page"), c("issue"), journal, names, common or [])


def _keys() -> Column:
    """The composite sort keys of a record; null where their parts are missing."""
    # the long words of a title are names of substances and conditions: rare, and kept by all versions of it
    rare = F.array_sort(F.filter(F.split("title", " "), lambda w: F.length(w) >= 9), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    year = F.coalesce(F.col("year").cast("string"), F.lit("-"))
    page, volume = F.coalesce("page", F.lit("-")), F.coalesce("volume", F.lit("-"))
    text = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *parts)
    first_name = F.get(F.col("names"), F.lit(0))
    longest = F.array_max(F.transform("names", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.array(
        F.when(F.length("title") >= 20, text("t", F.replace("title", F.lit(" "), F.lit("")), year, page)),
        F.when(F.size(rare) > 0, text("r", F.array_join(F.slice(rare, 1, 2), "|"), year, page)),
        F.when(F.size(rare) > 1, text("r", F.element_at(rare, 2), F.element_at(rare, 1), year, page)),
        F.when(F.col("doi").isNotNull(), text("d", F.col("doi"), year, page)),
        F.when(F.col("pmid").isNotNull(), text("p", F.col("pmid"), year, page)),
        F.when(F.col("pmcid").isNotNull(), text("m", F.col("pmcid"), year, page)),
        F.when(F.col("page").isNotNull() & F.col("journal").isNotNull(), text("b", F.col("journal"), page, volume, year)),
        F.when(first_name.isNotNull(), text("n", first_name, year, volume, page)),
        F.when(longest.isNotNull(), text("l", longest, year, volume, page)),
    )


IDENTIFIERS = {"doi": (4.0, -1.5), "pmid": (4.0, -1.5), "pmcid": (3.5, -1.5)}
PLACES = {"page": (2.0, -2.0), "volume": (1.5, -1.0), "issue": (0.5, -0.5), "journal": (0.7, -1.5)}
#: What a score starts from: two records are no paper until their fields say so.
PRIOR = -3.0


def _equal(a: Column, b: Column) -> Column:
    """Sum of the weights of the fields that are equal or not, null ones aside."""
    weigh = lambda f, yes, no: F.coalesce(F.when(a[f] == b[f], yes).when(a[f] != b[f], no), F.lit(0.0))
    years = F.coalesce(F.when(a["year"] == b["year"], 1.0).when(F.abs(a["year"] - b["year"]) == 1, 0.0).when(a["year"] != b["year"], -2.0), F.lit(0.0))
    return sum((weigh(f, yes, no) for f, (yes, no) in (IDENTIFIERS | PLACES).items()), years)


def _title_weight(likeness: Column) -> Column:
    return F.when(likeness >= 0.97, 4.0).when(likeness >= 0.85, 3.0).when(likeness >= 0.7, 0.5).when(likeness >= 0.5, -2.0).otherwise(-4.0)


def _marks(title: Column) -> Column:
    """Numbers and roman numerals, which tell parts and editions of a paper apart."""
    return F.array_sort(F.filter(F.split(title, " "), lambda w: w.rlike(r"^(?:\d+|[ivx]+)\z")))


def score(a: Column, b: Column) -> Column:
    """Log odds that two records are one paper: the sum of the weighted similarities of their fields."""
    shorter = F.least(F.length(a["title"]), F.length(b["title"]))
    cut_one = a["cut"] | b["cut"]
    n = F.when(cut_one, shorter).otherwise(F.greatest(F.length(a["title"]), F.length(b["title"])))
    likeness = 1 - F.levenshtein(F.left(a["title"], n), F.left(b["title"], n)) / F.when(n > 0, n)
    short = (shorter < 16) & ~cut_one
    titles = F.when(shorter == 0, 0.0).when(short, F.when(likeness > 0.6, 0.3).otherwise(-2.0)).otherwise(bind(likeness, _title_weight))
    parts = F.when((shorter > 16) & ~cut_one & (_marks(a["title"]) != _marks(b["title"])), -6.0).otherwise(0.0)
    fewest = F.least(F.size(a["names"]), F.size(b["names"]))
    shared = F.size(F.array_intersect(a["names"], b["names"])) / F.when(fewest > 0, fewest)
    names = F.when(fewest == 0, 0.0).otherwise(bind(shared, lambda x: F.when(x >= 0.6, 2.0).when(x >= 0.3, 1.0).when(x > 0, 0.0).otherwise(-2.5)))
    return titles + parts + names + _equal(a, b) + PRIOR


def sketch() -> list[Column]:
    """What is needed of a record for :func:`bounds`: hashes of its fields and bits of its names and title words, all whole numbers."""
    bits = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(w), F.lit(64)))))
    hashed = [F.when(F.col(f).isNotNull(), F.hash(f)).cast("long").alias(f) for f in (*IDENTIFIERS, *PLACES)]
    return [
        F.col("year").cast("long").alias("year"), *hashed, F.length("title").cast("long").alias("length"), F.col("cut").cast("long").alias("cut"),
        bits(F.split("title", " ")).alias("words"), F.hash(_marks(F.col("title"))).cast("long").alias("marks"), bits(F.col("names")).alias("names"),
    ]


SKETCH = ["year", *IDENTIFIERS, *PLACES, "length", "cut", "words", "marks", "names"]
NONE = np.iinfo(np.int64).min


def bounds(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Upper bounds of :func:`score` for pairs of sketches (arrays by name; ``NONE`` stands for null).

    Equal hashes are taken for equal fields, different ones are different fields. An edit of a title changes at most two of its
    words into one or one into two, three words in all, so a third of the word bits that differ, and the difference of
    lengths, are edits at least. Names without a common bit have no common word.
    """
    total = np.full(len(a["length"]), PRIOR)
    for f, (yes, no) in (IDENTIFIERS | PLACES).items():
        total += np.where((a[f] == NONE) | (b[f] == NONE), 0.0, np.where(a[f] == b[f], yes, no))
    apart = np.abs(a["year"] - b["year"])
    total += np.where((a["year"] == NONE) | (b["year"] == NONE), 0.0, np.where(apart == 0, 1.0, np.where(apart == 1, 0.0, -2.0)))
    shorter, longer = np.minimum(a["length"], b["length"]), np.maximum(a["length"], b["length"])
    edits = np.maximum(longer - shorter, np.ceil(np.bitwise_count((a["words"] ^ b["words"]).view(np.uint64)) / 3))
    likeness = 1 - edits / np.maximum(longer, 1)
    whole = np.select([likeness >= 0.97, likeness >= 0.85, likeness >= 0.7, likeness >= 0.5], [4.0, 3.0, 0.5, -2.0], -4.0)
    cut_one = (a["cut"] | b["cut"]) > 0
    total += np.select([shorter == 0, cut_one, shorter < 16], [0.0, 4.0, 0.3], whole)
    total += np.where((shorter > 16) & ~cut_one & (a["marks"] != b["marks"]), -6.0, 0.0)
    return total + np.select([(a["names"] == 0) | (b["names"] == 0), (a["names"] & b["names"]) == 0], [0.0, -2.5], 2.0)


def candidates(one: DataFrame, window: int = WINDOW, block: int = BLOCK, least: float = MATCH) -> DataFrame:
    """rec_a < rec_b: distinct pairs of ``one`` (records without copies) that are neighbours under a key and whose bound reaches ``least``.

    The windows of a block are compared by array operations, one for each distance in the order.
    """
    keyed = one.select("rec", *sketch(), F.explode(F.array_compact(_keys())).alias("key"))
    ordered = cut(keyed.repartitionByRange(spread(one), "key", "rec").sortWithinPartitions("key", "rec").select("rec", *SKETCH, F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("rec", *SKETCH, (F.col("before") + place).alias("index"))
    own = F.floor(F.col("index") / block)
    tail = F.when((F.col("index") % block < window) & (own > 0), own - 1)
    blocks = placed.withColumn("block", F.explode(F.array_compact(F.array(own, tail))))

    def compare(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["index"].to_numpy())
        column = lambda name: rows[name].combine_chunks().fill_null(int(NONE)).to_numpy(zero_copy_only=False)[order]
        index, rec, fields = column("index"), column("rec"), {f: column(f) for f in SKETCH}
        left, right = [], []
        for k in range(1, min(window, len(rec) - 1) + 1):
            # a pair belongs to the block of its first row
            mine = (index[:-k] // block == rows["block"][0].as_py()) & (rec[:-k] != rec[k:])
            near = np.flatnonzero(mine & (bounds({f: x[:-k] for f, x in fields.items()}, {f: x[k:] for f, x in fields.items()}) >= least))
            left.append(rec[near])
            right.append(rec[near + k])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"rec_a": np.minimum(a, b), "rec_b": np.maximum(a, b)})

    return blocks.groupBy("block").applyInArrow(compare, "rec_a long, rec_b long").distinct()


def matches(records: DataFrame, window: int = WINDOW, block: int = BLOCK, least: float = MATCH) -> DataFrame:
    """rec_a < rec_b, source_a, source_b, score, confidence for the pairs of records found to be one paper.

    Copies of one record are paired with the smallest of them only; their cluster holds the rest.
    """
    printed = cut(records.withColumn("print", F.md5(F.to_json(F.struct("source", *FIELDS)))))
    firsts = printed.groupBy("print").agg(F.min("rec").alias("rec"))
    one = cut(printed.join(firsts, ["print", "rec"], "left_semi").dropDuplicates(["rec"]))
    row = F.struct("rec", "source", *FIELDS)
    rows = lambda side: one.select(F.col("rec").alias(f"rec_{side}"), row.alias(side))
    found = candidates(one, window, block, least).join(rows("a"), "rec_a").join(rows("b"), "rec_b")
    a, b = F.col("a"), F.col("b")
    scored = found.select("rec_a", "rec_b", a["source"].alias("source_a"), b["source"].alias("source_b"), score(a, b).alias("score")).where(F.col("score") >= least)
    # copies that were reduced to one before sorting are one paper if the record is so with itself
    itself = one.select("print", F.col("rec").alias("first"), row.alias("a"), F.size(F.array_compact(_keys())).alias("keys")).where(F.col("keys") > 0).select("print", "first", score(a, a).alias("score"))
    copies = printed.select("print", "rec", "source").join(itself.where(F.col("score") >= least), "print").where(F.col("rec") != F.col("first"))
    same = copies.select(F.col("first").alias("rec_a"), F.col("rec").alias("rec_b"), F.col("source").alias("source_a"), F.col("source").alias("source_b"), "score")
    return scored.unionByName(same).withColumn("confidence", logistic(F.col("score")))


def logistic(odds: Column) -> Column:
    return F.round(1 / (1 + F.exp(-odds)), 6)


def _assign(rows: pd.DataFrame) -> pd.DataFrame:
    """The one-to-one choice of pairs (a, b) of one component with the greatest total score.

    Shortest augmenting paths over the pairs there are, whatever their number: time and memory follow the pairs that a
    path can reach, not the square of the component.
    """
    rows = rows.sort_values(["score", "a", "b"], ascending=[False, True, True]).drop_duplicates(["a", "b"])
    left, _ = pd.factorize(rows.a)
    right, ends = pd.factorize(rows.b)
    edges: list[list[tuple[int, float]]] = [[] for _ in range(left.max() + 1)]
    for x, j, s in zip(left.tolist(), right.tolist(), rows.score.tolist(), strict=True):
        edges[x].append((j, s))
    # prices of both sides; the left node of each right one, and the other way round; a left node may stay alone at no gain
    u, v, owner, has = [0.0] * len(edges), [0.0] * len(ends), [-1] * len(ends), [-1] * len(edges)
    for start, own in enumerate(edges):
        u[start] = min(0.0, min(-s - v[j] for j, s in own))
        far, came, done, heap = {}, {}, {}, []
        x, d, scanned = start, 0.0, {start: 0.0}
        least, last = math.inf, (start, -1)
        while True:
            if d - u[x] < least:
                least, last = d - u[x], (x, -1)
            for j, s in edges[x]:
                now = max(d, d - s - u[x] - v[j])
                if j not in done and now < least and now < far.get(j, math.inf):
                    far[j], came[j] = now, x
                    if owner[j] < 0:
                        least, last = now, (x, j)
                    else:
                        heapq.heappush(heap, (now, j))
            while heap and (heap[0][1] in done or heap[0][0] > far[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            d, j = heapq.heappop(heap)
            done[j] = d
            x = owner[j]
            scanned[x] = d
        for node, d in scanned.items():
            u[node] += least - d
        for j, d in done.items():
            v[j] -= least - d
        x, j = last
        while True:
            before = has[x]
            has[x] = j
            if j >= 0:
                owner[j] = x
            if x == start:
                break
            j, x = before, came[before]
    return rows[[has[x] == j for x, j in zip(left.tolist(), right.tolist(), strict=True)]]


def one_to_one(pairs: DataFrame) -> DataFrame:
    """``pairs(kind, a, b, score)`` reduced to a one-to-one assignment of greatest total score within each kind.

    A pair neither of whose ends has another pair needs no choice; the rest is split into components, each solved
    by itself. Score must be positive; a repeated pair counts with its highest score.
    """
    pairs = pairs.groupBy("kind", "a", "b").agg(F.max("score").alias("score"))
    counted = cut(pairs.withColumn("n_a", F.count("*").over(Window.partitionBy("kind", "a"))).withColumn("n_b", F.count("*").over(Window.partitionBy("kind", "b"))))
    single = counted.where((F.col("n_a") == 1) & (F.col("n_b") == 1)).select("kind", "a", "b", "score")
    rest = counted.where((F.col("n_a") > 1) | (F.col("n_b") > 1)).select("kind", "a", "b", "score")
    if rest.isEmpty():
        return single
    ends = rest.select(F.concat_ws("|", "kind", F.lit("a"), "a").alias("a"), F.concat_ws("|", "kind", F.lit("b"), "b").alias("b"))
    parts = components(ends).withColumnRenamed("node", "end")
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema.fields}
    solved = (
        rest.withColumn("end", F.concat_ws("|", "kind", F.lit("a"), "a"))
        .join(parts, "end")
        .drop("end")
        .groupBy("component")
        .applyInPandas(lambda rows: _assign(rows)[["kind", "a", "b", "score"]].astype({"kind": object}), f"kind {kinds['kind']}, a {kinds['a']}, b {kinds['b']}, score double")
    )
    return single.unionByName(solved)


def clusters(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members rec, source, cluster, confidence; links a, b, confidence between clusters of two sources.

    A cluster holds the records of one source that describe one paper and is named by its smallest record. Links are the
    assigned pairs of clusters and, where a paper has one cluster in each source, the pairs reached over a third source.
    """
    records = cut(records)
    found = cut(matches(records))
    within = found.where(F.col("source_a") == F.col("source_b"))
    groups = cut(components(within.select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"))))
    lookup = lambda side: groups.select(F.col("node").alias(f"rec_{side}"), F.col("component").alias(f"group_{side}"))
    crossing = found.where(F.col("source_a") != F.col("source_b")).join(lookup("a"), "rec_a", "left").join(lookup("b"), "rec_b", "left")
    crossing = crossing.select("rec_a", "rec_b", "source_a", "source_b", "score", F.coalesce("group_a", "rec_a").alias("ga"), F.coalesce("group_b", "rec_b").alias("gb"))
    forward = F.col("source_a") < F.col("source_b")
    sided = crossing.select(
        F.concat(F.least("source_a", "source_b"), F.greatest("source_a", "source_b")).alias("kind"),
        F.when(forward, F.col("ga")).otherwise(F.col("gb")).alias("a"),
        F.when(forward, F.col("gb")).otherwise(F.col("ga")).alias("b"),
        "score",
    )
    # several agreeing record pairs make a cluster pair surer than its best one alone
    weighed = sided.groupBy("kind", "a", "b").agg((F.max("score") + F.log(F.count("*"))).alias("score"))
    chosen = cut(one_to_one(weighed))
    papers = cut(components(chosen.select("a", "b")))
    source_of = records.select(F.col("rec").alias("cluster"), "source")
    in_paper = papers.select(F.col("node").alias("cluster"), F.col("component").alias("paper")).join(source_of, "cluster")
    # a paper reached over a third source is one only if no source has two clusters in it
    counts = in_paper.groupBy("paper").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    sound = in_paper.join(counts.where(F.col("n") == F.col("sources")).select("paper"), "paper")
    x, y = sound.alias("x"), sound.alias("y")
    closed = x.join(y, (F.col("x.paper") == F.col("y.paper")) & (F.col("x.source") < F.col("y.source"))).select(F.least("x.cluster", "y.cluster").alias("a"), F.greatest("x.cluster", "y.cluster").alias("b"))
    direct = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), logistic(F.col("score")).alias("confidence"))
    links = direct.unionByName(closed.withColumn("confidence", F.lit(round(1 / (1 + math.exp(-MATCH)), 6)))).groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    sure = within.select(F.explode(F.array("rec_a", "rec_b")).alias("rec"), "confidence").groupBy("rec").agg(F.max("confidence").alias("confidence"))
    members = records.select("rec", "source").join(groups.select(F.col("node").alias("rec"), F.col("component").alias("cluster")), "rec", "left").join(sure, "rec", "left")
    return members.select("rec", "source", F.coalesce("cluster", "rec").alias("cluster"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")), links


def match_sources(records: DataFrame) -> DataFrame:
    """rec_a < rec_b: every pair of records of two sources that describe one paper, from the links of their clusters."""
    members, links = clusters(records)
    side = lambda name, rec: members.select(F.col("cluster").alias(name), F.col("rec").alias(rec))
    return cut(links).join(side("a", "p"), "a").join(side("b", "q"), "b").select(F.least("p", "q").alias("rec_a"), F.greatest("p", "q").alias("rec_b"))


def article_records(spark, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    groups = articles.select(F.explode("authors_full").alias("p")).select(F.col("p.collective").alias("name"))
    return article_features(articles, common_words(groups))


def all_records(spark, sf_dir: str) -> DataFrame:
    articles, works, dois = (table(spark, sf_dir, name) for name in ("articles", "openalex_works", "crossref_works"))
    groups = articles.select(F.explode("authors_full").alias("p")).select(F.col("p.collective").alias("name"))
    common = common_words(groups.union(dois.select(F.explode("author").alias("p")).select("p.org_name")))
    return article_features(articles, common).unionByName(openalex_features(works, common)).unionByName(crossref_features(dois, common))
