"""Reading lists, screening matrix, history and documents as tables: every change is a function from tables to tables.

lists(list_id, name, pos, is_active), saved(list_id, key, pos, note, added_at), cells(list_id, key, col_id, value),
decisions(list_id, key, decision), columns(list_id, pos, col_id, label), history(state, date, total, pmids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.functions import text as tx
from litforge.operators.citations import author_part, study_label

c = F.col
# Decisions in sorting order with their labels, and the columns a new matrix has.
DECISIONS = [("include", "Include"), ("unsure", "Unsure"), ("", "Undecided"), ("exclude", "Exclude")]
DEFAULT_COLUMNS = [("design", "Study design"), ("population", "Population / setting"), ("size", "Sample size"), ("exposure", "Intervention / exposure"), ("outcome", "Main outcome"), ("finding", "Key finding"), ("limits", "Limitations / risk of bias")]
HISTORY = 30


def list_counts(lists: DataFrame, saved: DataFrame) -> DataFrame:
    """list_id, name, papers of every list, empty ones included."""
    counts = saved.groupBy("list_id").agg(F.count("*").alias("papers"))
    return lists.join(counts, "list_id", "left").select("list_id", "name", F.coalesce("papers", F.lit(0)).alias("papers"))


def with_active(lists: DataFrame, list_id) -> DataFrame:
    """``lists`` with one active list: the named one, or none changed if it doesn't exist; the first list if none is."""
    named = F.max((c("list_id") == list_id).cast("int")).over(Window.partitionBy(F.lit(0))) == 1  # a list of lists is small
    fixed = lists.withColumn("is_active", F.when(named, c("list_id") == list_id).otherwise(c("is_active")))
    w = Window.partitionBy(F.lit(0))
    first = F.min("pos").over(w)
    return fixed.withColumn("is_active", F.when(F.max(c("is_active").cast("int")).over(w) == 1, c("is_active")).otherwise(c("pos") == first))


def unique_names(names: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """Names trimmed to 60 characters; the second and later equal ones (any case) get " (2)", " (3)", … that no other name has."""
    short = F.left(F.trim(name), F.lit(60))
    rows = names.withColumn("__short", short).withColumn("__low", F.lower(short))
    place = F.row_number().over(Window.partitionBy("__low").orderBy(order))
    rows = rows.withColumn("__place", place)
    # numbers that typed names hold already are passed over
    taken = rows.where(c("__place") == 1).select(F.regexp_extract("__low", r"^(.*) \((\d+)\)\z", 1).alias("__low"), F.regexp_extract("__low", r"^(.*) \((\d+)\)\z", 2).try_cast("int").alias("n")).where(c("n") > 1)
    held = taken.groupBy("__low").agg(F.collect_set("n").alias("__held"))
    rows = rows.join(held, "__low", "left")
    free = F.filter(F.sequence(F.lit(2), c("__place") + F.size(F.coalesce("__held", F.array().cast("array<int>")))), lambda n: ~F.array_contains(F.coalesce("__held", F.array().cast("array<int>")), n))
    suffix = F.get(free, c("__place") - 2)
    made = F.when(c("__place") > 1, F.concat("__short", F.lit(" ("), suffix.cast("string"), F.lit(")"))).otherwise(c("__short"))
    return rows.withColumn(name, made).select(*names.columns)


def created(lists: DataFrame, list_id, name: str) -> DataFrame:
    """``lists`` with one more list, which is active; its name is made unique."""
    pos = lists.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"))
    new = pos.select(F.lit(list_id).cast(lists.schema["list_id"].dataType).alias("list_id"), F.lit(name).alias("name"), c("pos").cast(lists.schema["pos"].dataType).alias("pos"), F.lit(True).alias("is_active"))
    return unique_names(lists.withColumn("is_active", F.lit(False)).unionByName(new.select(*lists.columns)))


def renamed(lists: DataFrame, list_id, name: str) -> DataFrame:
    new = name.strip()[:60]
    return lists.withColumn("name", F.when(c("list_id") == list_id, new).otherwise(c("name"))) if new else lists


def without_list(list_id, lists: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without a list and what belongs to it; the last list stays."""
    if lists.limit(2).count() < 2:
        return [lists, *tables]
    left = lists.where(c("list_id") != list_id)
    return [with_active(left, None), *[t.where(c("list_id") != list_id) for t in tables]]


def added(saved: DataFrame, papers: DataFrame) -> DataFrame:
    """``saved`` with ``papers(list_id, key, note, added_at)`` on top; papers already in the list are left as they are."""
    new = papers.join(saved, ["list_id", "key"], "left_anti").dropDuplicates(["list_id", "key"])
    top = saved.groupBy("list_id").agg(F.min("pos").alias("top"))
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("added_at", "key"))
    new = new.join(top, "list_id", "left").withColumn("pos", F.coalesce("top", F.lit(0)) - place).select(*saved.columns)
    return saved.unionByName(new)


def removed(saved: DataFrame, keys: DataFrame) -> DataFrame:
    return saved.join(keys.select("list_id", "key"), ["list_id", "key"], "left_anti")


def toggled(saved: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers in the list are taken out, others are put in."""
    return removed(saved, papers).unionByName(added(saved, papers).join(saved.select("list_id", "key"), ["list_id", "key"], "left_anti").select(*saved.columns))


def copied(saved: DataFrame, source, target, keys: DataFrame, move: bool = False) -> DataFrame:
    """Papers of ``keys(key)`` copied from one list to another; a move takes them out even where the target has them."""
    picked = saved.where(c("list_id") == source).join(keys.select("key").distinct(), "key", "left_semi")
    out = added(saved, picked.select(F.lit(target).cast(saved.schema["list_id"].dataType).alias("list_id"), *[x for x in saved.columns if x not in ("list_id", "pos")]))
    return removed(out, picked) if move else out


def noted(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """``saved`` with the notes of ``notes(list_id, key, note)``."""
    new = notes.select("list_id", "key", c("note").alias("__n"))
    return saved.join(new, ["list_id", "key"], "left").withColumn("note", F.coalesce("__n", "note")).select(*saved.columns)


def text_filter(rows: DataFrame, query: str) -> DataFrame:
    """Rows that hold a text (any case) in title, authors, year or journal."""
    hay = F.lower(F.concat_ws(" ", "title", F.array_join("authors", " "), "pub_year", "journal"))
    return rows.where(F.contains(hay, F.lit(query.strip().lower())))


def recorded(history: DataFrame, searches: DataFrame, most: int = HISTORY) -> DataFrame:
    """``history`` with new searches: the newest of each state, at most ``most`` in all, newest first."""
    both = history.unionByName(searches)
    newest = both.groupBy("state").agg(F.max_by(F.struct(*both.columns), "date").alias("s")).select("s.*")
    return newest.orderBy(F.desc("date"), "state").limit(most)


def previous_run(history: DataFrame, state: str) -> DataFrame:
    """The entry of a search in the history, no row if it was not run."""
    return history.where(c("state") == state)


def new_since(run: DataFrame, previous: DataFrame, key: str = "pmid") -> DataFrame:
    """Papers of a run that an earlier run of the same search did not have."""
    return run.join(previous.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- matrix


def decision_counts(papers: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row with the papers of each decision, zeros included; papers without one are undecided."""
    rows = papers.join(decisions.select("key", "decision"), "key", "left")
    d = F.coalesce("decision", F.lit(""))
    return rows.agg(*[F.count_if(d == k).alias(k or "undecided") for k, _ in DECISIONS])


def matrix_rows(papers: DataFrame, decisions: DataFrame, sort: str = "added", keep: str = "all") -> DataFrame:
    """``papers`` (with key, pos) and decision, filtered (all, none or a decision) and with columns order1, order2 to sort by."""
    rows = papers.join(decisions.select("key", "decision"), "key", "left").withColumn("decision", F.coalesce("decision", F.lit("")))
    if keep != "all":
        rows = rows.where(c("decision") == ("" if keep == "none" else keep))
    year = c("pub_year").try_cast("int")
    place = F.array_position(F.array(*[F.lit(k) for k, _ in DECISIONS]), c("decision"))
    keys: dict[str, Column] = {
        "added": F.lit(0), "year-desc": -F.coalesce(year, F.lit(0)), "year-asc": F.coalesce(year, F.lit(9999)),
        "author": F.collate(author_part(), "UNICODE") if sort == "author" else F.lit(0), "decision": place, "evidence": tx.evidence_rank(c("pub_types")) if sort == "evidence" else F.lit(0),
    }
    return rows.withColumn("order1", keys[sort]).withColumn("order2", c("pos"))


def suggestions(papers: DataFrame) -> DataFrame:
    """key, col_id, value of the design and sample size that each text suggests."""
    both = F.array(F.struct(F.lit("design").alias("col_id"), tx.study_design().alias("value")), F.struct(F.lit("size").alias("col_id"), tx.sample_size().alias("value")))
    return papers.select("key", F.explode(both).alias("s")).select("key", "s.*").where(c("value") != "")


def with_suggestions(cells: DataFrame, suggested: DataFrame, columns: DataFrame) -> DataFrame:
    """``cells(key, col_id, value)`` with suggestions in cells that are blank, for columns that still exist; filled marks them."""
    new = suggested.join(columns.select("col_id").distinct(), "col_id", "left_semi").select("key", "col_id", c("value").alias("s"))
    both = cells.join(new, ["key", "col_id"], "full")
    blank = F.length(tx.strip(F.coalesce("value", F.lit("")))) == 0
    return both.select("key", "col_id", F.when(blank & c("s").isNotNull(), c("s")).otherwise(c("value")).alias("value"), (blank & c("s").isNotNull()).alias("filled"))


def matrix_table(papers: DataFrame, cells: DataFrame, decisions: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The matrix as a wide table: fixed columns, then one per matrix column; cells are pivoted on the key."""
    wide = cells.groupBy("key").pivot("col_id", [k for k, _ in columns]).agg(F.first("value"))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in DECISIONS for x in pair]), F.coalesce("decision", F.lit("")))
    rows = papers.join(decisions.select("key", "decision"), "key", "left").join(wide, "key", "left")
    blank = lambda k: F.coalesce(c(k), F.lit(""))
    return rows.select(
        "pos", study_label().alias("Study"), F.regexp_replace("title", r"\.\z", "").alias("Title"), c("journal").alias("Journal"), c("pub_year").alias("Year"), c("pmid").alias("PMID"), blank("doi").alias("DOI"),
        tx.level_name(tx.evidence_rank(c("pub_types")), 2).alias("Evidence level"), label.alias("Decision"), *[blank(k).alias(name) for k, name in columns],
    )


def matrix_lines(table: DataFrame, separator: str = ",") -> DataFrame:
    """pos, line of a matrix table: the header (pos null), then a line per paper.

    As CSV, cells are quoted where needed and the header begins with a byte-order mark, by which spreadsheets know the encoding;
    lines end with CR LF (:data:`litforge.sources.files.MATRIX_BREAK`). With a tab as separator, breaks become spaces.
    """
    names = [x for x in table.columns if x != "pos"]
    cell = tx.csv_cell if separator == "," else (lambda v: F.regexp_replace(v, r"[\t\r\n]+", " "))
    lines = table.select(c("pos").cast("long").alias("pos"), F.concat_ws(separator, *[cell(F.coalesce(c(f"`{n}`"), F.lit(""))) for n in names]).alias("line"))
    head = table.sparkSession.range(1).select(F.lit(None).cast("long").alias("pos"), F.concat(F.lit("\ufeff" if separator == "," else ""), F.concat_ws(separator, *[cell(F.lit(n)) for n in names])).alias("line"))
    return head.unionByName(lines)


def column_ids(labels: DataFrame, label: str = "label", order: str = "pos") -> DataFrame:
    """``labels`` with col_id: a slug of the label; later equal slugs get -2, -3, …"""
    slug = F.coalesce(tx.given(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")), F.lit("column"))
    place = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return labels.withColumn("col_id", F.when(place > 1, F.concat_ws("-", slug, place.cast("string"))).otherwise(slug))


def relabelled(columns: DataFrame, col_id: str, label: str) -> DataFrame:
    """``columns`` with a new label for one; a blank label changes nothing."""
    new = label.strip()
    return columns.withColumn("label", F.when(c("col_id") == col_id, new).otherwise(c("label"))) if new else columns


def default_columns(lists: DataFrame) -> DataFrame:
    """list_id, pos, col_id, label: the columns a new matrix has, for every list."""
    seed = F.array(*[F.struct(F.lit(k).alias("col_id"), F.lit(label).alias("label")) for k, label in DEFAULT_COLUMNS])
    return lists.select("list_id", F.posexplode(seed).alias("pos", "x")).select("list_id", "pos", "x.*")


def without_column(columns: DataFrame, cells: DataFrame, col_id: str) -> tuple[DataFrame, DataFrame]:
    return columns.where(c("col_id") != col_id), cells.where(c("col_id") != col_id)


def decided(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """``decisions`` after ``changes(list_id, key, decision)``; an empty decision deletes the row."""
    kept = decisions.join(changes.select("list_id", "key"), ["list_id", "key"], "left_anti")
    return kept.unionByName(changes.where(tx.truthy(c("decision"))).select(*decisions.columns))


# ---------------------------------------------------------------- documents and cited records


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows and changes with the newest of each key by ``order``; one aggregation, no window."""
    both = rows.unionByName(changes)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def without_document(docs: DataFrame, pointer: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """``docs`` without one, and ``pointer(id)`` to the last opened one, which is cleared if it was that."""
    return docs.where(c("id") != doc_id), pointer.where(c("id") != doc_id)


def last_opened(docs: DataFrame, pointer: DataFrame) -> DataFrame:
    """The document that was opened last, no row if it is gone."""
    return docs.join(pointer.select("id"), "id", "left_semi")


def newest_first(docs: DataFrame, updated: str = "updated_at") -> DataFrame:
    return docs.orderBy(F.desc(updated), "id")


def cited_records(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """The cited keys with their records; missing marks keys without one."""
    return cited.join(papers.withColumn("__here", F.lit(True)), "key", "left").withColumn("missing", c("__here").isNull()).drop("__here")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
