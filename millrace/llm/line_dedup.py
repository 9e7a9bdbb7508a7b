"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

The lines with a word form one sequence per document, and its suffixes begin at
every line. Prefix doubling names the prefixes of 1, 2, 4, ... lines of the
suffixes: two suffixes have the same name at a level exactly if they begin with
the same so many lines. A name is the position of the first suffix of its class,
in order of document id and line. Doubling goes on until no class has two
members; suffixes that are alone leave at each level.

The names of all levels order the suffixes as a tree of classes. Going down the
levels, each suffix gets the length of the longest prefix that it shares with an
earlier suffix: it enters at the highest level where its class has an earlier
member, and the levels below lengthen the common prefix by 2**j lines wherever
members of a class agree on them. A class with the length at which its members
part is an interval of longest common prefixes. Suffixes whose length is not that
of the suffix one line before, less one, begin a maximal repeated run.

Later copies of runs of at least ``min_lines`` lines are deleted. Where a copy
overlaps the earlier one, the first ``min_lines`` lines of the earlier one stay, so
that of a run that repeats itself one period (or ``min_lines`` lines) is left. A
single line goes if it is a later copy and has ``min_chars`` characters.

Equal documents are one sequence: only the first of them meets the levels, the
others are copies as a whole. Lines and documents are compared by two hashes of 96
bits together. Names meet in aggregations, which combine a frequent key on the
map side; a key with over a thousandth of the rows joins by a broadcast of at most
a thousand such keys, so that it needs no task of its own.

Defined results: a null text stays null and has no lines; lines without a word
are no part of a sequence and stay; a document may become empty and is kept. An
empty table gives an empty one. A long text has one row per line here. Null ids
come last in the order, rows with equal ids in order of their place in the files;
rows that are equal altogether are copies of the first of them. Other columns are
carried along, whatever their names are. ``docs`` must read the same rows in the
same order each time, as files do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shared

MIN_LINES = 3
MIN_CHARS = 60
WORD = r"[^\x20\x09-\x0D]"


def numbered(docs: DataFrame) -> DataFrame:
    """row (all columns) and uid, which follows the place in the files."""
    return docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sequences(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """uid, id, lines (h1, h2 and long, of each line with a word) and d1, d2 (of all of them)."""
    lines = F.filter(split_lines(F.col("row")[text_column].cast("string")), lambda x: x.rlike(WORD))
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), (F.length(x) >= min_chars).alias("long")))
    rows = numbered(docs).select("uid", F.col("row")[id_column].alias("id"), each.alias("lines")).where(F.size("lines") > 0)
    return rows.select("*", F.xxhash64("lines").alias("d1"), F.hash("lines").alias("d2"))


def place(*more: str) -> list[Column]:
    """Order of documents, or of positions."""
    return [F.col("id").isNull().alias("last"), F.col("id"), F.col("uid"), *(F.col(c) for c in more)]


def named(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose keys occur again, with n_id, n_uid and n_at: the first position with these keys."""
    first = F.min(F.struct(*place("at")))
    return shared.regrouped(rows, keys, first, "first", ["uid", "at"], total).select("*", *(F.col(f"first.{c}").alias(f"n_{c}") for c in ("id", "uid", "at"))).drop("first")


def later(name: str = "n") -> Column:
    return (F.col(f"{name}_uid") != F.col("uid")) | (F.col(f"{name}_at") != F.col("at"))


#: span: the lines of the names of a level. It is a column, so that all levels run the same generated code.
NAME = ["uid", "id", "at", "n_id", "n_uid", "n_at", "span"]


def doubled(level: DataFrame, total: int) -> DataFrame:
    """Names of the prefixes that are twice as long."""
    far = level.select("uid", (F.col("at") - F.col("span")).alias("at"), F.col("n_uid").alias("b_uid"), F.col("n_at").alias("b_at"))
    near = level.select("uid", "id", "at", (2 * F.col("span")).alias("span"), F.col("n_uid").alias("a_uid"), F.col("n_at").alias("a_at"))
    return named(near.join(far, ["uid", "at"]), ["a_uid", "a_at", "b_uid", "b_at"], total).select(*NAME)


def levels_of(lines: DataFrame, total: int) -> list[DataFrame]:
    """Names of 1, 2, 4, ... lines, until none is left. lines: of the first level."""
    out = [lines]
    while not out[-1].isEmpty():
        out.append(shared.stored(doubled(out[-1], total), "level"))
    return out[:-1] or out


STATE = ["uid", "id", "at", "size", "f_id", "f_uid", "f_at"]


def lengthened(states: DataFrame, level: DataFrame, total: int) -> DataFrame:
    """States whose common prefix is longer by the lines of the level where an earlier member of the class agrees on them.

    f: the first member of the class, which takes part as well.
    """
    heads = states.select(*(F.col(f"f_{c}").alias(c) for c in ("uid", "id", "at")), "size", "f_id", "f_uid", "f_at").distinct()
    rows = states.select(*STATE, F.lit(True).alias("own")).unionByName(heads.withColumn("own", F.lit(False)))
    names = level.select("uid", F.col("at").alias("far"), F.col("n_uid").alias("g_uid"), F.col("n_at").alias("g_at"), "span")
    tried = rows.withColumn("far", F.col("at") + F.col("size")).join(names, ["uid", "far"]).drop("far")
    moved = named(tried, ["g_uid", "g_at", "f_uid", "f_at", "size"], 2 * total).where(F.col("own") & later())
    longer = moved.select("uid", "id", "at", (F.col("size") + F.col("span")).alias("size"), *(F.col(f"n_{c}").alias(f"f_{c}") for c in ("id", "uid", "at")))
    best = F.max(F.struct(*(c for c in STATE[3:]))).alias("best")
    both = states.select(*STATE).unionByName(longer).groupBy("uid", "at").agg(F.first("id").alias("id"), best)
    return shared.stored(both.select("uid", "id", "at", "best.*"), "states")


def repeats(levels: list[DataFrame], min_lines: int, total: int) -> DataFrame:
    """``STATE`` of each position whose first ``min_lines`` lines occur at an earlier one: the longest such prefix (size), and its first place (f)."""
    least = min_lines.bit_length() - 1
    entering = [
        level.where(later()).select("uid", "id", "at", F.col("span").alias("size"), *(F.col(f"n_{c}").alias(f"f_{c}") for c in ("id", "uid", "at")))
        for level in levels
    ]
    if len(levels) <= least:
        return entering[0].select(*STATE).limit(0)
    states = None
    for j in range(len(levels) - 1, -1, -1):
        if j >= least:  # those that have no earlier copy one level higher
            own = entering[j].select(*STATE)
            own = own.join(entering[j + 1].select("uid", "at"), ["uid", "at"], "left_anti").select(*STATE) if j + 1 < len(levels) else own
            states = own if states is None else states.unionByName(own)
        if j:
            states = lengthened(states, levels[j - 1], total)
    return states.where(F.col("size") >= min_lines)


def with_starts(states: DataFrame, min_lines: int) -> DataFrame:
    """States with skip (lines at the begin of the copy that the earlier one keeps) and tail (the run began one line before)."""
    near = F.when(F.col("uid") == F.col("f_uid"), F.greatest(F.lit(0), min_lines - F.col("at") + F.col("f_at"))).otherwise(0)
    order = Window.partitionBy("uid").orderBy("at")
    before = (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("size").over(order) == F.col("size") + 1)
    out = states.withColumn("skip", near)
    return out.select("*", F.coalesce(before, F.lit(False)).alias("tail"), F.coalesce(F.lag("skip").over(order), F.lit(0)).alias("skip_before"))


def analysed(docs: DataFrame, id_column: str, text_column: str, min_lines: int, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Later copies of whole documents (uid, first); runs (as ``with_starts``); single long lines that are later copies (uid, at)."""
    told = shared.stored(sequences(docs, id_column, text_column, min_chars), "sequences")
    sizes = told.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines")).first()
    same = shared.regrouped(told.select("uid", "id", "d1", "d2"), ["d1", "d2"], F.min(F.struct(*place())), "first", ["uid"], sizes["rows"])
    copies = same.where(F.col("first.uid") != F.col("uid")).select("uid", "first")
    whole = told.groupBy("d1", "d2").agg(F.min(F.struct(*place("lines"))).alias("x"))
    lines = shared.stored(whole.select("x.uid", "x.id", F.posexplode("x.lines").alias("at", "l")).select("uid", "id", "at", "l.*"), "lines")
    total = sizes["lines"]
    first = shared.stored(named(lines.withColumn("span", F.lit(1)), ["h1", "h2"], total).select(*NAME, "long"), "level")
    states = repeats(levels_of(first, total), min_lines, total)
    return copies, with_starts(states, min_lines), first.where(F.col("long") & later()).select("uid", "at")


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal repeated runs: id, line (place among the lines with a word), n_lines, and first_id, first_line of the first copy.

    Of equal documents the first one alone has rows.
    """
    _, found, _ = analysed(docs, id_column, text_column, min_lines, 1 << 30)
    return found.where(~F.col("tail")).select(F.col("id").alias(id_column), F.col("at").alias("line"), F.col("size").alias("n_lines"), F.col("f_id").alias("first_id"), F.col("f_at").alias("first_line"))


def deletions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """uid (as of ``numbered``), copy (of a whole document) and cuts: first and last place of lines to delete."""
    copies, found, single = analysed(docs, id_column, text_column, min_lines, min_chars)
    # a run that began one line before is covered by that one, unless its lines were spared there
    found = found.where(~F.col("tail") | (F.col("skip_before") > 0))
    cuts = found.select("uid", (F.col("at") + F.col("skip")).alias("low"), (F.col("at") + F.col("size") - 1).alias("high")).where("low <= high")
    cuts = cuts.unionByName(single.select("uid", F.col("at").alias("low"), F.col("at").alias("high")))
    by_uid = cuts.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("cuts")).select("uid", F.lit(False).alias("copy"), "cuts")
    return by_uid.unionByName(copies.select("uid", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<low:int,high:int>>").alias("cuts")))


def marked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (all columns), n_lines, n_deleted and rest: the text without the deleted lines."""
    gone = deletions(docs, id_column, text_column, min_lines, min_chars)
    both = numbered(docs).join(gone, "uid", "left")
    text = F.col("row")[text_column].cast("string")

    def places(lines: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))

    def numbers(lines: Column, own: Column) -> Column:
        """Of a copy: all lines with a word if there are enough, else the long ones."""
        whole = F.when(F.size(own) >= min_lines, own).otherwise(F.filter(own, lambda i: F.length(F.get(lines, i)) >= min_chars))
        part = F.array_distinct(F.flatten(F.transform("cuts", lambda c: F.slice(own, c["low"] + 1, c["high"] - c["low"] + 1))))
        return F.when(F.col("copy"), whole).otherwise(part)

    def without(lines: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("rest"), F.size(gone).alias("n"))

    cut = bound(split_lines(text), lambda lines: bound(places(lines), lambda own: bound(numbers(lines, own), lambda gone: without(lines, gone))))
    done = F.when(F.col("copy").isNotNull(), cut)
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(split_lines(text))).cast("long")
    return both.select("row", n.alias("n_lines"), F.coalesce(done["n"], F.lit(0)).cast("long").alias("n_deleted"), F.when(F.col("copy").isNull(), text).otherwise(done["rest"]).alias("rest"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, also where the optimizer repeats the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows with all their columns, later copies deleted from the text."""
    done = marked(docs, id_column, text_column, min_lines, min_chars)
    return done.select(*(F.col("rest").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))
