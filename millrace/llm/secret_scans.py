"""Secrets: base patterns, and character Markov models of random strings and ordinary identifiers.

Base patterns find assignments of secrets, access keys and long hexadecimal runs.
Beside them, runs of key characters outside all base spans are told apart by two
first-order Markov models over single characters: one of random strings, one of
ordinary identifiers. A run with a letter whose log-likelihood ratio reaches
``MIN_LLR`` is added as ``random``; numbers alone are left to personal data.

Labelled samples train the models. Ordinary is a document's first long run that
doesn't mix letters and digits, if no base span touches it; random are the values of base spans, and digests of the
ordinary runs in the alphabets in which keys are written (by construction random,
whatever secrets the corpus holds). Each class is a sample of at most ``SAMPLE``
distinct strings (digests: ``SAMPLE`` of each alphabet) by the smallest MD5; the
sample is bounded by a threshold that follows the number of strings, so no task
gets more than about twice as many. Weights are whole thousandths of a nat, so
sums don't depend on their order. The model has a fixed size, one weight for each
pair of characters, and nothing else comes to the driver.

Only DataFrame functions are used. Regular expressions take linear time: runs
start behind a character of another kind and are taken whole. Runs are scored in
pieces of ``PIECE`` characters that overlap by one.

Defined results: a null text is empty and has no spans; an empty table gives an
empty one. Rows with equal or null ids are treated one by one and equal texts get
equal spans; other columns are ignored, whatever their names are. Texts and runs
of any length are looked at as a whole. Without an ordinary string there is no
model and nothing is added. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shared
from millrace.llm.pii import guarded, located

KINDS = ["assign", "access", "hex"]
ADDED = "random"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"

MIN_LENGTH = 20  # characters of a run that may be random
MIN_DISTINCT = 8  # different characters of such a run
MIN_LLR = 25_000  # thousandths of a nat
BACKOFF = 20.0  # pairs
ORDINARY = 8  # characters of an ordinary identifier
KNOWN = 16  # characters of a base value that trains the random model
SAMPLE = 4096
PIECE = 256


def base_spans(text: Column) -> Column:
    """kind, start, end and value of all base spans, by start, then kind as listed."""

    def of(kind: str, spans: Column) -> Column:
        value = (lambda s: F.regexp_extract(s["value"], ASSIGN, 2)) if kind == "assign" else (lambda s: s["value"])
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), F.lit(kind).alias("kind"), s["end"].alias("end"), value(s).alias("value")))

    small = F.lower(text)
    maybe = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("key")
    assign = F.filter(of("assign", guarded(maybe & text.rlike(KEYWORD), located(text, ASSIGN))), lambda s: F.length(s["value"]) >= 6)
    access = of("access", guarded(text.contains("AKIA"), located(text, ACCESS)))
    hexes = of("hex", guarded(text.rlike(HEX), located(text, HEX)))
    return F.array_sort(F.concat(assign, access, hexes))


def run_of(least: int) -> str:
    return rf"(?<!{RUN}){RUN}{{{least},}}+"


#: A long run of letters or of digits, with separators; secrets that nobody has found yet have both, and shouldn't train the other side.
PLAIN = rf"(?<!{RUN})(?:[A-Za-z+/_=-]{{{ORDINARY},}}+|[0-9+/_=-]{{{ORDINARY},}}+)(?!{RUN})"


def found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, base spans, runs outside them that may be random, and the document's ordinary string."""
    rows = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("id", "text", base_spans(text).alias("base"))

    def free(start: Column, end: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < end) & (start < b["end"]))

    runs = F.filter(guarded(text.rlike(run_of(MIN_LENGTH)), located(text, run_of(MIN_LENGTH))), lambda r: r["value"].rlike("[A-Za-z]") & free(r["start"], r["end"]))
    rows = rows.select("id", "text", "base", runs.alias("runs"), F.regexp_extract("text", PLAIN, 0).alias("first"))
    at = F.instr("text", F.col("first")) - 1
    return rows.select("id", "base", "runs", F.when((F.col("first") != "") & free(at, at + F.length("first")), F.col("first")).alias("ordinary"))


def sampled(values: DataFrame, most: int) -> DataFrame:
    """value: at most so many distinct strings, those with the smallest MD5.

    A threshold on the first 32 bits leaves about twice as many before they are put in order.
    """
    draws = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    distinct = shared.stored(values.where("value IS NOT NULL").groupBy("value").agg(F.first(draws).alias("draw")), "strings")
    total = distinct.count()
    limit = (1 << 32) if total <= 2 * most else -(-2 * most * (1 << 32) // total) + 1
    return distinct.where(F.col("draw") < limit).orderBy("draw", "value").limit(most).select("value")


def labelled(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """value and random: the training strings."""
    ordinary = shared.stored(sampled(rows.select(F.col("ordinary").alias("value")), most), "ordinary")
    known = rows.select(F.explode("base.value").alias("value")).where((F.length("value") >= KNOWN) & F.col("value").rlike("[0-9]"))
    short = F.substring(F.sha2("value", 256), 1, 32)
    coded = [F.base64(F.unhex(F.sha2(F.concat("value", F.lit(more)), 256))) for more in ("", "+", "/")]
    made = ordinary.select(F.explode(F.array(short, F.upper(short), *coded)).alias("value"))
    return ordinary.withColumn("random", F.lit(False)).unionByName(sampled(known, most).union(made).withColumn("random", F.lit(True)))


def pieces(value: Column) -> Column:
    """Pieces of ``PIECE`` characters and the one after them."""
    cut = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    following = F.concat(F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), F.array(F.lit("")))
    return F.zip_with(cut, following, lambda a, b: F.concat(a, F.substring(b, 1, 1)))


def pairs_of(piece: Column) -> Column:
    """Neighbouring characters, as two-letter strings."""
    return F.when(F.length(piece) > 1, F.transform(F.sequence(F.lit(1), F.length(piece) - 1), lambda k: F.substring(piece, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def weights(strings: DataFrame) -> list[int] | None:
    """Thousandths of a nat for each pair of characters, or None if no ordinary string is known.

    What follows a character is smoothed by how often each character comes second at all, with the weight of ``BACKOFF`` pairs.
    """
    cut = strings.select("random", F.explode(pieces(F.col("value"))).alias("piece"))
    counts = cut.select("random", F.explode(pairs_of(F.col("piece"))).alias("pair")).groupBy("pair").agg(F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o"))
    size = len(ALPHABET)
    letters = strings.sparkSession.range(size).select((F.col("id") + 1).cast("int").alias("k")).select("k", F.substring(F.lit(ALPHABET), F.col("k"), F.lit(1)).alias("c"))
    grid = letters.toDF("i", "a").crossJoin(F.broadcast(letters.toDF("j", "b"))).withColumn("pair", F.concat("a", "b"))  # characters times characters
    cells = grid.join(F.broadcast(counts), "pair", "left").select("i", "j", "a", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    over = lambda *keys: Window.partitionBy(*keys)  # a row for each pair of characters
    sums = cells.select("*", *(F.sum(c).over(over(*keys)).cast("double").alias(f"{name}_{c}") for c in ("r", "o") for name, keys in (("before", ["i"]), ("after", ["j"]), ("all", []))))
    share = lambda c: (F.col(c) + BACKOFF * (F.col(f"after_{c}") + 1) / (F.col(f"all_{c}") + size)) / (F.col(f"before_{c}") + BACKOFF)
    done = sums.select("i", "j", F.floor(1000 * F.log(share("r") / share("o"))).cast("int").alias("w"), "o").orderBy("i", "j").collect()
    return [r["w"] for r in done] if any(r["o"] for r in done) else None


def score(value: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a run, in thousandths of a nat."""
    table = F.array(*map(F.lit, model))
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    weight = lambda p: F.get(table, place(F.substring(p, 1, 1)) * len(ALPHABET) + place(F.substring(p, 2, 1)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(F.transform(pieces(value), lambda piece: total(F.transform(pairs_of(piece), weight))))


def variety(value: Column) -> Column:
    """Number of different characters."""
    return F.size(F.array_distinct(F.flatten(F.transform(pieces(value), lambda p: F.array_distinct(F.split(p, ""))))))


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_llr: int = MIN_LLR, sample: int = SAMPLE) -> DataFrame:
    """id, base and added: arrays of start, no, kind, end (and value), by start, then kind as listed."""
    rows = shared.stored(found(docs, id_column, text_column), "runs")
    model = weights(labelled(rows, sample))
    nothing = F.array().cast("array<struct<start:int,no:int,kind:string,end:int,value:string>>")
    if model is None:
        added = nothing
    else:
        odd = F.filter("runs", lambda r: (variety(r["value"]) >= MIN_DISTINCT) & (score(r["value"], model) >= min_llr))
        added = F.transform(odd, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("no"), F.lit(ADDED).alias("kind"), r["end"].alias("end"), r["value"].alias("value")))
    return rows.select(F.col("id").alias(id_column), "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(done: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, number of spans of each base kind, digest of the base spans, all spans, and the number of added ones."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return done.select(id_column, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))
