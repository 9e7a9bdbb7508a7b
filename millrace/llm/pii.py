"""Personal data: base patterns, and bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers. These are seed entities, and so are hexadecimal strings of the usual
lengths of keys and digests, which are seeds of secrets but no base spans. The
words around each seed induce lexical patterns (two words before; a word before
and one after; a key before = or :). Tokens that look like identifiers (they hold
a digit or @) and are no seeds meet the same patterns. A graph of patterns and instances is scored in rounds:
a pattern by the confidence of its distinct instances, an instance by its
patterns; instances of high confidence support all their patterns in the next
round, so that patterns with few seeds or none come in as well. What stands in a
pattern of high confidence and is no base span is added as ``context_<kind>``;
hexadecimal strings elsewhere are not.

Only DataFrame functions are used. The texts are read once; the graph holds
occurrences, without texts. In each round, patterns with too little support leave
before the join with their instances; a frequent pattern or instance meets
aggregations first, which combine on the map side.

Regular expressions avoid repeated groups and repeated starts inside one run,
so that long runs of letters or digits take linear time: single separators
inside numbers and domains are replaced by a mark of the same length first.
Places are summed up in short lists, and contexts are cut from pieces of
``PIECE`` code points, so that a long text with many matches takes time by its
length. Of a context the ``AROUND`` nearest code points are looked at.

Defined results: a null text is empty and has no spans; an empty table gives an
empty one. Rows with equal or null ids are treated one by one and equal texts get
equal spans; of patterns with equal scores the kind that comes last by name wins;
other columns are ignored. Offsets count code points, ends are exclusive. ``docs`` must read the same rows in the same order
each time, as files do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

KINDS = ["email", "ip", "card", "phone"]
MARK, OTHER = "\u0001", "\u0002"
LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit or @; brackets before it are taken off later, so that each token is read once.
CANDIDATE = r"(?<![^\s\"',;])[^\s\"',;0-9@]*+[0-9@][^\s\"',;]*+"
#: Seeds of secrets: 128, 160 or 256 bits in hexadecimal.
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
SECRET = "secret"
PIECE = 4096
AROUND = 80  # code points of context that are looked at on each side

ROUNDS = 3
MIN_SEEDS = 5  # distinct seeds of a pattern, and found instances by their confidence
MIN_CONFIDENCE = 0.8


def located(text: Column, pattern: str) -> Column:
    """start, end and value of each match, leftmost first, not overlapping."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("value")))
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), nothing.alias("open"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        """Matches go to a short list, and full ones to a list of lists, so that no long list is copied for each match."""
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        room = F.size(acc["open"]) < 256
        return F.struct(
            end.alias("at"),
            F.when(room, F.concat(acc["open"], own)).otherwise(own).alias("open"),
            F.when(room, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["open"]))).alias("full"),
        )

    found = F.aggregate(pairs, begin, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["open"]))))
    return F.when(F.size(values) > 0, found).otherwise(nothing)


def guarded(may: Column, spans: Column) -> Column:
    """The spans where the text may have any; a cheap test spares most texts the rest."""
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def marked(text: Column, separator: str, side: str) -> Column:
    """The text with a mark for each single separator between characters of ``side``; places stay the same."""
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), f"(?<=[{side}])[{separator}](?=[{side}])", MARK)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind."""

    def card_ok(x: Column) -> Column:
        number = digits(x["value"])
        return F.length(number).between(16, 19) & F.call_function("luhn_check", number)

    def ip_ok(x: Column) -> Column:
        return x["value"].rlike(rf"\A{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}\z")

    def phone_ok(x: Column) -> Column:
        return F.length(digits(x["value"])).between(8, 15)

    return {
        "email": guarded(text.contains("@"), located(marked(text, ".", "A-Za-z0-9-"), EMAIL)),
        "ip": F.filter(guarded(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), located(text, IP)), ip_ok),
        "card": F.filter(guarded(text.rlike(r"(?:[0-9][ -]?){15}[0-9]"), located(marked(text, " -", "0-9"), CARD)), card_ok),
        "phone": F.filter(guarded(text.rlike(r"\+[0-9]"), located(text, PHONE)), phone_ok),
    }


def word(text: Column, pattern: str) -> Column:
    """Lower-case word of a context; empty where there is none."""
    return F.lower(F.regexp_extract(text, pattern, 1))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def before(cut: Column, place: Column) -> Column:
    """The code points before a place. cut: the pieces of the text."""
    k = F.greatest((place / PIECE).cast("int") - 1, F.lit(0))
    local = place - k * PIECE
    low = F.greatest(local - AROUND, F.lit(0))
    return F.substring(F.concat_ws("", F.get(cut, k), F.get(cut, k + 1)), low + 1, local - low)


def after(cut: Column, place: Column) -> Column:
    k = (place / PIECE).cast("int")
    return F.substring(F.concat_ws("", F.get(cut, k), F.get(cut, k + 1)), place - k * PIECE + 1, F.lit(AROUND))


def in_context(cut: Column, span: Column, kind: Column) -> Column:
    """An occurrence: its place, value, kind (null: unknown) and patterns."""
    start, end = span["start"], span["end"]
    left, right = before(cut, start), after(cut, end)
    one = word(left, r"(\S+)\s*$")
    two = word(left, r"(\S+)\s+\S+\s*$")
    following = word(right, r"^[^\s\w]*\s*(\S+)")
    key = word(left, r"([\p{L}_-]+)\s*[=:]\s*[\"']?$")
    patterns = F.array(
        F.when((two != "") & (one != ""), F.concat_ws(" ", two, one, F.lit("_"))),
        F.when((one != "") & (following != ""), F.concat_ws(" ", one, F.lit("_"), following)),
        F.when(key != "", F.concat(key, F.lit("=_"))),
    )
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        span["value"].alias("value"),
        kind.cast("string").alias("kind"),
        F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
    )


def with_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """uid, id, base (spans by kind and start) and seen (occurrences of seeds and of candidates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    by_kind = base_spans(text)
    some = text.rlike("[0-9@]")
    by_kind[SECRET] = guarded(some & text.rlike("[0-9a-f]{32}"), located(text, HEX))
    rows = rows.select("uid", "id", text.alias("text"), *(v.alias(f"b_{k}") for k, v in by_kind.items()))
    text = F.col("text")
    base = F.concat(*(with_kind(F.col(f"b_{k}"), k) for k in KINDS))
    some = text.rlike("[0-9@]")
    tokens = guarded(some, located(text, CANDIDATE))

    def bare(t: Column) -> Column:
        """The token without the brackets before it."""
        value = F.regexp_replace(t["value"], r"^[(\[{<]+", "")
        return F.struct((t["end"] - F.length(value)).alias("start"), t["end"].alias("end"), value.alias("value"))

    tokens = F.filter(F.transform(tokens, bare), lambda t: F.length(t["value"]) >= 5)
    rows = rows.select("*", base.alias("base"), tokens.alias("tokens"), F.when(some, pieces(text)).alias("cut"))

    def seed(kind: str) -> Callable[[Column], Column]:
        """Values of marked texts lose their marks: a card is known by its digits."""
        plain = digits if kind == "card" else lambda v: F.replace(v, F.lit(MARK), F.lit("."))
        return lambda s: in_context(F.col("cut"), s.withField("value", plain(s["value"])), F.lit(kind))

    seeds = F.concat(*(F.transform(F.col(f"b_{k}"), seed(k)) for k in [*KINDS, SECRET]))

    def unseen(t: Column) -> Column:
        return ~F.exists(F.concat("base", with_kind(F.col("b_secret"), SECRET)), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    def without_key(t: Column) -> Column:
        """key=value: the value alone is the instance."""
        skip = F.length(F.regexp_extract(t["value"], r"^([\p{L}_-]+[=:][\"']?)(?=.{4})", 1))
        return F.struct((t["start"] + skip).alias("start"), t["end"].alias("end"), F.substring(t["value"], skip + 1, F.length(t["value"])).alias("value"))

    others = F.transform(F.filter(F.col("tokens"), unseen), lambda t: in_context(F.col("cut"), without_key(t), F.lit(None)))
    return rows.select("uid", "id", "base", F.concat(seeds, others).alias("seen"))


def scored(edges: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """pattern, kind and score of the patterns of high confidence.

    edges: pattern, value, kind (null for candidates), one row each.
    """
    pairs = shared.stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("known")), "pairs")
    unknown = pairs.where("known IS NULL").select("pattern", "value")
    sizes = shared.stored(pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds), "sizes")
    seeds = shared.stored(edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("support")), "seeds")
    support = seeds
    for left in range(rounds, -1, -1):
        # unknown instances could still turn out to be of the kind, instances of other kinds can't; a pattern has few kinds
        kinds = support.groupBy("pattern").agg(F.sum("support").alias("all"), F.collect_list(F.struct("kind", "support")).alias("kinds"))
        live = kinds.where(F.col("all") >= min_seeds).select("pattern", "all", F.explode("kinds").alias("k")).select("pattern", "all", "k.kind", "k.support")
        live = live.where((F.col("support") >= min_seeds) & (F.col("support") >= min_confidence * F.col("all"))).join(sizes, "pattern")
        scores = shared.stored(live.select("pattern", "kind", F.least(F.lit(1.0), F.col("support") / F.col("n")).alias("score")), "scores")
        if not left:
            break
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))
        instances = unknown.join(scores, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        sure = shared.stored(instances.where(F.col("confidence") >= min_confidence), "sure")
        # over all patterns of the sure instances, not only over those that found them
        gained = unknown.join(sure, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
        support = seeds.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("support").alias("support"))
    return scores.where(F.col("score") >= min_confidence)


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """id, base and added: arrays of kind, start, end; base by kind as in ``KINDS``, then start."""
    rows = shared.stored(found(docs, id_column, text_column), "seen")
    seen = rows.select("uid", F.explode("seen").alias("x")).select("uid", "x.*")
    each = seen.select("uid", "start", "end", "value", "kind", F.explode("patterns").alias("pattern"))
    edges = shared.stored(each.select("pattern", "value", "kind").distinct(), "graph")
    sure = scored(edges, rounds, min_seeds, min_confidence)
    # a value stands in few sure patterns; the best kind of each place wins
    hits = each.where(f"kind IS NULL OR kind = '{SECRET}'").drop("kind").join(sure, "pattern").groupBy("uid", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    added = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("context_"), "best.kind").alias("kind"), "start", "end"))).alias("added"))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(added, "uid", "left").select(F.col("id").alias(id_column), "base", F.coalesce("added", nothing).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

