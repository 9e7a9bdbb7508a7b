"""URL filters by a temporal list join.

A list is a history of dated entries: from some date on, a key is blocked,
allowed, or removed from the list. Entries become validity intervals, and an
as-of join evaluates every capture against the entries that are active when it
was fetched.

Keys are of three kinds: ``domain`` (a host and all below it), ``host`` (this
host alone) and ``prefix`` (host and path, by whole segments). The most specific
active entry decides: the longest prefix, then the host, then the longest
domain; a block wins over an allow of the same key.

Entries of a key are reduced to one for each date before they are ordered, so
the window over a key is as long as its history in days and not as its entries.
Captures meet intervals in one equi-join on the key: Spark splits a host with a
large share of the captures, and broadcasts the intervals only if they are small.

Work per capture follows the list: a host has as many domain keys as the deepest
domain entry has labels, a path as many as the deepest prefix entry has segments.
What precedes the last @ of an authority is the user.

Defined results: a capture with a null or malformed URL or a null date is decided
by no entry (verdict ``none``); an empty table gives an empty one, an empty list
decides nothing; URLs of any length are looked at as a whole. Entries
with a null key, date or unknown action are no entries. Of entries of a key on
the same date, block wins over allow and allow over remove. Repeated captures
are decided one by one; other columns are carried along, whatever their names
are. ``captures`` must read the same rows in the same order each time, as files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIONS = {"remove": 0, "allow": 1, "block": 2}


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; empty if malformed."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1)
    return F.lower(F.rtrim(host, F.lit(".")))


def path_of(url: Column) -> Column:
    """Path with its first slash, without query and fragment."""
    return F.regexp_extract(url, r"^[^/]*//[^/?#]*(/[^?#]*)", 1)


def prefix_depth(key: Column) -> Column:
    return F.size(F.split(F.rtrim(key, F.lit("/")), "/")) - 1


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, rank (of the action), since and until (exclusive; null: still valid).

    entries: list, kind, key, action, day.
    """
    rank = F.coalesce(*(F.when(F.col("action") == a, F.lit(r)) for a, r in ACTIONS.items()))
    key = F.when(F.col("kind") == "prefix", F.rtrim("key", F.lit("/"))).otherwise(F.lower("key"))
    daily = entries.select("list", "kind", key.alias("key"), "day", rank.alias("rank")).where("key IS NOT NULL AND day IS NOT NULL AND rank IS NOT NULL AND kind IN ('domain', 'host', 'prefix')")
    daily = daily.groupBy("list", "kind", "key", "day").agg(F.max("rank").alias("rank"))
    order = Window.partitionBy("list", "kind", "key").orderBy("day")
    return daily.select("list", "kind", "key", "rank", F.col("day").alias("since"), F.lead("day").over(order).alias("until")).where("rank > 0")


def keys(host: Column, path: Column, depth: int, deepest: int) -> Column:
    """Kind, key and weight of every entry that may decide a capture. depth: of the deepest prefix entry, deepest: of the deepest domain."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.greatest(F.size(labels) - deepest + 1, F.lit(1)), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (F.size(labels) - i + 1).alias("weight")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1_000_000).alias("weight")))
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (1_000_000 + i).alias("weight")))
    with_paths = F.when(F.size(parts) > 0, F.concat(domains, own, prefixes)).otherwise(F.concat(domains, own)) if depth else F.concat(domains, own)
    return F.when(host != "", with_paths)


def decide(captures: DataFrame, entries: DataFrame, url_column: str = "url", day_column: str = "fetched") -> DataFrame:
    """row (all columns of the capture), verdict (block, allow or none), and the deciding list, kind, key and since."""
    valid = intervals(entries)
    depths = F.when(F.col("kind") == "prefix", prefix_depth(F.col("key"))).otherwise(F.size(F.split("key", r"\.")))
    deepest = dict(valid.groupBy("kind").agg(F.max(depths)).collect())  # a row for each kind
    rows = captures.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"))
    url = F.col("row")[url_column].cast("string")
    wanted = rows.select("uid", F.col("row")[day_column].cast("date").alias("day"), F.explode(keys(host_of(url), path_of(url), deepest.get("prefix", 0), max(1, deepest.get("domain", 1)))).alias("k"))
    wanted = wanted.select("uid", "day", "k.kind", "k.key", "k.weight").where("day IS NOT NULL")
    active = wanted.join(valid, ["kind", "key"]).where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = active.groupBy("uid").agg(F.max(F.struct("weight", "rank", "list", "kind", "key", "since")).alias("best"))
    verdict = F.when(F.col("best.rank") == ACTIONS["block"], "block").when(F.col("best.rank") == ACTIONS["allow"], "allow").otherwise("none")
    return rows.join(best, "uid", "left").select("row", verdict.alias("verdict"), "best.list", "best.kind", "best.key", "best.since")


def keep(captures: DataFrame, entries: DataFrame, url_column: str = "url", day_column: str = "fetched") -> DataFrame:
    """The captures that aren't blocked, with all their columns."""
    done = decide(captures, entries, url_column, day_column).where("verdict <> 'block'")
    return done.select(*(F.col("row")[c].alias(c) for c in captures.columns))
