"""Times in text: the shape of a text tells its parts, and one attempt reads them.

Days are written year first (2024-01-05, 2024/1/5, 2024.01.05), month first with
slashes (01/05/2024; day first where the first number can be no month), day first
with dots (05.01.2024), with an English month name (5 January 2024, Jan 5, 2024), as a
month alone (2024-01, its first day), or as eight digits from 1900 to 2099 (20240105).
Any other plain number is no time. A time of day may follow, after a blank or T: hours and minutes,
seconds, a fraction, AM or PM, and a zone (Z, UTC, GMT or an offset). Without a
zone the session's time zone holds. What has a shape but is no day (2024-02-30) is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NAME = "(?<![A-Za-z])(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![A-Za-z])"

#: Shapes of days: what they match at the start of a text, and the day as year-month-day.
DAYS = [
    (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9])", "$1-$2-$3"),
    (r"^([0-9]{4})-([0-9]{1,2})$", "$1-$2-1"),
    (r"^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9.])", "$1-$2-$3"),
    (r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?![0-9])", "$3-$2-$1"),
    (r"^(1[3-9]|2[0-9]|3[01])/([0-9]{1,2})/([0-9]{4})(?![0-9])", "$3-$2-$1"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?![0-9])", "$3-$1-$2"),
    (r"^([0-9]{1,2})[ -]#([0-9]{1,2})\.?,?[ -]([0-9]{4})(?![0-9])", "$3-$2-$1"),
    (r"^#([0-9]{1,2})\.? ([0-9]{1,2}),? ([0-9]{4})(?![0-9])", "$3-$1-$2"),
]
ZONE = r"(Z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)?"
CLOCK = rf"^[T ] *([0-9]{{1,2}}):([0-9]{{2}}) *{ZONE}$"
SECONDS = rf"^[T ] *([0-9]{{1,2}}):([0-9]{{2}}):([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))? *{ZONE}$"
COMPACT = rf"^T([0-9]{{2}})([0-9]{{2}})([0-9]{{2}}) *{ZONE}$"
HALVES = r"^[T ] *([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))? *([AaPp])[Mm]$"
LONGEST = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clock(rest: Column) -> Column:
    """What follows a day, as a time of day with seconds and zone."""
    hour = F.regexp_extract(rest, HALVES, 1).try_cast("int")
    noon = F.when(F.lower(F.regexp_extract(rest, HALVES, 4)) == "p", 12).otherwise(0)
    second = F.regexp_extract(rest, HALVES, 3)
    return (
        F.when(rest == "", "")
        .when(rest.rlike(SECONDS), F.regexp_replace(rest, SECONDS, " $1:$2:$3.$40$5"))
        .when(rest.rlike(CLOCK), F.regexp_replace(rest, CLOCK, " $1:$2:00$3"))
        .when(rest.rlike(COMPACT), F.regexp_replace(rest, COMPACT, " $1:$2:$3$4"))
        .when(rest.rlike(HALVES) & hour.between(1, 12), F.concat(F.lit(" "), (hour % 12 + noon).cast("string"), F.lit(":"), F.regexp_extract(rest, HALVES, 2), F.lit(":"), F.when(second == "", "00").otherwise(second)))
    )


def split(text: Column) -> Column:
    """The day and what follows it, by the first shape that the text has."""
    found = None
    for shape, day in DAYS:
        first = F.regexp_extract(text, shape, 0)
        both = F.struct(F.regexp_replace(first, shape, day).alias("day"), F.substring(text, F.length(first) + 1, F.lit(LONGEST)).alias("rest"))
        found = F.when(text.rlike(shape), both) if found is None else found.when(text.rlike(shape), both)
    return found


def numbered(text: Column) -> Column:
    """The text with a # and a number for the name of a month."""
    month = F.lower(F.substring(F.regexp_extract(text, NAME, 0), 1, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("string")
    return F.when(month == "", text).otherwise(F.regexp_replace(text, F.lit(NAME), F.concat(F.lit("#"), number)))


def as_time(text: Column) -> Column:
    """A timestamp if the text has one of the shapes, else null."""
    may = (F.length(text) <= LONGEST) & text.rlike("[0-9]{2}")
    return F.when(may, let(numbered(F.trim(text)), lambda t: let(split(t), lambda p: F.concat(p["day"], let(p["rest"], clock)))).try_cast("timestamp"))
