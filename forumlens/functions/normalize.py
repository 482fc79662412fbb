"""Column expressions that normalise scraped count and time texts.

Both are pure JVM expressions (regex, decimal and timestamp functions), so they
run inside whole-stage code generation; invalid input gives NULL (ANSI-safe
``try_`` functions), never an error, and ``quarantine`` turns the NULLs into
reasons.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width digits and separators mapped to ASCII before parsing.
FULL_WIDTH = "０１２３４５６７８９．，"
ASCII = "0123456789.,"
# Unit suffixes dropped after a number; multipliers for 万 and 千.
UNITS = ("件", "個", "円", "人", "回", "分", "時間")
MULTIPLIERS = {"万": 10000, "千": 1000}
# The word for "just now", the suffix for "ago" and the units before it.
JUST_NOW = "たった今"
AGO = "前"
AGO_UNITS = {"分": "minutes", "時間": "hours", "日": "days"}

NUMBER_PATTERN = ("^([0-9][0-9,]*([.][0-9]+)?)(" + "|".join(MULTIPLIERS) + ")?("
                  + "|".join(UNITS) + ")?$")
STAMP_FORMAT = "y/M/d H:m"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_count(text) -> Column:
    """Count text -> BIGINT: ``1.3万`` 13000, ``2.5千`` 2500, ``1,234,567``, ``1,939件``,
    empty -> 0, NULL -> NULL, anything else -> NULL."""
    t = F.trim(F.translate(_col(text), FULL_WIDTH, ASCII))
    number = F.regexp_extract(t, NUMBER_PATTERN, 1)
    mult_sym = F.regexp_extract(t, NUMBER_PATTERN, 3)
    digits = F.regexp_replace(number, ",", "")
    mult = F.when(mult_sym == "万", F.lit(10000)).when(mult_sym == "千", F.lit(1000)).otherwise(F.lit(1))
    exact = F.floor(digits.try_cast("decimal(24,6)") * mult).cast("bigint")
    return (F.when(_col(text).isNull(), F.lit(None).cast("bigint"))
             .when(t == "", F.lit(0).cast("bigint"))
             .when(number == "", F.lit(None).cast("bigint"))
             # a fraction is only valid in front of a multiplier
             .when(F.instr(number, ".") > 0, F.when(mult_sym != "", exact))
             .otherwise(exact))


def _ago(body: Column, base: Column) -> Column:
    """``base`` minus a number followed by one of the units; NULL for anything else."""
    found = F.lit(None).cast("timestamp_ntz")
    for unit, name in AGO_UNITS.items():
        n = F.replace(body, F.lit(unit), F.lit("")).try_cast("int")
        span = {"days": (n, F.lit(0), F.lit(0)), "hours": (F.lit(0), n, F.lit(0)),
                "minutes": (F.lit(0), F.lit(0), n)}[name]
        found = F.when(body.endswith(unit) & (n >= 0), base - F.make_dt_interval(*span, F.lit(0))).otherwise(found)
    return found


def _stamp(day: Column, clock: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


def normalize_time(text, base) -> Column:
    """Posted-time text -> TIMESTAMP_NTZ cut to the minute, relative to ``base``
    (the row's scrape time): just now, n minutes/hours/days ago, ``m/d(w) h:mm``
    (a date later than ``base`` moves back one year) and ``y/m/d(w) h:mm``.

    A written date is the part before the bracket, its time the first word after it.
    """
    t, b = _col(text), _col(base)
    day = F.substring_index(t, "(", 1)
    clock = F.substring_index(F.trim(F.substring_index(t, ")", -1)), " ", 1)
    in_year = lambda year: _stamp(F.concat_ws("/", year.cast("string"), day), clock)
    slashes = F.length(day) - F.length(F.replace(day, F.lit("/"), F.lit("")))
    this_year = in_year(F.year(b))
    written = (F.when(slashes == 2, _stamp(day, clock))
                .when((slashes == 1) & (this_year > b), in_year(F.year(b) - 1))
                .when(slashes == 1, this_year))
    return F.date_trunc("minute", (
        F.when(t == JUST_NOW, b)
         .when(F.instr(t, AGO) > 0, _ago(F.substring_index(t, AGO, 1), b))
         .when((F.instr(t, "(") > 0) & (F.instr(t, ")") > 0), written))).cast("timestamp_ntz")
