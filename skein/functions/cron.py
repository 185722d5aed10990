"""Refresh schedules: five-field expressions as sets of numbers, and the next time that they fire.

All five fields have to match, and days of the week run from 0 (Monday) to 6, as names do (mon to sun).  An expression
that has not five fields, or a field that is no list of ``*``, ``n``, ``n-m`` with an optional step, is broken and taken
as ``DEFAULT``, every six hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "0 */6 * * *"
#: Name, least and greatest value, and names of values, in order of the fields.
FIELDS = (
    ("minute", 0, 59, ()), ("hour", 0, 23, ()), ("day", 1, 31, ()),
    ("month", 1, 12, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
    ("weekday", 0, 6, ("mon", "tue", "wed", "thu", "fri", "sat", "sun")),
)
#: Days after the last time that are looked at: 29 February may be eight years off.
AHEAD = 366 * 8 + 2


def _values(field: Column, least: int, most: int, names: tuple[str, ...]) -> Column:
    """The sorted values of a field, null where it is broken."""
    text = F.lower(field)
    for n, name in enumerate(names):
        text = F.regexp_replace(text, rf"\b{name}\b", str(n + least))
    parts = F.split(text, ",")

    def numbers(part: Column) -> Column:
        group = lambda k: F.regexp_extract(part, r"\A(?:(\*)|(\d{1,4})(?:-(\d{1,4}))?)(?:/(\d{1,4}))?\z", k)
        number = lambda k: F.nullif(group(k), F.lit("")).cast("int")
        star = group(1) == "*"
        lo = F.when(star, least).otherwise(number(2))
        hi = F.when(star, most).otherwise(F.coalesce(number(3), number(2)))
        step = F.coalesce(number(4), F.lit(1))
        lone = ~star & number(3).isNull() & number(4).isNotNull()  # a step needs a range
        return F.when((lo >= least) & (hi <= most) & (lo <= hi) & (step > 0) & ~lone, F.sequence(lo, hi, step))

    each = F.transform(parts, numbers)
    return F.when(F.forall(each, lambda x: x.isNotNull()), F.array_sort(F.array_distinct(F.flatten(each))))


def parse(expression: Column) -> Column:
    """A struct with the values of each field; those of ``DEFAULT`` for a broken or missing expression."""

    def sets(text: Column) -> list[Column]:
        parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
        return [F.when(F.size(parts) == len(FIELDS), _values(F.get(parts, F.lit(k)), *FIELDS[k][1:])) for k in range(len(FIELDS))]

    own, default = sets(expression), sets(F.lit(DEFAULT))
    whole = F.lit(True)
    for c in own:
        whole = whole & c.isNotNull()
    return F.struct(*[F.when(whole, o).otherwise(d).alias(f[0]) for o, d, f in zip(own, default, FIELDS, strict=True)])


def next_firings(rows: DataFrame, schedules: DataFrame, at: str = "at") -> DataFrame:
    """``rows`` times ``schedules`` (schedule, expression; a few) with the first firing after ``at``; null if there is none.

    Days that match are marked once for each schedule in a calendar; a row then takes the rest of its own day, or the first
    time of the next day that matches.
    """
    sets = schedules.select("schedule", "expression", parse(F.col("expression")).alias("_s"))
    span = rows.agg(F.to_date(F.min(at)).alias("lo"), F.to_date(F.max(at)).alias("hi")).filter("lo is not null")
    days = span.select(F.explode(F.sequence(F.col("lo"), F.date_add("hi", AHEAD))).alias("_day"))
    matches = F.array_contains("_s.month", F.month("_day")) & F.array_contains("_s.day", F.dayofmonth("_day")) & F.array_contains("_s.weekday", F.weekday("_day"))
    calendar = days.join(F.broadcast(sets)).withColumn("_fires", matches)
    ahead = Window.partitionBy("schedule").orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    calendar = calendar.select("schedule", "expression", "_s", "_day", "_fires", F.first(F.when(F.col("_fires"), F.col("_day")), ignorenulls=True).over(ahead).alias("_next"))
    met = rows.withColumn("_day", F.to_date(at)).join(calendar, "_day")
    hour, minute = F.hour(at), F.minute(at)
    this_hour = F.array_min(F.filter("_s.minute", lambda m: m > minute))
    later = F.array_min(F.filter("_s.hour", lambda h: h > hour))
    first_minute = F.array_min("_s.minute")
    same_day = F.when(F.array_contains("_s.hour", hour) & this_hour.isNotNull(), hour * 60 + this_hour).otherwise(later * 60 + first_minute)
    on_day = F.coalesce(F.when(F.col("_fires") & same_day.isNotNull(), F.struct(F.col("_day").alias("day"), same_day.alias("minutes"))), F.struct(F.col("_next").alias("day"), (F.array_min("_s.hour") * 60 + first_minute).alias("minutes")))
    fires = F.col("_on.day").cast(rows.schema[at].dataType) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_on.minutes"))
    return met.withColumn("_on", on_day).withColumn("fires_at", fires).drop("_day", "_s", "_fires", "_next", "_on")


def missed(rows: DataFrame, schedules: DataFrame, now: Column, at: str = "at") -> DataFrame:
    """The rows, with their first firing after ``at``, that should have been refreshed by ``now``."""
    return next_firings(rows, schedules, at).filter(F.col("fires_at") <= now)
