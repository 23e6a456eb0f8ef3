"""Display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statistics shown first, in this order.
FIRST_STATS = ["views", "age", "info", "points", "comments"]
DAY_MS = 86_400_000


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def collection_text(names: Column) -> Column:
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", ")


def stats_text(stats: Column, hide_age: bool = False) -> Column:
    first = F.array(*(F.coalesce(stats[k], F.lit("")) for k in FIRST_STATS if not (hide_age and k == "age")))
    rest = F.transform(F.filter(F.map_entries(stats), lambda e: ~e["key"].isin(FIRST_STATS) & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.coalesce(F.array_join(F.concat(F.filter(first, lambda x: x != ""), rest), " · "), F.lit(""))


def poster_text(name: Column, handle: Column) -> Column:
    n, h = F.coalesce(name, F.lit("")), F.regexp_replace(F.coalesce(handle, F.lit("")), "^@", "")
    return F.when((n != "") & (h != ""), F.concat(n, F.lit(" (@"), h, F.lit(")"))).when(n != "", n).when(h != "", F.concat(F.lit("@"), h)).otherwise("")


#: From where an age is told in the next unit, and days of a month and a year (fixed values).
DAYS_TO, WEEKS_TO, MONTHS_TO, MONTH, YEAR = 14, 8, 12, 30.4375, 365.25


def relative_date(ts: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0), F.floor((now - ts) / DAY_MS))
    rounded = lambda x: F.floor(days / x + 0.5)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    weeks, months, years = rounded(7), rounded(MONTH), rounded(YEAR)
    text = F.when(days < 1, "today").when(days < DAYS_TO, ago(days, "day")).when(weeks < WEEKS_TO, ago(weeks, "week")).when(months < MONTHS_TO, ago(months, "month")).otherwise(ago(years, "year"))
    return F.when(ts.isNull() | (ts == 0), "").otherwise(text)


def synced_text(ts: Column, now: Column) -> Column:
    minutes = F.floor((now - ts) / 60000 + 0.5)
    return F.when(ts.isNull() | (ts == 0), "never synced").when(minutes < 1, "synced just now").when(minutes < 60, F.concat(F.lit("synced "), minutes.cast("string"), F.lit(" min ago"))).otherwise(F.concat(F.lit("synced "), F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd HH:mm:ss")))
