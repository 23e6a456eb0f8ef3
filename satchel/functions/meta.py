"""The line of facts under an item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.functions import report as R

#: How older rows of stories hold their counts in the summary (a fixed form).
OLD_COUNTS = r"^\d[\d,]* points? · \d[\d,]* comments?$"


def saved_date(provider: Column, bookmarked: Column, published: Column, now: Column) -> Column:
    """The day an item was saved or published; a video's estimated day is told as an age."""
    saved, made = F.nullif(bookmarked, F.lit(0)), F.nullif(published, F.lit(0))
    about = F.concat(F.lit("about "), R.relative_date(made, now))
    day = F.date_format(F.timestamp_millis(F.coalesce(saved, made)), "MMM d, yyyy")
    return F.when((provider == "youtube") & saved.isNull() & made.isNotNull(), about).otherwise(F.coalesce(day, F.lit("")))


def meta_line(label: Column, provider: Column, kind: Column, duration: Column, stats: Column, collection: Column, summary: Column, bookmarked: Column, published: Column, now: Column) -> Column:
    """Label, kind, length, statistics, collection and date, those that are not blank."""
    estimated = (provider == "youtube") & F.nullif(bookmarked, F.lit(0)).isNull() & F.nullif(published, F.lit(0)).isNotNull()
    old = (provider == "hackernews") & (kind == "story") & F.coalesce(summary, F.lit("")).rlike(OLD_COUNTS)
    counts = F.when(F.coalesce(old, F.lit(False)), F.map_concat(F.map_filter(stats, lambda k, v: k != "info"), F.create_map(F.lit("info"), summary))).otherwise(stats)
    parts = F.array(
        F.coalesce(label, F.lit("")), F.when(kind == "short", "Short").otherwise(""), F.when(F.coalesce(duration, F.lit(0)) > 0, R.duration_text(duration)).otherwise(""),
        F.when(F.coalesce(estimated, F.lit(False)), R.stats_text(counts, hide_age=True)).otherwise(R.stats_text(counts)),
        F.when(provider == "hackernews", "").otherwise(F.coalesce(R.collection_text(collection), F.lit(""))), saved_date(provider, bookmarked, published, now),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " · ")
