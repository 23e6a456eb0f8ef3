"""Text expressions of the page parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are decoded, in this order; the ampersand comes last.
NAMED = [("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def trim_all(c: Column) -> Column:
    """Without white space of any script, or byte-order marks, at either end."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def decode_named(c: Column) -> Column:
    for name, char in NAMED:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _decode_numbers(c: Column, pattern: str, base: int) -> Column:
    """Every match replaced by the character of its number, in one pass; a number that is no
    character stays as it is."""

    def char(found: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(found, pattern, 1), "^0+", "")
        n = F.when(F.length(digits).between(1, 7), F.conv(digits, base, 10).cast("long")).when(digits == "", 0)
        whole = ((n < 0xD800) | (n > 0xDFFF)) & (n <= 0x10FFFF)
        return F.when(whole, F.decode(F.unhex(F.lpad(F.hex(F.when(whole, n)), 8, "0")), "UTF-32")).otherwise(found)

    chars = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), char)
    pieces = F.zip_with(F.split(c, pattern, -1), chars, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x, F.lit(""))))
    return F.when(F.contains(c, F.lit("&#")), F.array_join(pieces, "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Numeric entities (hexadecimal, then decimal), then the named ones."""
    return decode_named(_decode_numbers(_decode_numbers(c, r"(?i)&#x([0-9a-f]+);", 16), r"&#(\d+);", 10))


def strip_tags(c: Column) -> Column:
    return trim_all(decode_entities(F.regexp_replace(c, "<[^>]+>", "")))


def or_else(*choices: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def int_after(chunk: Column, pattern: str) -> Column:
    """The number, commas dropped, in the pattern's first group; 0 if there is none."""
    return F.coalesce(F.replace(F.regexp_extract(chunk, pattern, 1), F.lit(","), F.lit("")).try_cast("long"), F.lit(0))


def nearest_image(candidates: Column, target: int = 100) -> Column:
    """url of the candidate (url, width) nearest in width, the first among equals."""
    scored = F.transform(candidates, lambda c, i: F.struct(F.abs(F.coalesce(c["width"], F.lit(0)) - target).alias("d"), i.alias("i"), c["url"].alias("url")))
    return F.coalesce(F.get(F.array_sort(scored), F.lit(0))["url"], F.lit(""))


#: First path segments that are no profiles (fixed values).
NO_PROFILES = ["groups", "watch", "profile.php", "permalink.php", "story.php"]
#: Units of a relative age (fixed values).
AGE = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
#: Short links left at the end of a text (a fixed pattern of the service's own).
LEFT_LINKS = r"(?:\s*https://t\.co/\w+)+$"


def profile_handle(url: Column) -> Column:
    """First path segment of a profile URL on the service's own host, decoded."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    first = F.coalesce(F.get(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != ""), F.lit(0)), F.lit(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(first, F.lit("+"), F.lit("%2B"))), F.lit(""))
    return F.when(host.rlike(r"^(www\.)?facebook\.com$") & ~first.isin(NO_PROFILES), decoded).otherwise("")


def published_estimate(age: Column, fetched: Column) -> Column:
    """Midnight (ms) of the day a relative age points to from ``fetched`` (timestamp); months
    and years overflow into the next month where the day does not exist."""
    n = F.regexp_extract(age, AGE, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(age, AGE, 2))
    day = F.to_date(fetched)
    back = lambda months: F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)
    seconds = F.unix_seconds(fetched) - n * F.when(unit == "second", 1).when(unit == "minute", 60).otherwise(3600)
    found = (
        F.when(unit.isin("second", "minute", "hour"), F.to_date(F.timestamp_seconds(seconds)))
        .when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7))
        .when(unit == "month", back(n)).when(unit == "year", back(n * 12))
    )
    return F.unix_millis(found.cast("timestamp"))


def split_stats(info: Column) -> Column:
    """Views and age (two parts or more), or info (one), of a line parted by dots."""
    parts = F.filter(F.transform(F.split(F.coalesce(info, F.lit("")), "[·•]"), trim_all), lambda p: p != "")
    n = F.size(parts)
    age = F.array_join(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), " · ")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(n >= 2, F.create_map(F.lit("views"), F.get(parts, F.lit(0)), F.lit("age"), age)).when(n == 1, F.create_map(F.lit("info"), F.get(parts, F.lit(0)))).otherwise(none)


def expand_links(text: Column, urls: Column) -> Column:
    """Short links replaced by their targets (url, expanded_url) in order, trailing ones dropped."""
    pairs = F.filter(F.coalesce(urls, F.array().cast("array<struct<url:string,expanded_url:string>>")), lambda u: (F.coalesce(u["url"], F.lit("")) != "") & (F.coalesce(u["expanded_url"], F.lit("")) != ""))
    full = F.aggregate(pairs, text, lambda t, u: F.replace(t, u["url"], u["expanded_url"]))
    return trim_all(F.regexp_replace(full, LEFT_LINKS, ""))
