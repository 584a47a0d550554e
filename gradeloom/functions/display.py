"""How values are shown: durations, moments, texts cut to a width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of characters that take two columns, and of those that take none.
WIDE = r"[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
NARROW = r"[̀-ͯ​-‏︀-️]"


def width_of(char: Column) -> Column:
    return F.when(char.rlike(WIDE), 2).when(char.rlike(NARROW), 0).otherwise(F.char_length(char))


def display_width(text: Column) -> Column:
    """Columns that a text takes: wide characters two, combining ones none."""
    return F.char_length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(NARROW))


def shortened(text: Column, most: int) -> Column:
    """The text within `most` columns; one that is cut ends in '…'."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("width"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        w = acc["width"] + width_of(c)
        fits = acc["open"] & (w <= max(most - 1, 0))
        return F.struct(F.when(fits, F.concat(acc["text"], c)).otherwise(acc["text"]).alias("text"), F.when(fits, w).otherwise(acc["width"]).alias("width"), fits.alias("open"))

    cut = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda acc: acc["text"])
    return F.when(display_width(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def duration_text(ms: Column) -> Column:
    """'250ms', '2.5s' or '3m 7s'."""
    whole = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
    )


def moment_text(seconds: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' of epoch seconds in UTC, whatever the session's zone."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", seconds, start), "yyyy-MM-dd HH:mm:ss")


def two_places(x: Column) -> Column:
    """Rounded half away from zero."""
    return F.round(x, 2)
