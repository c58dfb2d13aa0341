"""User-agent rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.functions.text import blank


def _has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


# each fragment holds one of these: a plain search for them spares most agents the pattern, which tries every fragment at every letter
_BOT_PARTS = list(dict.fromkeys("bot" if "bot" in f else f for f in fv.BOT_FRAGMENTS))


def is_bot(ua: Column) -> Column:
    pattern = "(?i)" + "|".join(f.replace(".", "\\.") for f in fv.BOT_FRAGMENTS)
    return blank(ua) | (_has_any(F.lower(ua), _BOT_PARTS) & ua.rlike(pattern))


def bot_reason(ua: Column) -> Column:
    lowered = F.lower(ua)
    out = F.when(blank(ua), F.lit("empty_ua"))
    for reason, words in fv.BOT_REASONS.items():
        out = out.when(_has_any(lowered, words), F.lit(reason))
    return out.otherwise(F.lit("bot"))


def browser_name(ua: Column) -> Column:
    out = F.when(blank(ua), F.lit(""))
    for name, pattern in fv.BROWSER_PATTERNS.items():
        out = out.when(ua.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(""))


def browser_version(ua: Column) -> Column:
    out = F.when(blank(ua), F.lit(""))
    for pattern in fv.BROWSER_PATTERNS.values():
        out = out.when(ua.rlike(pattern), F.regexp_extract(ua, pattern, 1))
    return out.otherwise(F.lit(""))


def os_name(ua: Column) -> Column:
    out = F.when(blank(ua), F.lit(""))
    for name, words in fv.OS_WORDS.items():
        out = out.when(_has_any(ua, words), F.lit(name))
    return out.otherwise(F.lit(""))


def device_type(ua: Column) -> Column:
    """Mobile words are tested before tablet words; everything else is a desktop."""
    return (
        F.when(blank(ua), F.lit(""))
        .when(_has_any(ua, ["Mobile", "iPhone"]), F.lit("Mobile"))
        .when(_has_any(ua, ["iPad", "Android", "Tablet"]), F.lit("Tablet"))
        .otherwise(F.lit("Desktop"))
    )


def normalize_device(name: Column, bot: Column | None = None) -> Column:
    """Report name of a detector's device name."""
    table = F.create_map(*[F.lit(x) for pair in fv.DEVICE_NAMES.items() for x in pair])
    known = F.coalesce(F.try_element_at(table, F.lower(F.coalesce(name, F.lit("")))), F.lit("Other"))
    return F.when(bot, F.lit("Bot")).otherwise(known) if bot is not None else known
