"""Column helpers: lax casts, strict timestamps, time differences, code normalisation, lists of flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_code(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """Null, or nothing but white space of any kind."""
    return F.coalesce(~col(c).rlike(r"\S"), F.lit(True))


def match_key(c: Column | str) -> Column:
    """Lower case, white space collapsed: how cargo types are matched."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def lax_double(c: Column | str) -> Column:
    """The number that a text is, inf and nan among them, or null; Spark's own suffixes (1.5d) are no numbers."""
    text = F.trim(col(c))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def lax_int(c: Column | str) -> Column:
    """A text's number rounded half away from zero, or null if it is none or too large."""
    return F.round(lax_double(c)).try_cast("int")


def strict_timestamp(c: Column | str) -> Column:
    """A text of the form y-m-d h:m:s as a timestamp without time zone, or null; fields may be unpadded."""
    text, rest = F.trim(col(c)), "-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\\z"
    by_pattern = F.try_to_timestamp(text, F.lit("y-M-d H:m:s")).cast("timestamp_ntz")  # slow, and only needed for years that a cast reads in another way
    return F.when(text.rlike(f"^[1-9][0-9]{{3}}{rest}"), text.try_cast("timestamp_ntz")).when(text.rlike(f"^[0-9]{{1,4}}{rest}"), by_pattern)


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Minute boundaries from a to b: seconds don't count."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", col(a)), F.date_trunc("minute", col(b)))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Seconds from a to b with their fraction, as a double."""
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / F.lit(1e6)


def flags(*pairs: tuple[Column, str] | Column) -> Column:
    """The names whose conditions hold, in this order; a Column in place of a pair gives its own name or null."""
    return F.array_compact(F.array(*(F.when(p[0], F.lit(p[1])) if isinstance(p, tuple) else p for p in pairs)))


def first_match(*pairs: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, or null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in pairs))


def mapped(c: Column | str, values: dict[str, str]) -> Column:
    """The value of a key in a small fixed list, null without one; the key is computed once and no join is needed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), col(c))


def content_key(*columns: str) -> Column:
    """128 bits of the SHA-256 of texts, each with its length before it, so that no two lists of texts read alike; null is none of them."""
    each = (F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns)
    return F.substring(F.unhex(F.sha2(F.concat(*each), 256)), 1, 16)


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
