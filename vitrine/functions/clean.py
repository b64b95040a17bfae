"""Cleaning of raw values as column expressions; a row-level problem becomes null or a reject reason, never an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in a class that Java and RE2 read alike.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# fixed values: texts that stand for no value, compared in lower case
SENTINELS = ["", "none", "null", "nan", "n/a"]
# fixed values: event types of the reference contract
EVENT_TYPES = ["view", "click", "add_to_cart", "purchase", "review"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_string(c: Column) -> Column:
    """Stripped text; null for null, blank and sentinel texts."""
    s = strip(c)
    return F.when(~F.lower(s).isin(SENTINELS), s)


def clean_list(c: Column) -> Column:
    """Array of cleaned texts without nulls; null gives the empty array."""
    return F.coalesce(F.filter(F.transform(c, clean_string), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def join_text(*parts: Column) -> Column:
    """Non-blank parts joined by spaces, null if there is none."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(strip(p), F.lit("")) for p in parts]), F.lit(""))


def json_map(c: Column) -> Column:
    """A JSON object as map of texts; anything else gives the empty map."""
    return F.coalesce(F.from_json(F.when(strip(c).startswith("{"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse_price(c: Column) -> Column:
    """A price text without $ and thousands commas as double; null if it is no number. Texts for nothing, among them "nan", have none, and
    what a cast takes besides ("5d", "0x1p3") is no number here."""
    text = F.trim(F.regexp_replace(clean_string(c.cast("string")), r"[$,]", ""))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def parse_rating(c: Column) -> Column:
    """A rating from 1 to 5; null otherwise."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & x.between(1, 5), x)


def parse_epoch(c: Column) -> Column:
    """Epoch seconds or, from 1e11 on, milliseconds as timestamp; null if not positive or no number."""
    x = c.try_cast("double")
    us = F.when(x >= 1e11, x * 1000).otherwise(x * 1_000_000)
    return F.when((x > 0) & ~F.isnan(x), F.timestamp_micros(us.cast("bigint")))


def truthy(c: Column) -> Column:
    """Text booleans: true, 1, yes."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def first_other(items: Column, main: Column) -> Column:
    """The first item that differs from ``main``, else the first item."""
    return F.coalesce(F.get(F.filter(items, lambda x: ~x.eqNullSafe(main)), F.lit(0)), F.get(items, F.lit(0)))


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c).otherwise(F.lit(0.0))


def present(c: Column) -> Column:
    """Neither null, blank nor sentinel."""
    return clean_string(c.cast("string")).isNotNull()


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that a row breaks, null if none."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def clip(c: Column, n: int) -> Column:
    return F.rtrim(F.substring(collapse(c), 1, n))


def searchable_text(*fields: Column, limit: int = 4000) -> Column:
    """Fields in order, white space collapsed, clipped, joined by line breaks without the empty ones."""
    return F.concat_ws("\n", *[F.nullif(clip(f, limit), F.lit("")) for f in fields])


def labelled_text(**fields: Column) -> Column:
    """'Label: value' lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.capitalize()}: "), F.nullif(collapse(v), F.lit(""))) for k, v in fields.items()])


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
