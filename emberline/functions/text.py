"""Text predicates and parsers for posts and news records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default keywords of weak activation, theme substrings of the news filter,
# names tested by the four theme flags, and the form of a region code.
WEAK_KEYWORDS = ["global warming", "climate change"]
NEWS_THEMES = ["mitigation", "environment", "climate", "env_", "natural_disaster"]
STRIKE_TOKEN = "STRIKE"
FLAG_SUBSTRINGS = {
    "is_climate_action": "UNGP_CLIMATE_CHANGE_ACTION",
    "is_climate": "CLIMATE",
    "is_natural_disaster": "NATURAL_DISASTER",
}
REGION_CODE = r"^(US\w\w|CA\d\d)$"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive test for any of a few literal words; null text is false."""
    low = F.lower(text)
    hit = reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])
    return F.coalesce(hit, F.lit(False))


def has_token(text: Column, token: str, separators: str = "[;,]") -> Column:
    """Exact token test after splitting on a regular expression."""
    return F.array_contains(F.split(text, separators), token)


def theme_flags(
    themes: Column,
    strike: str = STRIKE_TOKEN,
    substrings: dict[str, str] | None = None,
    separators: str = "[;,]",
) -> dict[str, Column]:
    """``is_strike`` needs an exact token; the other flags are case-sensitive substrings."""
    flags = {"is_strike": has_token(themes, strike, separators)}
    for name, word in (substrings or FLAG_SUBSTRINGS).items():
        flags[name] = themes.contains(word)
    return flags


def extract_regions(locations: Column) -> Column:
    """Distinct (country, admin1code) structs named in a ``;``/``#`` delimited location text."""
    codes = F.array_distinct(
        F.filter(F.split(locations, "[;#]"), lambda x: x.rlike(REGION_CODE))
    )
    return F.transform(
        F.coalesce(codes, F.array().cast("array<string>")),
        lambda x: F.struct(
            F.substring(x, 1, 2).alias("country"), F.substring(x, 3, 2).alias("admin1code")
        ),
    )


def strip_type_prefix(key: Column) -> Column:
    """Drop the three-character kind prefix of an item key."""
    return F.substring(key, 4, 2**31 - 1)


def parse_json(text: Column, schema: T.StructType | str) -> Column:
    """Typed struct out of JSON text; a malformed line gives a struct of nulls."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def parse_population(text: Column) -> Column:
    """Whole number written with ``.`` or ``,`` as thousands separators."""
    return F.regexp_replace(F.trim(text), "[.,]", "").try_cast("long")
