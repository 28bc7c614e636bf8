"""Text expressions on Columns; all of them run inside the JVM."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def tokens(text: Column) -> Column:
    """Words between any white space; no empty ones."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a normalised tag, hyphens taken as blanks."""
    return tokens(F.replace(text, F.lit("-"), F.lit(" ")))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, needles) -> Column:
    """Whether any of a list of fixed strings occurs in the text; one expression, no join."""
    if len(needles) <= 3:
        return any_of(F.contains(text, F.lit(n)) for n in needles)
    return bound(text, lambda t: F.exists(strings(needles), lambda n: F.contains(t, n)))


def constant(value, kind: str) -> Column:
    """A constant of any type. It is folded to one literal when the plan is made, where
    nested constructors would be thousands of nodes for the analyser to walk."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def strings(values) -> Column:
    """A constant array of strings."""
    return constant(list(values), "array<string>")


def one_of(text: Column, values) -> Column:
    return text.isin(*values)


def or_empty(array: Column, kind: str = "string") -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def bound(value: Column, use) -> Column:
    """``use`` applied to a value that is worked out once, not at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_ignoring_case(values: Column) -> Column:
    """First of each value ignoring case, in order. Quadratic in the list, so for lists as
    short as tag lists; nulls are dropped."""
    compact = F.array_compact(values)

    def first_of_its_case(s: Column) -> Column:
        lowered = F.transform(s, F.lower)
        return bound(lowered, lambda low: F.filter(s, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1))

    return bound(compact, first_of_its_case)


def url_encoded(text: Column, blank: str = "+") -> Column:
    """Percent-encoding with blanks as ``+`` or ``%20``; ``~`` stays."""
    encoded = F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return encoded if blank == "+" else F.replace(encoded, F.lit("+"), F.lit(blank))


def url_decoded(text: Column) -> Column:
    """Percent-decoding that leaves stray percent signs alone and keeps ``+``."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def quotes_escaped(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)
