"""JSON strings as the text that Python shows for their value, and as canonical JSON.

Most payloads are flat objects of plain strings; built-in functions render them. Only what has escapes, quotes, numbers or nesting, or is
long, goes to a Python worker; of all other rows it gets a null. Canonical JSON is asked for of whole manifests, which may be long: they
go to the worker some hundred at a time, not in Arrow batches of 10,000.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical

#: Characters that JSON and Python show alike, and as themselves, within either kind of quotes.
PLAIN = r"[ !#-&(-\[\]-~]"
_PAIR = rf'"[A-Za-z0-9_]+"\s*+:\s*+"{PLAIN}*+"'
_FLAT = rf"^\s*+\{{\s*+(?:{_PAIR}\s*+(?:,\s*+{_PAIR}\s*+)*+)?\}}\s*+$"
#: Characters of an object that the patterns are tried on at most; a longer one goes to Python.
SHORT = 4000


def is_plain(text: Column) -> Column:
    """Whether a text is shown as itself between quotes; false for null."""
    return F.coalesce(text.rlike(rf"^{PLAIN}*+$"), F.lit(False))


def is_flat(value: Column) -> Column:
    """Whether a JSON text is an object of plain strings with distinct keys, and short; false for null."""
    keys = F.json_object_keys(value)
    return F.coalesce((F.length(value) <= SHORT) & value.rlike(_FLAT) & (F.size(keys) == F.size(F.array_distinct(keys))), F.lit(False))


def flat_repr(value: Column) -> Column:
    """str() of the Python value of a flat object. Quotes stand between parts alone, so what lies between two of them is a part's end."""
    parts = F.regexp_replace(F.regexp_replace(value, r'"\s*:\s*"', "': '"), r'"\s*,\s*"', "', '")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(parts, r'^\s*\{\s*"', "{'"), r'"\s*\}\s*$', "'}"), r"^\s*\{\s*\}\s*$", "{}")


def flat_canonical(value: Column) -> Column:
    """Canonical JSON of a flat object: its pairs in the order of their keys."""
    pairs = F.transform(F.regexp_extract_all(value, F.lit(rf"({_PAIR})"), F.lit(1)), lambda p: F.regexp_replace(p, r'^("[A-Za-z0-9_]+")\s*:\s*', "$1:"))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))


def plain_number(value: Column) -> Column:
    """Whether a double is shown alike by built-in functions and Python, for sure: null, or at most 12 decimals and no exponent."""
    short = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return value.isNull() | F.coalesce(value.cast("string") == short, F.lit(False))


def written_json(value: Column, sure: Column) -> Column:
    """Canonical JSON of a text that to_json() wrote with all keys in their order. Where it is ASCII without control characters, and its
    numbers are `sure` to be shown as Python shows them, it is canonical as it is."""
    sure = F.coalesce(sure & value.rlike(r"^[ -~]*+$") & ~value.contains("\\u"), F.lit(False))
    return F.coalesce(F.when(sure, value), F.udf(canonical, "string", useArrow=False)(F.when(~sure, value)))


def py_repr(value: Column | str) -> Column:
    """str() of the Python value of a JSON text; null or invalid: null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.when(is_flat(value), flat_repr(value)), F.pandas_udf(_py_repr, "string")(F.when(~is_flat(value), value)))


def canonical_json(value: Column | str) -> Column:
    """JSON with sorted keys, no blanks, ASCII only; null or invalid: null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.when(is_flat(value), flat_canonical(value)), F.udf(canonical, "string", useArrow=False)(F.when(~is_flat(value), value)))


def _py_repr(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _or_none(lambda: str(json.loads(v))), na_action="ignore")


def _or_none(f):  # noqa: ANN001, ANN202
    try:
        return f()
    except ValueError:
        return None
