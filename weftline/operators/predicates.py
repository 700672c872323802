"""Predicates from plain dictionaries, null-safe where the data model asks for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(field: str | Column, rules: dict) -> Column:
    """All of: not_null, not_equal (value or list; null counts as different), equals, in, not_in, min_length, max_length (null has
    length 0), contains, regex."""
    c = F.col(field) if isinstance(field, str) else field
    text = c.cast("string")
    made = []
    for name, value in rules.items():
        if name == "not_null":
            made += [c.isNotNull()] if value else []
        elif name in ("not_equal", "not_in"):
            values = value if isinstance(value, (list, tuple, set)) else [value]
            made += [~c.eqNullSafe(F.lit(v)) for v in values]
        elif name == "equals":
            made.append(c.eqNullSafe(F.lit(value)))
        elif name == "in":
            made.append(F.coalesce(c.isin(*value), F.lit(False)))
        elif name == "min_length":
            made.append(F.length(F.coalesce(text, F.lit(""))) >= value)
        elif name == "max_length":
            made.append(F.length(F.coalesce(text, F.lit(""))) <= value)
        elif name == "contains":
            made.append(F.coalesce(F.contains(text, F.lit(value)), F.lit(False)))
        elif name == "regex":
            made.append(F.coalesce(text.rlike(value), F.lit(False)))
        else:
            raise ValueError(f"unknown filter {name!r} on {field}")
    return reduce(lambda a, b: a & b, made, F.lit(True))


def apply_filters(df: DataFrame, filters: dict[str, dict] | None) -> DataFrame:
    """df where every field's rules hold; nested fields by dotted name."""
    for field, rules in (filters or {}).items():
        df = df.where(predicate(field, rules))
    return df


#: Functions that a computed field may use, when it is given as text.
ALLOWED = {"abs", "ceil", "coalesce", "concat", "concat_ws", "floor", "left", "length", "lower", "lpad", "md5", "regexp_replace", "right", "round", "rpad", "soundex", "split_part", "substring", "trim", "upper", "year", "month", "cast", "int", "string", "as"}


def computed(expression: str | Column) -> Column:
    """A computed field: a Column, or a SQL expression of column names, literals and allowed functions."""
    if isinstance(expression, Column):
        return expression
    import re

    bare = re.sub(r"'[^']*'", "", expression)
    if ";" in bare or "--" in bare or "/*" in bare or re.search(r"\b(select|from|where|with|union|insert|drop)\b", bare, re.I):
        raise ValueError("a computed field is an expression, not a statement")
    unknown = {f.lower() for f in re.findall(r"([A-Za-z_]\w*)\s*\(", bare)} - ALLOWED
    if unknown:
        raise ValueError(f"functions not allowed in a computed field: {sorted(unknown)}")
    return F.expr(expression)
