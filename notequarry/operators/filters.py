"""Predicates on JSON metadata: `field op value`."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsons import field, real

#: Fixed value: the form of a predicate.
FORM = re.compile(r"^(\w[.\w]*)\s*(=|!=|>=|<=|>|<)\s*(.+)$")


@dataclass(frozen=True)
class Predicate:
    field: str
    operator: str
    value: str


def parse(text: str) -> Predicate:
    if not (m := FORM.match(text.strip())):
        raise ValueError(f"not a filter: {text!r}; write: field operator value, with one of = != >= <= > <")
    return Predicate(m[1], m[2], m[3].strip())


def is_number(text: str) -> bool:
    """What reads as a float, infinities and NaN included; no digits grouped by underscores."""
    try:
        return "_" not in text and (math.isfinite(float(text)) or True)
    except ValueError:
        return False


def compared(a: Column, operator: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[operator]


def condition(metadata: Column, p: Predicate) -> Column:
    """Numeric if the value is a number: both sides as numbers. Else as text, where a stored number is below any text.

    A missing field is never selected.
    """
    value = field(metadata, p.field)
    if is_number(p.value):
        return F.coalesce(compared(real(value), p.operator, real(F.lit(p.value))), F.lit(False))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), "$['" + p.field + "']", "variant"))
    number = F.coalesce(~kind.isin("STRING") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.lit(False))
    below = F.lit(p.operator in ("!=", "<", "<="))
    return F.coalesce(F.when(value.isNull(), False).when(number, below).otherwise(compared(value, p.operator, F.lit(p.value))), F.lit(False))


def all_of(metadata: Column, filters: list[str | Predicate]) -> Column:
    found = [condition(metadata, parse(f) if isinstance(f, str) else f) for f in filters]
    return reduce(lambda a, b: a & b, found, F.lit(True))
