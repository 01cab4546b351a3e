"""JSON metadata: string fields, coercions of the kind SQLite makes, and JSON inside model answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(metadata: Column, name: str) -> Column:
    """One top-level field as text; dots and brackets in its name don't nest."""
    return F.get_json_object(metadata, "$['" + name.replace("'", "\\'") + "']")


def string_field(metadata: Column, name: str) -> Column:
    """The same, only if it is a JSON string."""
    value = F.try_variant_get(F.try_parse_json(metadata), "$['" + name + "']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", field(metadata, name))


def real(value: Column) -> Column:
    """A text as SQLite casts it to REAL: the number at its start, else 0; null stays null."""
    start = F.regexp_extract(value, r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(value.isNotNull(), F.coalesce(start.try_cast("double"), F.lit(0.0)))


def json_object(text: Column) -> Column:
    """What lies between the first { and the last }."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def entity_list(text: str) -> list[dict]:
    """The entities in a model's answer: a JSON array, or an object's entities or results, or the first bracketed part."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text.strip())

    def tried(part: str):
        try:
            return json.loads(part)
        except ValueError:
            return None

    got = tried(body)
    if isinstance(got, dict):
        got = next((got[k] for k in ("entities", "results") if isinstance(got.get(k), list)), None)
    if not isinstance(got, list) and (m := re.search(r"\[.*?\]", body, re.DOTALL)):
        got = tried(m[0])
    return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []
