"""Results as a table, as a list of links, or as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(results: DataFrame) -> DataFrame:
    """(line): a Markdown link for each note that has a file."""
    rows = results.where((F.col("type") == "note") & (F.coalesce("file", F.lit("")) != ""))
    return rows.select(F.concat(F.lit("- ["), F.col("label"), F.lit("]("), F.col("file"), F.lit(")")).alias("line"))


def rendered(results: DataFrame, form: str = "table") -> str:
    """form: table, list or json."""
    if form == "list":
        return "\n".join(r["line"] for r in links(results).collect())
    rows = [json.loads(x) for x in results.toJSON().collect()]
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    if form != "table":
        raise ValueError(f"no such form: {form}")
    head = ["score", "type", "label", "content"]
    cells = [[f"{r.get('score') or 0:.3f}", r.get("type") or "", r.get("label") or "", (r.get("content") or "").replace("\n", " ")[:60]] for r in rows]
    widths = [max(len(x) for x in column) for column in zip(head, *cells)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in [head, ["-" * w for w in widths], *cells])
