"""Markdown notes: scans, front matter, and chunks by headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import slug

LEAST_BYTES = 50
HEADING = re.compile(r"^(#{1,3})\s+(.+?)$", re.MULTILINE)
FENCE = re.compile(r"^```", re.MULTILINE)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, hash) of all *.md files below root, path relative to it. Raises ValueError if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1] + "/"
    text = F.decode("content", "utf-8")
    rows = files.select(F.substring_index("path", base, -1).alias("path"), text.alias("text"), F.sha2("content", 256).alias("hash"))
    if not rows.limit(1).count():
        raise ValueError(f"no Markdown files below {root}")
    return rows


def frontmatter(text: str) -> tuple[dict[str, str], str]:
    """(fields, body): the lines between --- at the text's start and the next ---; without an end there are none."""
    if not text.startswith("---") or (end := text.find("\n---", 3)) < 0:
        return {}, text
    fields = {}
    for line in text[3:end].splitlines():
        name, colon, value = line.partition(":")
        if colon and name.strip():
            fields[name.strip()] = value.strip()
    body = text[end + 4 :]
    return fields, body.removeprefix("\n")


def chunks(body: str, least_bytes: int = LEAST_BYTES) -> list[tuple[str, str]]:
    """(heading line, text) of the parts between headings of levels 1 to 3; headings inside code fences don't count.

    Parts below `least_bytes` bytes are dropped; what stands before the first heading has an empty one.
    """
    fences = [m.start() for m in FENCE.finditer(body)]
    code = list(zip(fences[::2], fences[1::2]))
    heads = [m for m in HEADING.finditer(body) if not any(a <= m.start() < b for a, b in code)]
    bounds = [(0, "", 0), *((m.end(), m[0].strip(), m.start()) for m in heads), (0, "", len(body))]
    parts = [(head, body[start:stop].strip()) for (start, head, _), (_, _, stop) in zip(bounds, bounds[1:])]
    return [(h, t) for h, t in parts if len(t.encode()) >= least_bytes]


PARSED = "title string, fields map<string,string>, body string, slug string, tags array<string>, chunks array<struct<ord:int,header:string,text:string,slug:string>>"


def parsed(files: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """files (path, text, ...) with title, fields, body, slug, tags and chunks."""
    from pyspark.sql.types import StructType

    schema = StructType([*files.schema.fields, *StructType.fromDDL(PARSED).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                fields, body = frontmatter(text or "")
                title = fields.get("title") or path.rsplit("/", 1)[-1].removesuffix(".md")
                own = [{"ord": i, "header": h, "text": t, "slug": slug(t[:80])} for i, (h, t) in enumerate(chunks(body, least_bytes))]
                rows.append((title, fields, body.strip(), slug(title), [t.strip() for t in fields.get("tags", "").split(",") if t.strip()], own))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["title", "fields", "body", "slug", "tags", "chunks"])], axis=1)

    return files.mapInPandas(run, schema)


def notes(files: DataFrame) -> DataFrame:
    """(key, label, type, metadata, content, ...) of parsed files: metadata holds the fields and, above them, path, slug, hash, content."""
    own = F.map_from_arrays(F.array(*map(F.lit, ("path", "slug", "hash", "content"))), F.array("path", "slug", "hash", "body"))
    kept = F.map_filter("fields", lambda k, v: ~k.isin("path", "slug", "hash", "content"))
    return files.select(
        F.concat(F.lit("note:"), "path").alias("key"), F.col("title").alias("label"), F.lit("note").alias("type"),
        F.to_json(F.map_concat(kept, own)).alias("metadata"), "path", "tags", "chunks")


def note_chunks(files: DataFrame) -> DataFrame:
    """(path, ord, header, text, slug): one row for each chunk."""
    return files.select("path", F.explode("chunks").alias("c")).select("path", "c.*")
