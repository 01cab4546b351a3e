"""Hybrid search: chunk similarity, a re-rank by note, graph expansion, and scores scaled to 0 to 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import string_field
from ..functions.texts import clip_text, words
from .filters import all_of
from .graph import neighbors_of
from .vector import first_per_note, min_max, topk_chunks

TITLE_BONUS, NOTE_BONUS = 0.1, 0.2
SHOWN_NEIGHBORS = 3
RESULT = (
    "id long, label string, type string, score double, content string, file string, "
    "neighbors array<struct<id:long,label:string,type:string,distance:int>>, chunk_header string, chunk_text string"
)


def content_of(metadata: Column) -> Column:
    return F.coalesce(string_field(metadata, "content"), string_field(metadata, "description"), F.lit(""))


def file_of(metadata: Column) -> Column:
    return F.coalesce(string_field(metadata, "path"), F.lit(""))


def previews(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, label, preview) of each node: the text of its first chunk, else the content in its metadata, else nothing."""
    first = chunks.groupBy(F.col("note_id").alias("id")).agg(F.min_by("text", "id").alias("_text"))
    return nodes.join(first, "id", "left").select("id", "label", F.coalesce("_text", content_of(F.col("metadata"))).alias("preview"))


def reranked(nodes: DataFrame, top: DataFrame, query: str, alpha: float, filters: Sequence[str] = ()) -> DataFrame:
    """Candidate notes: the best chunk of each, with score alpha * (similarity + title bonus + note bonus), best first.

    Notes that the filters reject are dropped, not replaced. A chunk whose note is missing is labelled by its id.
    """
    best = first_per_note(top).withColumnRenamed("id", "chunk_id")
    notes = nodes.select(F.col("id").alias("note_id"), "label", "type", "metadata")
    rows = best.join(notes, "note_id", "left").where(all_of(F.col("metadata"), list(filters)))
    label = F.coalesce("label", F.concat(F.lit("note#"), F.col("note_id").cast("string")))
    bonus = F.when(F.arrays_overlap(words(F.lit(query)), words(label)), TITLE_BONUS).otherwise(0.0)
    rows = rows.withColumn("label", label).withColumn("score", alpha * (F.col("similarity") + bonus + NOTE_BONUS))
    return rows.orderBy(F.desc("score"), "note_id")


def hybrid_search(
    nodes: DataFrame, edges: DataFrame, chunks: DataFrame, query: str, vector: Sequence[float], k: int = 5, depth: int = 2, alpha: float = 0.7,
    min_weight: float | None = None, notes_only: bool = False, filters: Sequence[str] = (), prefilter: bool = False,
) -> DataFrame:
    """At most 2k rows of RESULT: candidate notes, and up to three neighbours of each at (1 - alpha) of its score.

    A candidate that was shown as the neighbour of a better one is not shown again, and brings no neighbours of its own.
    With prefilter the filters hold before the top k chunks are taken, else after.
    """
    spark = nodes.sparkSession
    if prefilter and filters:
        allowed = nodes.where(all_of(F.col("metadata"), list(filters))).select(F.col("id").alias("note_id"))
        chunks = chunks.join(allowed, "note_id", "left_semi")
    top = topk_chunks(chunks, vector, k)
    found = reranked(nodes, top, query, alpha, filters).select("note_id", "label", F.coalesce("type", F.lit("note")).alias("type"), "score", "header", "text", file_of(F.col("metadata")).alias("file")).collect()  # k at most
    near: dict[int, list] = {}
    if found and depth > 0:
        starts = spark.createDataFrame([(r["note_id"],) for r in found], "origin long")
        for r in neighbors_of(nodes, edges, starts, depth, min_weight).collect():  # 20 for each candidate at most
            near.setdefault(r["origin"], []).append((r["distance"], r["type"], r["id"], r["label"]))
    shown: set[int] = set()
    rows = []
    for r in found:
        if r["note_id"] in shown:
            continue
        shown.add(r["note_id"])
        own = sorted(near.get(r["note_id"], []))
        listed = [(i, label, kind, d) for d, kind, i, label in own]
        rows.append((r["note_id"], r["label"], r["type"], float(r["score"]), r["text"], r["file"], listed, r["header"], r["text"], True))
        for i, label, kind, _ in listed[:SHOWN_NEIGHBORS]:
            if i not in shown:
                shown.add(i)
                rows.append((i, label, kind, float((1 - alpha) * r["score"]), None, None, [], "", "", False))
    out = spark.createDataFrame(rows, RESULT + ", is_note boolean")
    meta = nodes.select("id", content_of(F.col("metadata")).alias("_content"), file_of(F.col("metadata")).alias("_file"))
    out = out.join(meta, "id", "left")
    content = F.when(F.col("is_note"), clip_text(F.col("content"), 200)).otherwise(F.coalesce("_content", F.lit("")))
    out = out.withColumns({"content": content, "file": F.coalesce("file", "_file", F.lit(""))}).drop("_content", "_file", "is_note")
    out = min_max(out.orderBy(F.desc("score"), "id").limit(2 * k), "score")
    if notes_only:
        out = out.where(F.col("type") == "note")
    return out.orderBy(F.desc("score"), "id")
