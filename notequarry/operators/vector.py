"""Exact similarity of chunks: top k for a vector, and notes similar to a note."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, literal, norm

#: Source chunks up to this number are sent to every task of the scan; more are joined in blocks of as many.
SOURCE_BLOCK = 256


def topk_chunks(chunks: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(id, note_id, header, text, similarity): the k most similar chunks, by id on ties; none for a zero query."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not length:
        return chunks.select("id", "note_id", "header", "text", F.lit(0.0).alias("similarity")).limit(0)
    unit = literal([float(x) / length for x in query])
    rows = chunks.where(F.size("embedding") > 0).select("id", "note_id", "header", "text", unit_similarity(F.col("embedding"), unit).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "id").limit(k)


def unit_similarity(vector: Column, unit: Column) -> Column:
    from ..functions.vectors import dot

    length = norm(vector)
    return F.when(length > 0, dot(vector, unit) / length).otherwise(0.0)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Scaled to 0 to 1 over all rows; left as it is if all are equal. The extremes come from an aggregation of one row."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    value = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col(column))
    return df.join(F.broadcast(ends)).withColumn(column, value).drop("_low", "_high")


def first_per_note(rows: DataFrame) -> DataFrame:
    """The most similar chunk of each note."""
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("similarity"), "id"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def note_similarities(chunks: DataFrame, sources: list[Sequence[float]], without: int | None = None) -> DataFrame:
    """(note_id, similarity, header, text): of each note the greatest similarity of its chunks to any source vector, at least
    0, and the chunk that has it (empty if none is above 0). One pass over the chunks for every block of sources."""
    rows = chunks.where(F.size("embedding") > 0)
    if without is not None:
        rows = rows.where(F.col("note_id") != without)
    found = None
    for i in range(0, len(sources), SOURCE_BLOCK):
        block = F.array(*(literal(s) for s in sources[i : i + SOURCE_BLOCK]))
        best = F.array_max(F.transform(block, lambda s: cosine(F.col("embedding"), s)))
        part = rows.select("note_id", "id", "header", "text", best.alias("s"))
        found = part if found is None else found.unionByName(part)
    top = F.max_by(F.struct("header", "text"), F.struct("s", -F.col("id")))
    top = found.groupBy("note_id").agg(F.max("s").alias("s"), top.alias("c"))
    shown = F.col("s") > 0
    return top.select("note_id", F.greatest("s", F.lit(0.0)).alias("similarity"), F.when(shown, F.col("c.header")).otherwise("").alias("header"), F.when(shown, F.col("c.text")).otherwise("").alias("text"))


def similar_notes(chunks: DataFrame, sources: list[Sequence[float]], k: int, without: int | None = None) -> DataFrame:
    """The k most similar notes with their scores scaled to 0 to 1; none without a source vector."""
    if not sources:
        return chunks.select("note_id", F.lit(0.0).alias("similarity"), "header", "text", F.lit(0.0).alias("score")).limit(0)
    top = note_similarities(chunks, sources, without).orderBy(F.desc("similarity"), "note_id").limit(k)
    return min_max(top.withColumn("score", F.col("similarity")), "score")


def related_communities(communities: DataFrame, query: Sequence[float], k: int = 2, above: float | None = None) -> DataFrame:
    """(id, label, summary, similarity) of the k nearest communities; those not above a bound go after the cut to k."""
    rows = communities.where(F.col("summary_embedding").isNotNull())
    rows = rows.select("id", "label", F.coalesce("summary", F.lit("")).alias("summary"), cosine(F.col("summary_embedding"), literal(query)).alias("similarity"))
    rows = rows.orderBy(F.desc("similarity"), "id").limit(k)
    return rows if above is None else rows.where(F.col("similarity") > above)
