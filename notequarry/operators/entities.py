"""Entities of chunks and the edges that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.texts import chunk_ref, directory, node_key, note_key
from ..plugins import Embedder, Extractor, cleaned, retried

ENTITY = "array<struct<id:string,label:string,type:string,score:double>>"


def extract(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """chunks with entities: an array of (id, label, type, score) in the order of extraction."""

    @F.pandas_udf(ENTITY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = retried(lambda: extractor.extract(list(texts)))
            yield pd.Series([cleaned(f) for f in found], dtype=object)

    return chunks.withColumn("entities", run("text"))


def vectors(embedder: Embedder, texts: list[str | None]) -> list[np.ndarray | None]:
    """A vector of each text. Texts that fail together are tried again by halves, so that only those that fail alone have none; so have nulls."""
    out: list[np.ndarray | None] = [None] * len(texts)

    def once(at: list[int]) -> None:
        for i, v in zip(at, np.asarray(embedder.embed([texts[i] for i in at]), dtype=np.float32), strict=True):
            out[i] = v

    def halved(at: list[int], attempts: int) -> None:
        try:
            retried(lambda: once(at), attempts)
        except Exception:  # noqa: BLE001  rows stay, without vectors
            for i in at:
                out[i] = None
            if len(at) > 1:
                halved(at[: len(at) // 2], 1)
                halved(at[len(at) // 2 :], 1)

    if known := [i for i, t in enumerate(texts) if t is not None]:
        halved(known, 3)
    return out


#: Fixed value: the texts that an embedder gets at once, and the vectors that a batch holds.
TEXTS_AT_ONCE = 256


def embed(rows: DataFrame, text: Column, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """rows with a vector of a text; a text that fails three times has none, nor has a null."""
    kept = [f for f in rows.schema.fields if f.name != column]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                part = whole.slice(at, TEXTS_AT_ONCE)
                found = pa.array(vectors(embedder, part.column(len(names)).to_pylist()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], found], names=[*names, column])

    put = StructType([*kept, StructField(column, ArrayType(FloatType()))])
    return rows.select(*(F.col(f"`{n}`") for n in names), text.alias("_text")).mapInArrow(run, put)


def raw_entities(found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Cleaned entities of rows (keys..., ord, label, type, score): see plugins.cleaned()."""
    rows = found.withColumns({"label": F.trim("label"), "type": F.coalesce("type", F.lit("concept")), "score": F.coalesce("score", F.lit(0.5))})
    rows = rows.where((F.col("score") >= least) & (F.col("label") != ""))
    first = F.row_number().over(Window.partitionBy(*keys, F.lower("label")).orderBy("ord"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def by_section(found: DataFrame, keys: list[str], sections: Column) -> DataFrame:
    """Entities of a batch by section: numbers from 1 become 0-based, missing ones 0; those out of range are dropped."""
    rows = found.withColumn("section", F.coalesce(F.col("section") - 1, F.lit(0))).where((F.col("section") >= 0) & (F.col("section") < sections))
    listed = F.sort_array(F.collect_list(F.struct("ord", "label", "type", "score")))
    return rows.groupBy(*keys, "section").agg(F.transform(listed, lambda e: e["label"]).alias("labels"))


def mentions(chunks: DataFrame) -> DataFrame:
    """(source, target, type, weight, context) by key: each entity of a chunk is mentioned in the chunk's note."""
    rows = chunks.select("path", "header", F.explode("entities").alias("e"))
    return rows.select(node_key(F.col("e.label")).alias("source"), note_key(F.col("path")).alias("target"), F.lit("mentioned_in").alias("type"), F.col("e.score").alias("weight"), chunk_ref(F.col("path"), F.col("header")).alias("context"))


def co_occurrences(chunks: DataFrame) -> DataFrame:
    """Pairs of entities of one chunk, in the order of extraction; the weight is the lesser score. Chunks hold few entities."""
    rows = chunks.select("path", "header", "entities", F.posexplode("entities").alias("i", "a"))
    rows = rows.select("path", "header", "a", F.explode(F.slice("entities", F.col("i") + 2, F.greatest(F.size("entities") - F.col("i") - 1, F.lit(0)))).alias("b")).where("a.id != b.id")
    return rows.select(node_key(F.col("a.label")).alias("source"), node_key(F.col("b.label")).alias("target"), F.lit("co_occurs_with").alias("type"), F.least("a.score", "b.score").alias("weight"), chunk_ref(F.col("path"), F.col("header")).alias("context"))


def memberships(notes: DataFrame, root: str) -> DataFrame:
    """Each note belongs to its folder."""
    rows = notes.select("path", directory(F.col("path"), root).alias("d")).where("d is not null")
    return rows.select(note_key(F.col("path")).alias("source"), node_key(F.col("d")).alias("target"), F.lit("belongs_to").alias("type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("context"))


def taggings(notes: DataFrame) -> DataFrame:
    rows = notes.select("path", F.explode("tags").alias("t"))
    return rows.select(note_key(F.col("path")).alias("source"), node_key(F.col("t")).alias("target"), F.lit("tagged_with").alias("type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("context"))
