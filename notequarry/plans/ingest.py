"""An ingest: Markdown files into the tables, only those that changed.

scan -> files without their present hash -> parse, extract, embed -> merge with what is stored -> prune -> save. The new
version of all tables is written whole and then made the current one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import embed_text, node_key
from ..operators import changes, entities
from ..plugins import Embedder, Extractor, GazetteerExtractor, HashingEmbedder
from ..schema import conformed
from ..sources import markdown, store


@dataclass(frozen=True)
class BuildStats:
    files: int
    entities: int
    total_nodes: int
    total_edges: int


def merged(tables: dict[str, DataFrame], files: DataFrame, present: DataFrame, root_name: str, extractor: Extractor, embedder: Embedder) -> tuple[dict[str, DataFrame], BuildStats]:
    """The tables after an ingest of files (path, text, hash); present: paths that exist now, whether changed or not."""
    nodes, edges, chunks = (tables[t] for t in ("nodes", "edges", "chunks"))
    todo = store.cut(markdown.parsed(changes.changed(files, nodes)), "parsed")
    notes = markdown.notes(todo)
    parts = entities.extract(markdown.note_chunks(todo), extractor)
    parts = store.cut(entities.embed(parts, embed_text(F.col("header"), F.col("text")), embedder), "chunks")
    links = entities.mentions(parts).unionByName(entities.co_occurrences(parts)).unionByName(entities.memberships(notes, root_name)).unionByName(entities.taggings(notes))
    links = store.cut(links, "new-edges")
    vector, meta = F.lit(None).cast("array<float>"), F.lit(None).cast("string")
    found = parts.select(F.explode("entities").alias("e"))
    found = found.groupBy("e.label").agg(F.max_by(F.col("e.type"), F.col("e.score")).alias("type")).select(node_key(F.col("label")).alias("key"), "label", "type", meta.alias("metadata"), vector.alias("embedding"))
    groups = links.where(F.col("type").isin("belongs_to", "tagged_with")).select(F.col("target").alias("key")).distinct()
    groups = groups.select("key", F.expr("substring(key, 6)").alias("label"), F.lit("tag").alias("type"), meta.alias("metadata"), vector.alias("embedding"))
    fresh_notes = notes.select("key", "label", "type", "metadata", vector.alias("embedding"))
    # What a changed note had before goes: its edges, the co-occurrences of its chunks, its chunks.
    old = nodes.join(fresh_notes.select("key"), "key", "left_semi").select("id")
    stale_context = todo.select("path")
    edges = changes.without_edges_of(edges, old)
    edges = edges.withColumn("_path", F.regexp_extract("context", r"(?s)^(.*?\.md)#", 1)).join(stale_context.withColumnRenamed("path", "_path"), "_path", "left_anti").drop("_path")
    chunks = chunks.join(old.select(F.col("id").alias("note_id")), "note_id", "left_anti").select(chunks.columns)
    nodes = store.cut(changes.upserted(nodes, fresh_notes), "nodes")
    nodes = store.cut(changes.upserted(nodes, found, ("label", "type")), "nodes")
    nodes = store.cut(changes.upserted(nodes, groups, ("label", "type")), "nodes")
    key = nodes.select("key", "id")
    added = changes.with_ids(links, key)
    edges = edges.unionByName(conformed(changes.next_ids(added.drop("source", "target"), "source_id", edges.agg(F.max("id")).first()[0] or 0), "edges"))
    new = parts.join(key.select(F.expr("substring(key, 6)").alias("path"), F.col("id").alias("note_id")).where("path is not null"), "path")
    new = changes.next_ids(new.select("note_id", "header", "text", "slug", "embedding", "ord"), "note_id", chunks.agg(F.max("id")).first()[0] or 0)
    chunks = chunks.unionByName(conformed(new, "chunks"))
    nodes, edges, chunks = changes.pruned(nodes, store.cut(edges, "edges"), chunks, changes.stale_notes(nodes, present))
    nodes = changes.without_orphans(nodes, edges)
    out = {t: store.cut(df, t) for t, df in (("nodes", nodes), ("edges", edges), ("chunks", chunks))}
    stats = BuildStats(todo.count(), found.count(), out["nodes"].count(), out["edges"].count())
    return {t: df for t, df in tables.items() if t != "fts"} | out, stats


def build(spark: SparkSession, source: str, root: str, extractor: Extractor = GazetteerExtractor(), embedder: Embedder = HashingEmbedder()) -> BuildStats:
    """Brings the tables under root up to date with the Markdown files below source."""
    files = store.cut(markdown.scan(spark, source), "files")
    try:
        tables = store.load(spark, root)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        tables = store.empty(spark)
    tables, stats = merged(tables, files, files.select("path"), source.rstrip("/").rsplit("/", 1)[-1], extractor, embedder)
    store.save(tables, root)
    return stats
