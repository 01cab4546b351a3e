"""What an ingest does to stored tables: differences, upserts, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import string_field
from ..schema import SENTINELS


def stored_hashes(nodes: DataFrame) -> DataFrame:
    """(path, hash, id) of notes whose metadata has both as strings."""
    meta = F.col("metadata")
    rows = nodes.where(F.col("type") == "note").select(string_field(meta, "path").alias("path"), string_field(meta, "hash").alias("hash"), "id")
    return rows.where("path is not null and hash is not null")


def changed(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that aren't stored with their present hash."""
    return files.join(stored_hashes(nodes).select("path", "hash"), ["path", "hash"], "left_anti")


def next_ids(rows: DataFrame, order: str, after: int) -> DataFrame:
    """rows with ids above `after`, by an order; numbered within ranges of it, and the ranges' sizes summed up."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    from ..sources.store import cut

    ranged = cut(ranged, "numbered")
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each task
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_n", number).join(F.broadcast(before), "_part").withColumn("id", F.col("_n") + F.col("_before") + after).drop("_part", "_n", "_before")


def upserted(nodes: DataFrame, fresh: DataFrame, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """nodes with those of fresh (key, label, type, metadata, embedding) put in by key.

    New values win where they are not null, but for columns in keep_first, where stored ones do. New keys get new ids.
    """
    columns = ("label", "type", "metadata", "embedding")
    both = nodes.alias("o").join(fresh.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    picked = [(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_first else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in columns]
    rows = both.select(F.col("o.id").alias("id"), F.coalesce("o.key", "n.key").alias("key"), *picked, F.coalesce(F.col("o.created_at"), F.current_timestamp()).alias("created_at"))
    last = nodes.agg(F.max("id")).first()[0] or 0
    added = next_ids(rows.where("id is null").drop("id"), "key", last)
    return rows.where("id is not null").unionByName(added.select(rows.columns))


def with_ids(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (source, target: keys, ...) with source_id and target_id; those with an end that is no node go."""
    key = nodes.select("key", "id")
    rows = links.join(key.select(F.col("key").alias("source"), F.col("id").alias("source_id")), "source")
    return rows.join(key.select(F.col("key").alias("target"), F.col("id").alias("target_id")), "target")


def without_edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(edges.columns)


def stale_notes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Notes whose file is gone, or that have no path; those with broken metadata are kept."""
    meta = F.col("metadata")
    notes = nodes.where((F.col("type") == "note") & (F.col("metadata").isNull() | F.try_parse_json(meta).isNotNull()))
    return notes.withColumn("path", string_field(meta, "path")).join(paths.select("path"), "path", "left_anti").select(nodes.columns)


def pruned(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without stale notes, their edges and their chunks."""
    ids = stale.select("id")
    return (
        nodes.join(ids, "id", "left_anti").select(nodes.columns),
        without_edges_of(edges, ids),
        chunks.join(ids.select(F.col("id").alias("note_id")), "note_id", "left_anti").select(chunks.columns),
    )


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes without those that no edge touches; notes and sentinels stay."""
    touched = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    lone = nodes.where(~F.col("type").isin("note", *SENTINELS)).join(touched, "id", "left_anti").select("id")
    return nodes.join(lone, "id", "left_anti").select(nodes.columns)


def searchable(nodes: DataFrame) -> DataFrame:
    """(id, title, content) of nodes whose metadata has content: what full-text search is over."""
    rows = nodes.select("id", F.col("label").alias("title"), string_field(F.col("metadata"), "content").alias("content"))
    return rows.where("content is not null and content != ''")
