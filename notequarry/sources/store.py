"""Tables as Parquet in versioned folders, and scans of them.

A version is written whole and then named in a `current` file next to it, so that readers see either the old tables or
the new ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INDEX, TABLES, conformed, schema


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: ends the lineage of a loop."""
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], schema(t)) for t in TABLES}


def save(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables and the full-text index as a new version and makes it the current one; edges lie by source for expansion."""
    from ..operators import changes, fts

    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for t in TABLES:
        df = conformed(tables[t], t) if t in tables else spark.createDataFrame([], schema(t))
        (df.repartition("source_id").sortWithinPartitions("source_id") if t == "edges" else df).write.parquet(f"{root}/{version}/{t}")
    # From the nodes just written: what stands in the index is what stands in the table.
    nodes = spark.read.schema(schema("nodes")).parquet(f"{root}/{version}/nodes")
    fts.indexed(changes.searchable(nodes)).write.parquet(f"{root}/{version}/fts")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return version


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version, and as `fts` its full-text index."""
    version = spark.read.text(f"{root}/current").first()[0]
    tables = {t: spark.read.schema(schema(t)).parquet(f"{root}/{version}/{t}") for t in TABLES}
    return tables | {"fts": spark.read.schema(INDEX).parquet(f"{root}/{version}/fts")}


def reset(spark: SparkSession, root: str) -> None:
    save(empty(spark), root)


def import_sqlite(spark: SparkSession, path: str, rows: int = 10_000) -> dict[str, DataFrame]:
    """Tables of a small single-file store, read in the driver; vectors are blobs of 32-bit floats there."""
    import sqlite3

    from ..functions.vectors import from_blob

    out = {}
    with sqlite3.connect(path) as db:
        for t in TABLES:
            cursor = db.execute(f"select * from {t}")
            names, parts = [c[0] for c in cursor.description], []
            kinds = {f.name: ("binary" if "embedding" in f.name else "string" if f.name in ("member_ids", "created_at") else f.dataType.simpleString()) for f in schema(t).fields}
            ddl = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
            while block := cursor.fetchmany(rows):
                parts.append(spark.createDataFrame(block, ddl))
            df = spark.createDataFrame([], ddl)
            for p in parts:
                df = df.unionByName(p)
            for n in names:
                if "embedding" in n:
                    df = df.withColumn(n, from_blob(n))
                elif n == "member_ids":
                    df = df.withColumn(n, F.coalesce(F.from_json(n, "array<long>"), F.array().cast("array<long>")))
            out[t] = conformed(df, t)
    return out


def embedded_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector."""
    return chunks.where(F.size("embedding") > 0)


def chunks_of(chunks: DataFrame, note_id: int) -> DataFrame:
    return chunks.where(F.col("note_id") == note_id).orderBy("id")


def communities(found: DataFrame, id: int | None = None, level: int | None = None) -> DataFrame:
    if id is not None:
        found = found.where(F.col("id") == id)
    return (found if level is None else found.where(F.col("level") == level)).orderBy("id")


def embedded_communities(found: DataFrame) -> DataFrame:
    return found.where(F.col("summary_embedding").isNotNull()).select("id", "summary_embedding", "label", F.coalesce("summary", F.lit("")).alias("summary"))


def is_entity(type: Column) -> Column:
    return ~type.isin("note", "tag", "root", "system")


def node_listing(nodes: DataFrame, type: str | None = None) -> DataFrame:
    """All nodes, those of a type, or with type `entity` all that are neither notes, tags nor sentinels."""
    if type == "entity":
        nodes = nodes.where(is_entity(F.col("type")))
    elif type:
        nodes = nodes.where(F.col("type") == type)
    return nodes.select("id", "key", "label", "type")


def edge_listing(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """Edges with their ends' labels, the first by id."""
    ends = nodes.select("id", "label")
    rows = edges.orderBy("id").limit(limit)
    rows = rows.join(ends.select(F.col("id").alias("source_id"), F.col("label").alias("source")), "source_id")
    rows = rows.join(ends.select(F.col("id").alias("target_id"), F.col("label").alias("target")), "target_id")
    return rows.select("id", "source", "target", "type", "weight", "context")


def db_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: nodes, notes, entities, tags, edges, with_embeddings, chunks."""
    kind = F.col("type")
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(kind == "note").alias("notes"), F.count_if(~kind.isin("note", "tag")).alias("entities"), F.count_if(kind == "tag").alias("tags"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = chunks.agg(F.count_if(F.size("embedding") > 0).alias("with_embeddings"), F.count(F.lit(1)).alias("chunks"))
    return a.join(b).join(c)
