"""Table schemas of a knowledge base, and the migration of tables without keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.jsons import string_field

NODES = "id long, key string, label string, type string, embedding array<float>, metadata string, created_at timestamp"
EDGES = "id long, source_id long, target_id long, type string, weight double, context string"
CHUNKS = "id long, note_id long, header string, text string, slug string, embedding array<float>, metadata string"
COMMUNITIES = (
    "id long, label string, level int, parent_id long, summary string, summary_embedding array<float>, member_ids array<long>, "
    "member_count long, algorithm string, quality_fn string, resolution double, summary_model string, embed_model string, "
    "summary_tokens long, keywords array<string>, topics array<string>, created_at timestamp"
)
INDEX = "id long, title string, content string, length int"
TABLES = {"nodes": NODES, "edges": EDGES, "chunks": CHUNKS, "communities": COMMUNITIES}
SENTINELS = ("root", "system")


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order: missing ones are null, others are dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def with_keys(nodes: DataFrame) -> DataFrame:
    """Gives keys to nodes that have none: notes by their path, or as legacy ones by id; all others by label.

    Raises ValueError if two nodes would share a key.
    """
    path = string_field(F.col("metadata"), "path")
    note = F.concat(F.lit("note:"), F.coalesce(path, F.concat(F.lit("legacy:"), F.col("id").cast("string"))))
    key = F.when(F.col("type") == "note", note).otherwise(F.concat(F.lit("node:"), F.col("label")))
    out = nodes.withColumn("key", F.coalesce(F.col("key"), key) if "key" in nodes.columns else key)
    if twice := out.groupBy("key").count().where("count > 1").limit(1).collect():
        raise ValueError(f"more than one node would have the key {twice[0]['key']}")
    return out
