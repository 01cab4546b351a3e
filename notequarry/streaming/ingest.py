"""Files that arrive in a folder, ingested by micro-batches: the same merge as a build, without pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsons import string_field
from ..plans.ingest import merged
from ..plugins import Embedder, Extractor, GazetteerExtractor, HashingEmbedder
from ..sources import store

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, source: str, root: str, checkpoint: str, extractor: Extractor = GazetteerExtractor(), embedder: Embedder = HashingEmbedder()) -> StreamingQuery:
    """Takes in all files that are there, and ends; run again it takes in those that came since."""
    base = source.rstrip("/").split("://")[-1] + "/"
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(source)
    files = files.select(F.substring_index("path", base, -1).alias("path"), F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("hash"))

    def put(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        batch = store.cut(batch, "batch")
        try:
            tables = store.load(session, root)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            tables = store.empty(session)
        known = tables["nodes"].where(F.col("type") == "note").select(string_field(F.col("metadata"), "path").alias("path"))
        tables, _ = merged(tables, batch, batch.select("path").unionByName(known).distinct(), base.rstrip("/").rsplit("/", 1)[-1], extractor, embedder)
        store.save(tables, root)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
