"""A knowledge base: the tables, and everything that can be asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import embed_text
from ..operators import changes, community, fts, graph, hybrid, rag, vector
from ..operators.filters import parse
from ..plugins import Embedder, ExtractiveGenerator, Extractor, GazetteerExtractor, Generator, HashingEmbedder
from ..sources import markdown, store
from . import ingest


@dataclass(frozen=True)
class Config:
    """Defaults of the commands; from_toml() replaces those that a file names."""

    k: int = 5
    depth: int = 2
    alpha: float = 0.7
    fts_limit: int = 10
    max_depth: int = 10
    resolution: float = 1.0

    @staticmethod
    def from_toml(path: str) -> Config:
        import tomllib

        given = tomllib.loads(Path(path).read_text())
        flat = given | {k: v for part in given.values() if isinstance(part, dict) for k, v in part.items()}
        return replace(Config(), **{k: flat[k] for k in Config.__dataclass_fields__ if k in flat})


@dataclass
class KnowledgeBase:
    spark: SparkSession
    tables: dict[str, DataFrame]
    embedder: Embedder = field(default_factory=HashingEmbedder)
    extractor: Extractor = field(default_factory=GazetteerExtractor)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    config: Config = field(default_factory=Config)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **more) -> KnowledgeBase:
        return cls(spark, store.load(spark, root), **more)

    @property
    def nodes(self) -> DataFrame:
        return self.tables["nodes"]

    @property
    def edges(self) -> DataFrame:
        return self.tables["edges"]

    @property
    def chunks(self) -> DataFrame:
        return self.tables["chunks"]

    @property
    def communities(self) -> DataFrame:
        return self.tables["communities"]

    @property
    def index(self) -> DataFrame:
        """The stored full-text index; one made now for tables that weren't loaded."""
        if "fts" not in self.tables:
            self.tables["fts"] = store.cut(fts.indexed(changes.searchable(self.nodes)), "fts")
        return self.tables["fts"]

    def _vector(self, text: str) -> list[float]:
        found = [float(x) for x in self.embedder.embed([text])[0]]
        if not found:
            raise ValueError("the embedder gave an empty vector")
        return found

    def search(self, query: str, k: int | None = None, depth: int | None = None, alpha: float | None = None, min_weight: float | None = None, notes_only: bool = False, filters: Sequence[str] = (), prefilter: bool = False) -> DataFrame:
        for f in filters:
            parse(f)
        c = self.config
        return hybrid.hybrid_search(self.nodes, self.edges, self.chunks, query, self._vector(query), k or c.k, c.depth if depth is None else depth, c.alpha if alpha is None else alpha, min_weight, notes_only, filters, prefilter)

    def similar(self, label: str | None = None, file: str | None = None, k: int | None = None) -> DataFrame:
        """(note_id, label, similarity, score, header, text) of the notes like one note, or like one Markdown file."""
        if (label is None) == (file is None):
            raise ValueError("give either a label or a file")
        without = None
        if label is not None:
            without = graph.resolve_label(self.nodes, label)
            own = store.embedded_chunks(store.chunks_of(self.chunks, without))
            sources = [r["embedding"] for r in own.select("embedding").collect()]  # the chunks of one note
        else:
            text = self.spark.read.text(file, wholetext=True).first()[0]
            parts = markdown.chunks(markdown.frontmatter(text)[1])
            sources = self.embedder.embed([f"{h}\n{t}" if h else t for h, t in parts]).tolist() if parts else []
        found = vector.similar_notes(self.chunks, sources, k or self.config.k, without)
        labels = self.nodes.select(F.col("id").alias("note_id"), "label", hybrid.file_of(F.col("metadata")).alias("file"))
        return found.join(labels, "note_id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("note#"), F.col("note_id").cast("string")))).orderBy(F.desc("similarity"), "note_id")

    def fts(self, query: str, limit: int | None = None, notes_only: bool = False) -> DataFrame:
        """(id, label, type, rank): best first; notes_only holds after the limit."""
        hits = fts.search(self.index, query, limit or self.config.fts_limit)
        rows = hits.join(self.nodes.select("id", "label", "type"), "id")
        return (rows.where(F.col("type") == "note") if notes_only else rows).orderBy("rank", "id")

    def graph(self, name: str, depth: int | None = None) -> DataFrame:
        return graph.graph_only(self.nodes, self.edges, name, self.config.depth if depth is None else depth)

    def path(self, start: str, end: str, max_depth: int | None = None) -> list[str] | None:
        return graph.shortest_path(self.nodes, self.edges, start, end, max_depth or self.config.max_depth)

    def subgraph(self, start: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.nodes, self.edges, start, depth)

    def layout(self, start: str | None = None, depth: int = 2) -> dict[int, tuple[float, float]]:
        nodes, edges = self.subgraph(start, depth)
        return graph.force_layout([r["id"] for r in nodes.collect()], [(r["source_id"], r["target_id"]) for r in edges.collect()])

    def detect_communities(self, resolution: float | None = None) -> DataFrame:
        """Replaces the communities by newly detected ones."""
        found = community.detect(self.nodes, self.edges, resolution or self.config.resolution)
        from ..schema import conformed

        self.tables["communities"] = store.cut(conformed(community.as_table(found), "communities"), "communities")
        return self.communities

    def summarize_communities(self, generator: Generator | None = None) -> DataFrame:
        new = community.summarized(self.communities, self.nodes, self.edges, generator or self.generator, self.embedder)
        self.tables["communities"] = store.cut(new, "communities")
        return self.communities

    def related(self, query: str, k: int = 2) -> DataFrame:
        return vector.related_communities(self.communities, self._vector(query), k)

    def ask(self, question: str, k: int | None = None, communities: int = 3, filters: Sequence[str] = ()) -> rag.Answer:
        results = self.search(question, k, filters=filters)
        return rag.ask(question, results, self.communities, self.embedder, self.generator, rag.Options(communities=communities, evidence=k or self.config.k))

    def stats(self) -> DataFrame:
        return store.db_stats(self.nodes, self.edges, self.chunks)

    def save(self, root: str) -> None:
        store.save(self.tables, root)

    def build(self, source: str, root: str) -> ingest.BuildStats:
        stats = ingest.build(self.spark, source, root, self.extractor, self.embedder)
        self.tables = store.load(self.spark, root)
        return stats


__all__ = ["Config", "KnowledgeBase", "embed_text"]
