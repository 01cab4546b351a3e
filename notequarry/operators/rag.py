"""Answers from evidence: sources, prompts and the question itself."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import truncate_chars
from ..plugins import Embedder, Generator
from .vector import related_communities

NOTHING = "No relevant information found."


@dataclass(frozen=True)
class Options:
    communities: int = 3
    evidence: int = 5
    summary_chars: int = 500
    chunk_chars: int = 300


@dataclass(frozen=True)
class Answer:
    answer: str
    sources: list[dict] = field(default_factory=list)


def sources(results: DataFrame, order: str = "rank") -> DataFrame:
    """(label, path) of results, the first of each file, or of each label without a file, in order."""
    key = F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit("f:"), F.col("file"))).otherwise(F.concat(F.lit("l:"), F.col("label")))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = results.withColumn("_first", first).where("_first = 1")
    return rows.select(order, "label", F.when(F.coalesce("file", F.lit("")) != "", F.col("file")).alias("path")).orderBy(order)


def evidence(results: DataFrame, options: Options = Options(), order: str = "rank") -> DataFrame:
    """(rank, label, text): the first results with the chunk, or else the content, cut to size."""
    text = F.when(F.coalesce("chunk_text", F.lit("")) != "", F.col("chunk_text")).otherwise(F.coalesce("content", F.lit("")))
    return results.orderBy(order).limit(options.evidence).select(order, "label", truncate_chars(text, options.chunk_chars).alias("text"))


def build_prompt(question: str, communities: list[tuple[str, str]], notes: list[tuple[str, str]], options: Options = Options()) -> str:
    def short(text: str, n: int) -> str:
        return text if len(text) <= n else text[:n] + "..."

    lines = ["Answer the question from what is given here, and name the notes that you use."]
    if communities:
        lines += ["", "## Communities", *(f"Community: {label}\n{short(s, options.summary_chars)}" for label, s in communities[: options.communities])]
    if notes:
        lines += ["", "## Notes", *(f"Note: {label}\n{short(t, options.chunk_chars)}" for label, t in notes[: options.evidence])]
    return "\n".join([*lines, "", f"Question: {question}"])


def ask(question: str, results: DataFrame, communities: DataFrame, embedder: Embedder, generator: Generator, options: Options = Options()) -> Answer:
    """results: rows of hybrid search, best first by score and id. What reaches the driver is bounded by options."""
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    notes = [(r["label"], r["text"]) for r in evidence(ranked, options).collect()]
    if not notes:
        return Answer(NOTHING)
    vector = [float(x) for x in embedder.embed([question])[0]]
    found = [(r["label"], r["summary"]) for r in related_communities(communities, vector, options.communities, 0.0).collect()]
    said = generator.generate(build_prompt(question, found, notes, options))
    return Answer(said, [{"label": r["label"], "path": r["path"]} for r in sources(ranked).collect()])


def as_json(answer: Answer, results: DataFrame) -> str:
    rows = [json.loads(x) for x in results.toJSON().collect()]
    return json.dumps({"answer": answer.answer, "sources": answer.sources, "results": rows}, ensure_ascii=False, indent=2)
