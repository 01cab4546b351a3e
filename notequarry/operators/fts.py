"""Full-text search with a boolean query language, ranked by BM25.

A query is a tree of phrases: words stand for all of them, AND, OR and NOT bind in this order of looseness: OR, AND, NOT;
"a b" is a phrase, a* a prefix, title:a keeps to a column, NEAR(a b, n) wants phrases with at most n words between, and
parentheses group. Each document is one row with its columns' words joined by blanks, so that every phrase is an
expression over that row: a query is one aggregation for the numbers of documents, and one pass to match and rank. Such
rows are what a knowledge base stores as its index (see plans.knowledge), so that no query cuts texts into words again;
index and queries fold words by the same rules, those of the usual full-text indexes: Latin letters lose one accent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import tokens, tokens_of

COLUMNS = ("title", "content")
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


class QueryError(ValueError):
    """The query has no valid form."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple


LEX = re.compile(r'\s+|(?P<string>"(?:[^"]|"")*")|(?P<sign>[():*,+{}])|(?P<word>[\w\x80-\U0010ffff]+)', re.UNICODE)


class Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = LEX.match(text, at)
            if not m:
                raise QueryError(f"syntax error near {text[at:at + 1]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or value is not None and item[1] != value:
            raise QueryError(f"syntax error near {item[1]!r}")
        self.at += 1
        return item

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"syntax error near {self.peek()[1]!r}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.peek() == ("word", "OR"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self):
        parts = [self.without()]
        while self.peek() == ("word", "AND"):
            self.take()
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without(self):
        tree = self.row()
        while self.peek() == ("word", "NOT"):
            self.take()
            tree = Node("not", (tree, self.row()))
        return tree

    def row(self):
        parts = [self.primary()]
        while self.peek()[0] in ("string", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek()[1] == "(":
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def primary(self, columns: tuple[str, ...] = COLUMNS):
        kind, value = self.peek()
        if value == "(" and kind == "sign":
            self.take()
            tree = self.either()
            self.take(")")
            return kept_to(tree, columns)
        if kind == "word" and self.peek(1) == ("sign", ":"):
            self.take()
            self.take(":")
            if value not in COLUMNS:
                raise QueryError(f"no such column: {value}")
            return self.primary((value,))
        if (kind, value) == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.take()
            self.take("(")
            phrases = []
            while self.peek()[0] in ("string", "word"):
                phrases.append(self.phrase(columns))
            distance = 10
            if self.peek()[1] == ",":
                self.take()
                distance = int(self.take()[1])
            self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase(columns)

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        kind, value = self.take()
        if kind not in ("string", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError(f"syntax error near {value!r}")
        words = tokens_of(value[1:-1] if kind == "string" else value)
        while self.peek() == ("sign", "+"):
            self.take()
            kind, value = self.take()
            words += tokens_of(value[1:-1] if kind == "string" else value)
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, columns)


def kept_to(tree, columns: tuple[str, ...]):
    if columns == COLUMNS:
        return tree
    if isinstance(tree, Phrase):
        return Phrase(tree.words, tree.prefix, tuple(c for c in tree.columns if c in columns))
    if isinstance(tree, Near):
        return Near(tuple(kept_to(p, columns) for p in tree.phrases), tree.distance)
    return Node(tree.kind, tuple(kept_to(p, columns) for p in tree.parts))


def parse(query: str):
    if not query.strip():
        raise QueryError("empty query")
    return Parser(query).whole()


def phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    return [p for part in (tree.phrases if isinstance(tree, Near) else tree.parts) for p in phrases(part)]


def indexed(docs: DataFrame) -> DataFrame:
    """(id, title, content, length): words between blanks; docs: id, title, content. Rows without content are left out."""
    rows = docs.where(F.col("content").isNotNull() & (F.col("content") != ""))
    for c in COLUMNS:
        rows = rows.withColumn(f"_{c}", tokens(F.coalesce(F.col(c), F.lit(""))))
    return rows.select("id", *(F.concat(F.lit(" "), F.array_join(f"_{c}", " "), F.lit(" ")).alias(c) for c in COLUMNS), sum((F.size(f"_{c}") for c in COLUMNS), F.lit(0)).alias("length"))


def pattern(p: Phrase) -> list[str]:
    """An expression for each word."""
    return [*p.words[:-1], p.words[-1] + ("[^ ]*" if p.prefix else "")]


def count_of(p: Phrase) -> Column:
    """How often a phrase occurs in its columns, overlaps included."""
    if not p.words:
        return F.lit(0)
    first, *rest = pattern(p)
    found = f"(?<= ){first}(?= {' '.join(rest)} )" if rest else f"(?<= ){first}(?= )"
    return sum((F.regexp_count(F.col(c), F.lit(found)) for c in p.columns), F.lit(0))


def near(n: Near) -> Column:
    """In one column a place from which all other phrases begin within the distance after the end of one."""
    hits = [F.lit(False)]
    for c in COLUMNS:
        own = [p for p in n.phrases if c in p.columns and p.words]
        if len(own) == len(n.phrases):
            for i, p in enumerate(own):
                rest = "".join(f"(?= (?:[^ ]+ ){{0,{n.distance}}}{' '.join(pattern(q))} )" for j, q in enumerate(own) if j != i)
                hits.append(F.col(c).rlike(f"(?<= ){' '.join(pattern(p))}{rest}" + ("" if rest else "(?= )")))
    return reduce(lambda a, b: a | b, hits)


def matches(tree) -> Column:
    if isinstance(tree, Phrase):
        return count_of(tree) > 0
    if isinstance(tree, Near):
        return near(tree)
    if tree.kind == "not":
        return matches(tree.parts[0]) & ~matches(tree.parts[1])
    return reduce((lambda a, b: a & b) if tree.kind == "and" else (lambda a, b: a | b), map(matches, tree.parts))


def search(index: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """(id, rank): the best documents, least rank first (minus BM25), by id on ties; index: from indexed()."""
    tree = parse(query)
    used = [p for p in phrases(tree) if p.words]
    counts = index.select("id", "length", *(count_of(p).alias(f"f{i}") for i, p in enumerate(used)), matches(tree).alias("hit"))
    sums = index.select("length", *((count_of(p) > 0).alias(f"h{i}") for i, p in enumerate(used)))
    sums = sums.agg(F.count(F.lit(1)).alias("N"), F.avg("length").alias("mean"), *(F.count_if(f"h{i}").alias(f"n{i}") for i in range(len(used))))
    rows = counts.where("hit").join(F.broadcast(sums))  # one row
    rank = F.lit(0.0)
    for i in range(len(used)):
        idf = F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        rank = rank - F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rows = rows.select("id", rank.alias("rank"))
    return rows if limit is None else rows.orderBy("rank", "id").limit(limit)


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, col, tf, positions): an inverted index, for export or repeated look-ups by term."""
    rows = None
    for c in COLUMNS:
        part = docs.where(F.col("content") != "").select("id", F.lit(c).alias("col"), F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("term", "id", "col").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
