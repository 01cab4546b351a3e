"""SimHash near-duplicates found by covering-code anchors.

Anchors are the words of a covering code: the perfect Hamming code over bits 1 to 63 (covering radius 1), with bit 0
left free. Two fingerprints that differ in at most 2 bits have a point between them that is within 1 bit of both; that
point's anchor is within the covering radius of it. So each fingerprint is replicated to every anchor within the
covering radius plus the threshold's half (its part when both sides are replicated): at most 33 of them, and two
linked fingerprints always meet. An anchor has at most 2,081 points that near, so that no group grows with the data:
exact copies share one fingerprint and are one row here, and a group of any number of near copies spreads over anchors.
Fingerprints at one anchor are compared in full, and a spanning forest of the links found there goes on, not all pairs;
each differing pair stays connected by links of at most 2 bits.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; a null doc_id
takes part, and counts as larger than any other in the choice of a component's id; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .common import stored, table, text_or_empty, unused

SHINGLE = 3
THRESHOLD = 2
BLOCK = 1 << 16
U = np.uint64


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included; A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, len(line))]
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` as _k0, _k1, ... (strings and numbers), and _f: the fingerprint as a signed long."""
    schema = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t) for t in b.column("_text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in schema.names), pa.array(prints.view(np.int64))], names=[*schema.names, "_f"])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), text_or_empty().alias("_text"))
    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), "_f bigint"]))


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, anchor) for every anchor within 2 bits; prints: uint64."""
    bits = np.arange(64, dtype=U)
    syndrome = np.zeros(len(prints), dtype=np.int64)
    for i in range(1, 64):
        syndrome ^= ((prints >> U(i)) & U(1)).astype(np.int64) * i
    off = syndrome > 0
    on = prints[~off]
    nearest = prints[off] ^ (U(1) << syndrome[off].astype(U))
    of, at = [on, on, prints[off], prints[off]], [on, on ^ U(1), nearest, nearest ^ U(1)]
    for i in bits[1:]:
        other = syndrome[off].astype(U) ^ i
        pair = (other > i) & (other < U(64))
        x = prints[off][pair]
        of.append(x)
        at.append(x ^ (U(1) << i) ^ (U(1) << other[pair]))
    return np.concatenate(of), np.concatenate(at)


def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of, at = anchors(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(of.view(np.int64))], names=["anchor", "f"])


def forest(prints: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what links of at most `threshold` bits connect; prints: distinct, 2,081 at most."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        # Grow one tree: what is near to the node in hand leaves the rest.
        queue = [int(rest[0])]
        rest = rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[x]) <= threshold
            for y in rest[near]:
                links.append((x, int(y)))
                queue.append(int(y))
            rest = rest[~near]
    return links


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor; a group may go on in the next batch."""
    kept_a, kept_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(a)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(a)]
        left, right = [], []
        for s, e in zip(starts, ends):
            if e - s > 1:
                x = f[s:e]
                for i, j in forest(x.view(np.uint64)):
                    left.append(x[i])
                    right.append(x[j])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    for b in batches:
        a = np.concatenate([kept_a, b.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([kept_f, b.column(1).to_numpy(zero_copy_only=False)])
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1]))
        kept_a, kept_f = a[cut:], f[cut:]
        if cut:
            yield links(a[:cut], f[:cut])
    if len(kept_a):
        yield links(kept_a, kept_f)


def linked(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints; prints: f, distinct."""
    rows = prints.select("f").mapInArrow(replicated, "anchor bigint, f bigint")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(compared, "a bigint, b bigint").distinct()


LAST = (1 << 63) - 1


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (_k0: doc_id, _k1: a hash of the text, _f: fingerprint), and of each fingerprint (_f, _c: least doc_id of its
    component, _w: what that document has as _k1)."""
    docs = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("_t"))
    rows = stored(with_fingerprints(docs, ["doc_id", "_t"]), "simhash")
    least = F.struct(F.coalesce(F.col("_k0").cast("long"), F.lit(LAST)).alias("v"), F.col("_k1").alias("t"))
    nodes = stored(rows.groupBy(F.col("_f").alias("f")).agg(F.min(least).alias("least")), "simhash-prints")
    reach = components(linked(nodes))
    nodes = nodes.join(reach, nodes["f"] == reach["node"], "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    nodes = stored(nodes, "simhash-groups")
    first = nodes.groupBy("c").agg(F.min("least").alias("first"))
    return rows, nodes.join(first, "c").select(F.col("f").alias("_f"), F.col("first.v").alias("_c"), F.col("first.t").alias("_w"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: doc_id, fingerprint, component_id of every document; component_id is null where no member has an id."""
    rows, of = groups(table(spark, sf_dir, "documents"))
    return rows.join(of, "_f").select(
        F.col("_k0").alias("doc_id"),
        F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_c") < LAST, F.col("_c")).alias("component_id"),
    )


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the least doc_id stays (any one, if rows repeat)."""
    found, of = groups(docs)
    first = of.select(F.when(F.col("_c") < LAST, F.col("_c")).alias("_id"), "_w").distinct()
    t = unused(docs, "_t")
    rows = docs.withColumn(t, F.xxhash64(text_or_empty()))
    rows = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (rows[t] == first["_w"]), "left_semi")
    if found.groupBy("_k0", "_k1").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", t])
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
