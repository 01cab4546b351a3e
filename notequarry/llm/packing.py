"""Packing of documents into sequences of a fixed length, by non-negative least squares over length combinations.

Each document is cut at multiples of the sequence length; full pieces are sequences by themselves. The lengths of the
remainders, in units of `UNIT` tokens, make a histogram of at most 256 bins, whatever the number of documents. All
combinations of up to `DEPTH` units that fill a sequence exactly are enumerated; non-negative least squares says how
often to repeat each for the histogram; the counts are rounded down to whole ones that the histogram covers. What is
left over is packed greedily, longest first, each into the fullest open sequence that has room, again on counts.
Then each remainder takes the slot of its rank among those of its bin. Ranks come from counts by (bin, salt), so that a
bin with any share of the rows is dealt to many tasks, and only tables of bounded size meet in the driver.

Sequences may be left shorter than the length and are padded up to it.

Defined cases: a null text is empty and has the end id alone; repeated rows and null doc_ids each get their pieces; an
empty table has no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty
from .tokens import encoder, in_parts, vocabulary_path

LENGTH = 2048
UNIT = 8
DEPTH = 3
END_ID = 1
MAX_SALTS = 4096


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All descending tuples of 1 to `depth` positive numbers with the sum `units`."""

    def parts(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
        elif left and most * left >= rest:
            for x in range(min(rest, most), 0, -1):
                for tail in parts(rest - x, x, left - 1):
                    yield (x, *tail)

    return list(parts(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, most_steps: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)

    def solved() -> np.ndarray:
        own = a[:, active]
        try:
            return np.linalg.solve(own.T @ own + 1e-11 * np.eye(own.shape[1]), own.T @ b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(own, b, rcond=None)[0]

    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most_steps or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = solved()
            low = active & (s <= 0)
            if not low.any():
                x = s
                break
            x = x + np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)) * (s - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def greedy(counts: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram: bins from the longest on, each into the open sequences with the least room that suffices."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: Counter[tuple[int, ...]] = Counter()

    def put(combination: tuple[int, ...], n: int) -> None:
        room = units - sum(combination)
        if not room:
            done[combination] += n
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((combination, n))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                most = units // x
                whole, rest = divmod(left, most)
                if whole:
                    put((x,) * most, whole)
                if rest:
                    put((x,) * rest, 1)
                break
            room = rooms[k]
            combination, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            used = min(n, left)
            if n > used:
                put(combination, n - used)
            put((*combination, x), used)
            left -= used
    for each in open_.values():
        for combination, n in each:
            done[combination] += n
    return sorted(done.items(), reverse=True)


def plan(counts: dict[int, int], units: int = LENGTH // UNIT, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, number of such sequences), which together take up the histogram exactly."""
    left = dict(counts)
    b = np.zeros(units)
    for x, n in counts.items():
        b[x - 1] = n
    strategies = [c for c in combinations(units, depth) if all(left.get(x) for x in c)]
    out: Counter[tuple[int, ...]] = Counter()
    if strategies:
        a = np.zeros((units, len(strategies)))
        for j, c in enumerate(strategies):
            for x in c:
                a[x - 1, j] += 1
        repeats = nnls(a, b / b.max()) * b.max()
        for j in np.argsort(-repeats, kind="stable").tolist():
            need = Counter(strategies[j])
            n = min(int(repeats[j] + 1e-6), *(left[x] // k for x, k in need.items()))
            if n > 0:
                out[strategies[j]] += n
                for x, k in need.items():
                    left[x] -= k * n
    for c, n in greedy({x: n for x, n in left.items() if n}, units):
        out[c] += n
    return sorted(out.items(), reverse=True)


def pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each document's pieces, and bin: 0 for full ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], []
            for first, texts in in_parts(b.column(1)):
                flat, cuts = encoder(vocabulary).encode(texts)
                flat = np.insert(flat, cuts[1:], end_id).astype("<u4", copy=False)
                cuts = (cuts + np.arange(len(cuts))).tolist()
                for k, (a, e) in enumerate(zip(cuts, cuts[1:]), first):
                    for at in range(a, e, length):
                        piece = flat[at : min(at + length, e)]
                        out.append((at - a, len(piece), zlib.crc32(piece), e - a, -(-len(piece) // UNIT) if len(piece) < length else 0))
                        rows.append(k)
            columns = np.array(out, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(columns[:, j]) for j in range(5))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin bigint")


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    salts = min(MAX_SALTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces(docs, vocabulary or vocabulary_path(), length, end_id)
    rows = stored(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts))), "pieces")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("bin", "salt").count().collect()}  # at most 257 * MAX_SALTS
    first, totals = {}, Counter()
    for (b, s), n in sorted(counts.items()):
        first[b, s] = totals[b]
        totals[b] += n
    sequences = plan({b: n for b, n in totals.items() if b}, length // UNIT)
    # The slots of each bin, as runs: from the rank on, place in the sequence, number of the first sequence.
    slots: dict[int, list[tuple[int, int, int]]] = {0: [(0, 0, sum(n for _, n in sequences))]}
    taken: Counter[int] = Counter()
    number = 0
    for bins, n in sequences:
        for place, b in enumerate(bins):
            slots.setdefault(b, []).append((taken[b], place, number))
            taken[b] += n
        number += n
    runs = {b: tuple(np.array(x, dtype=np.int64) for x in zip(*s)) for b, s in slots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, salt, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("bin", "salt", "rank"))
            sequence, place = np.zeros(len(bins), dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
            for b in np.unique(bins).tolist():
                own = bins == b
                at = rank[own] - 1 + np.fromiter((first[b, s] for s in salt[own].tolist()), dtype=np.int64)
                begins, places, numbers = runs[b]
                k = np.searchsorted(begins, at, side="right") - 1
                sequence[own], place[own] = numbers[k] + at - begins[k], places[k]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "place"])

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")).cast("long"))
    placed = ranked.mapInArrow(assign, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, place bigint")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place")) - F.col("length")
    return placed.withColumn("offset", offset).drop("place")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: where each piece of every document lies."""
    return packed(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that are left."""
    return packed(docs)
