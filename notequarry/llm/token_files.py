"""Token ids in files of directly addressable codes.

A shard holds the ids of consecutive documents. Each id is split into chunks of `CHUNK` bits, low ones first; level k
holds the k-th chunks of the ids that have one, a bitmap says which go on to the next level, and a rank directory holds
the count of set bits before each block of `BLOCK` bits. The id at any place is read by one look into each level: its
place in the next level is the rank of its bit. No block is decoded for it.

A shard's bytes, little-endian: "DAC1", then int64 documents, ids, levels; int64 doc_ids; uint8 null flags of doc_ids;
int64 offsets of documents (one more than documents); per level int64 chunks and a flag if there is a bitmap, the chunks
(one byte each), the bitmap padded to whole blocks, and the int64 directory. Shards are rows (part, seq, n_ids, shard) of
Parquet files that Spark writes and commits, so that lost tasks leave nothing behind; (part, seq) follows doc_id order.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated rows each get their ids;
a document larger than a shard has one to itself; an empty table makes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_or_shuffled, table, text_or_empty
from .tokens import encoder, in_parts, vocabulary_path

CHUNK, BLOCK = 8, 512
SHARD_IDS = 1 << 20
END_ID = 2
MAGIC = b"DAC1"
MAX_PARTS = 1_000_000


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
    values = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    levels = []
    while True:
        more = values >> np.uint32(CHUNK)
        goes_on = more > 0
        last = not goes_on.any()
        level = struct.pack("<qq", len(values), not last) + (values & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes()
        if not last:
            bits = np.zeros(-(-len(values) // BLOCK) * BLOCK, dtype=np.uint8)
            bits[: len(values)] = goes_on
            ranks = np.r_[0, np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))].astype("<i8")
            level += np.packbits(bits, bitorder="little").tobytes() + ranks.tobytes()
        levels.append(level)
        if last:
            break
        values = more[goes_on]
    head = MAGIC + struct.pack("<qqq", len(ids), int(lengths.sum()), len(levels))
    named = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return head + named + np.r_[0, np.cumsum(lengths)].astype("<i8").tobytes() + b"".join(levels)


class Shard:
    """Reads a shard in place."""

    def __init__(self, data: bytes | memoryview):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, self.n_ids, n_levels = struct.unpack_from("<qqq", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        numbers, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(numbers, nulls)]
        self.offsets = take("<i8", docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n, has = struct.unpack_from("<qq", data, at)
            at += 16
            chunks, blocks = take("u1", n), -(-n // BLOCK) * bool(has)
            self.levels.append((chunks, take("u1", blocks * BLOCK // 8), take("<i8", blocks + 1 if has else 0)))

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        places = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(places), dtype=np.uint64)
        left = np.arange(len(places))
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[left] |= chunks[places].astype(np.uint64) << np.uint64(CHUNK * k)
            if not len(bitmap):
                break
            on = (bitmap[places >> 3] >> (places & 7)) & 1 > 0
            left, places = left[on], places[on]
            # The rank: of the blocks before, of the whole bytes before in the block, and of the bits before in the byte.
            byte, block = places >> 3, places // BLOCK
            counts = np.r_[0, np.cumsum(np.bitwise_count(bitmap), dtype=np.int64)] if len(places) * 8 > len(bitmap) else None
            if counts is not None:
                within = counts[byte] - counts[block * (BLOCK // 8)]
            else:
                spans = byte[:, None] - block[:, None] * (BLOCK // 8) > np.arange(BLOCK // 8)
                within = (np.bitwise_count(bitmap[block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)]) * spans).sum(axis=1, dtype=np.int64)
            places = ranks[block] + within + np.bitwise_count(bitmap[byte] & ((1 << (places & 7)) - 1).astype(np.uint8))
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        """All ids in order: where every set bit is taken, ranks are consecutive numbers."""
        out, left = np.zeros(self.n_ids, dtype=np.uint32), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            if left is None:
                out |= part
            else:
                out[left] |= part
            if not len(bitmap):
                break
            on = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
            left = on if left is None else left[on]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.at(np.arange(self.offsets[i], self.offsets[i + 1]))


def written(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each with the end id, as shards under path."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            kinds = (("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip((part, seq, size, pack(names, ids)), kinds)], names=[n for n, _ in kinds])

        for b in batches:
            for first, texts in in_parts(b.column(1)):
                flat, cuts = encoder(vocabulary).encode(texts)
                flat = np.insert(flat, cuts[1:], end_id)
                cuts = (cuts + np.arange(len(cuts))).tolist()
                for k, name in enumerate(b.column(0).slice(first, len(texts)).to_pylist()):
                    x = flat[cuts[k] : cuts[k + 1]]
                    if ids and size + len(x) > SHARD_IDS:
                        yield shard()
                        seq, names, ids, size = seq + 1, [], [], 0
                    names.append(name)
                    ids.append(x)
                    size += len(x)
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part bigint, seq bigint, n_ids bigint, shard binary").write.option("compression", "none").parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards under path."""
    shards = spark.read.schema("part bigint, seq bigint, n_ids bigint, shard binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Shard(memoryview(data.as_buffer()))
                n = len(s.doc_ids)
                whole, cuts = s.all().astype("<u4", copy=False), s.offsets.tolist()
                sums = [zlib.crc32(whole[a:e]) for a, e in zip(cuts, cuts[1:])]
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(s.offsets[:-1]), pa.array(np.diff(s.offsets)), pa.array(sums, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "within", "n_tokens", "ids_crc32", "part", "seq"])

    docs = shards.select("part", "seq", "shard").mapInArrow(run, "doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint, part bigint, seq bigint")
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task of the writer
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = sizes.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("in_part"))
    starts = within.join(small_or_shuffled(before, MAX_PARTS), "part").select("part", "seq", (F.col("before") + F.col("in_part")).alias("base"))
    docs = docs.join(small_or_shuffled(starts, MAX_PARTS), ["part", "seq"])
    return docs.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: writes the ids of all documents and returns what the files say."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    written(table(spark, sf_dir, "documents"), path)
    return read_back(spark, path)
