"""Exact removal of repeated byte strings, by suffix arrays that are sorted in two stages.

Every byte that a string of `LENGTH` bytes covers is removed if the same string also starts anywhere else. One suffix
array of a whole corpus fits no machine, so equal strings are first brought together: of the `GRAM`-byte grams in each
`LENGTH`-byte string the one with the least hash is its anchor (the leftmost on ties), which depends on the string's
bytes alone. Equal strings thus have equal anchors, and consecutive strings mostly share one. Each run of starts with
the same anchor is a window; windows whose anchor occurs once in the corpus hold nothing repeated and go no further.

Of windows that are equal as a whole (128 bits of hashes: the anchor's, and the window's) one stands for all, with their
number. All distinct windows of shared anchors go through the suffix sorter: suffixes smaller than their successors are
sorted directly, the others are induced by one scan over the buckets of the first byte, and a string is repeated if it
has a common prefix of `LENGTH` bytes with a neighbour, or belongs to a window that stands for several. What the sorter
marks is then brought to all windows that are equal.
An anchor with more than `SPLIT` distinct windows is dealt to as many groups as needed by a hash of each start's string:
equal strings stay together and no window is dropped. A string that stands in many different surroundings makes its group
large all the same. Such a group is dealt at random into parts of about `SPLIT` rows, each part marks what repeats within
it and keeps one row of each distinct string, and so on until the group is small: a string that repeats in a part is marked
there everywhere, and one that does not is the row that goes on, so no mark has to be brought back. No task holds more
than some `MOST` rows of a group.

A row is known by 128 bits of hashes of its doc_id and text, so that rows which share an id, or have none, keep apart;
rows with the same id and text are alike in all results.

Defined cases: a null text is empty; a text shorter than `LENGTH` bytes keeps all; repeated rows are copies of each
other, so all of a long enough one goes from each; null doc_ids each get their row; very long texts are taken in segments
of `SEGMENT` starts; columns beside doc_id and text are left out, so that no name clashes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table, text_or_empty

LENGTH = 200
GRAM = 32
SPLIT = 2000
#: Windows of an anchor that are compared as they are; beyond, its starts are dealt to groups of 2 * SPLIT on average.
MOST = 4 * SPLIT
#: Windows that occur more often than this, and than a quarter of a partition's mean, are joined by several tasks.
LEAST_OFTEN = 1000
#: Groups to deal anew that are broadcast: at most so many (24 bytes each); more are joined by a shuffle.
LARGE_GROUPS = 1 << 18
#: Starts of a text are taken in segments of so many.
SEGMENT = 1 << 20
#: Suffixes of small groups are sorted together up to so many bytes.
BATCH_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
LOW = U((1 << 21) - 1)


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = powers(SEGMENT + LENGTH + 1, BASE)
INVERSE = powers(SEGMENT + LENGTH + 1, U(pow(int(BASE), -1, 1 << 64)))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values: of blocks from both sides."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def windows(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, hash of the anchor, hash of the window and the anchor's place in it) of each run."""
    parts = []
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((np.frombuffer(piece, np.uint8).astype(np.uint64) + U(1)) * POWERS[: len(piece)], out=sums[1:])
        n = len(piece) - gram + 1
        grams = (sums[gram:] - sums[:-gram]) * INVERSE[:n]
        grams ^= grams >> U(32)
        grams *= U(0xD6E8FEB86659FD93)
        grams ^= grams >> U(29)
        anchor = (least_in_windows((grams & ~LOW) | np.arange(n, dtype=np.uint64), width) & LOW).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
        count = np.diff(np.r_[first, len(anchor)])
        place = anchor[first]
        digest = xxhash.xxh3_64_intdigest
        whole = np.fromiter((digest(piece[a : a + c + length - 1], p - a) for a, c, p in zip(first.tolist(), count.tolist(), place.tolist())), dtype=np.uint64, count=len(first))
        parts.append((first + at, count, grams[place].view(np.int64), whole.view(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def with_windows(docs: DataFrame) -> DataFrame:
    """(r, t, at, h, w): r and t know the row; at packs 8 bits of the number of starts and 40 of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ats, hs, ws = [], [], [], []
            for i, data in enumerate(b.column(2).to_pylist()):
                first, count, h, w = windows(data)
                ids.append(np.full(len(first), i))
                ats.append((first << 8) | count)
                hs.append(h)
                ws.append(w)
            rows = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *(pa.array(np.concatenate(x)) for x in (ats, hs, ws))], names=["r", "t", "at", "h", "w"])

    return docs.where("octet_length(data) >= %d" % LENGTH).select("r", "t", "data").mapInArrow(run, "r bigint, t bigint, at bigint, h bigint, w bigint")


def sorted_suffixes(parts: list[bytes], starts: list[int]) -> tuple[bytes, list[int], np.ndarray]:
    """(text, suffix array, owner) over the first `starts` suffixes of each part, and those from which they are induced.

    The text has a sentinel after each part; a suffix ends with its part. Suffixes that are equal so far keep any order.
    """
    text = b"".join(x + b"\0" for x in parts)
    sizes = np.fromiter((len(x) + 1 for x in parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes) - 1
    values = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    values[ends] = 0
    # A suffix is smaller than its successor if its next different byte is greater; a sentinel is smaller than all.
    rise = np.zeros(len(values), dtype=np.int16)
    rise[:-1] = np.diff(values)
    rise[ends] = 1
    n = len(values)
    following = np.where(rise != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    small = rise[following] > 0
    # What is sorted of each part: its starts, and on to the next suffix that needs no successor.
    owner = np.repeat(np.arange(len(parts)), sizes)
    base = ends - sizes + 1
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    last = next_small[base + np.maximum(np.asarray(starts, dtype=np.int64), 1) - 1]
    used = np.arange(n) <= last[owner]
    direct = np.flatnonzero(used & small).tolist()
    end = ends[owner].tolist()
    direct.sort(key=lambda i: (text[i : end[i]]))
    sentinels = [i for i in direct if end[i] == i]
    direct = sentinels + [i for i in direct if end[i] != i]
    # Buckets of the first byte: first room for the induced, then those sorted directly.
    large = used & ~small
    room, have = np.bincount(values[large], minlength=257), np.bincount(values[np.asarray(direct)], minlength=257)
    begin = np.cumsum(room + have) - room - have
    order = [-1] * int((room + have).sum())
    i = 0
    for c in np.flatnonzero(have).tolist():
        at, k = int(begin[c] + room[c]), int(have[c])
        order[at : at + k] = direct[i : i + k]
        i += k
    free, value, induced = begin.tolist(), values.tolist(), large.tolist()
    for at in range(len(order)):
        i = order[at] - 1
        if i >= 0 and induced[i]:
            c = value[i]
            order[free[c]] = i
            free[c] += 1
    return text, order, owner


def repeated(parts: list[bytes], starts: list[int], length: int = LENGTH, own: list[list[int] | None] | None = None, times: list[int] | None = None) -> list[np.ndarray]:
    """Of each part the starts, of its first `starts`, whose `length`-byte string starts elsewhere in the parts, too.

    own: the only starts of each part that count, or None for all; a part may then stand in several groups.
    times: how many equal parts each one stands for.
    """
    return compared(parts, starts, length, own, times)[0]


def compared(parts: list[bytes], starts: list[int], length: int, own: list[list[int] | None] | None, times: list[int] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What `repeated` gives, and of each part the starts that come first among those of the same string."""
    text, order, owner = sorted_suffixes(parts, starts)
    base = np.r_[0, np.cumsum([len(x) + 1 for x in parts])]
    sa = np.asarray(order)
    sa = sa[sa - base[owner[sa]] < np.asarray(starts)[owner[sa]]]
    if own and any(x is not None for x in own):
        counts = np.ones(int(base[-1]), dtype=bool)
        for b, x, n in zip(base.tolist(), own, starts):
            if x is not None:
                counts[b : b + n] = False
                counts[b + np.asarray(x)] = True
        sa = sa[counts[sa]]
    places = sa.tolist()
    same = np.fromiter((text[a : a + length] == text[b : b + length] for a, b in zip(places, places[1:])), dtype=bool, count=max(0, len(places) - 1))
    often = (np.r_[same, False] | np.r_[False, same])[: len(sa)]
    if times is not None:
        often |= np.asarray(times)[owner[sa]] > 1

    def by_part(found: np.ndarray) -> list[np.ndarray]:
        found = np.sort(found)
        cuts = np.searchsorted(found, base)
        return [found[cuts[k] : cuts[k + 1]] - base[k] for k in range(len(parts))]

    return by_part(sa[often]), by_part(sa[np.r_[True, ~same][: len(sa)]])


ROW = [("h", pa.int64()), ("g", pa.int64()), ("w", pa.int64()), ("a", pa.int64()), ("starts", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("own", pa.list_(pa.int32()))]
ROW_SCHEMA = "h bigint, g bigint, w bigint, a bigint, starts bigint, n bigint, data binary, own array<int>"


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, ROW)], names=[name for name, _ in ROW])


def with_starts(h: int, g: int, w: int, a: int, starts: int, n: int, data: bytes, own: list[int]) -> list[tuple]:
    """Rows for some starts of a window (from place a of it on): their strings, or all of it with them named, as is shorter."""
    if len(own) * LENGTH < len(data):
        return [(h, g, w, a + s, 1, n, data[s : s + LENGTH], None) for s in own]
    return [(h, g, w, a, starts, n, data, own)]


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of an anchor that has many windows go to groups by their strings."""
    for b in batches:
        out: list[tuple] = []
        for h, groups, w, starts, n, data in zip(*(b.column(i).to_pylist() for i in range(6))):
            own: dict[int, list[int]] = {}
            for s in range(starts):
                own.setdefault(xxhash.xxh3_64_intdigest(data[s : s + LENGTH], 7) % groups, []).append(s)
            for g, which in own.items():
                out += with_starts(h, g, w, 0, starts, n, data, which)
            if len(out) > 8000:
                yield as_batch(out)
                out = []
        yield as_batch(out)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that come sorted by h, g and, where there is one, deal: whole groups, some at a time."""
    held: list[tuple] = []
    size, last = 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            group = row[:2] + row[len(ROW) :]
            if size > BATCH_BYTES and group != last:
                yield held
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[6]), group
    if held:
        yield held


def runs_of(row: tuple, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(h, w, a, n) of a row's marked starts."""
    if not len(starts):
        return []
    return [(row[0], row[2], row[3] + int(run[0]), len(run)) for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)]


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, w, a, n) of repeated starts in rows that come sorted by group; groups are compared whole."""
    for held in whole_groups(batches):
        found = repeated([x[6] for x in held], [x[4] for x in held], LENGTH, [x[7] for x in held], [x[5] for x in held])
        runs = [run for row, starts in zip(held, found) for run in runs_of(row, starts)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*runs) if runs else [[]] * 4)], names=["h", "w", "a", "n"])


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts of groups, sorted by group and deal: marks, and one row of each distinct string. Marks have no data, and their n in starts."""
    for held in whole_groups(batches):
        found, first = compared([x[6] for x in held], [x[4] for x in held], LENGTH, [x[7] for x in held], [x[5] for x in held])
        out: list[tuple] = []
        for row, starts, kept in zip(held, found, first):
            out += [(h, row[1], w, a, n, 0, None, None) for h, w, a, n in runs_of(row, starts)]
            if len(kept):
                out += with_starts(*row[:7], kept.tolist())
        yield as_batch(out)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, removed, spans, kept = [], [], [], []
        for data, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            n = gone = 0
            digest, past, end = hashlib.sha256(), 0, -1
            for a, e in sorted((r["a"], r["a"] + r["n"] + LENGTH - 1) for r in runs or ()):
                if a > end:
                    n += 1
                    digest.update(data[past:a])
                    gone += e - a
                else:
                    gone += max(0, e - end)
                end = past = max(end, e)
            digest.update(data[past:])
            size.append(len(data))
            removed.append(gone)
            spans.append(n)
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def small_groups(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows whose groups have few, and the marks (h, w, a, n) that were found on the way there."""
    settled: list[DataFrame] = []
    before = None
    while True:
        large = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > MOST)
        large = stored(large.select("h", "g", "size", F.ceil(F.col("size") / SPLIT).alias("parts")), "groups-large")
        size = large.agg(F.sum("size")).first()[0] or 0
        # What does not shrink has no string in many surroundings, so that its size is that of a group by a hash of strings.
        if not size or (before is not None and size > 0.9 * before):
            return rows, settled
        before, columns = size, [name for name, _ in ROW]
        few = small_or_shuffled(large, LARGE_GROUPS)
        parts = rows.join(few, ["h", "g"]).select(*columns, F.pmod(F.xxhash64("w", "a", F.lit(len(settled))), F.col("parts")).alias("deal"))
        parts = parts.repartition("h", "g", "deal").sortWithinPartitions("h", "g", "deal")
        found = stored(parts.mapInArrow(thinned, ROW_SCHEMA), "groups-thinned")
        settled.append(found.where("data is null").select("h", "w", "a", F.col("starts").alias("n")))
        rows = rows.join(few, ["h", "g"], "left_anti").select(*columns).union(found.where("data is not null"))


def repeats(docs: DataFrame) -> DataFrame:
    """(r, t, a, n): runs of n starts from a on whose strings start elsewhere, too; docs: r, t, data."""
    found = stored(with_windows(docs), "windows")
    # Written, so that the joins below stand on plain exchanges, whose hot keys Spark can split.
    often = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors-shared")
    # Dealt evenly, so that the rows of a hot anchor don't stay in one file, of which a later join could split nothing.
    found = stored(found.join(often, "h", "left_semi").hint("rebalance"), "windows-shared")
    kinds = stored(found.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "t", "at")).alias("one")), "windows-kinds")
    many = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.sum(F.expr("one.at & 255")).alias("sum")).where(f"many > {SPLIT}")
    groups = F.expr(f"case when many is null then 1 when many <= {MOST} then ceil(many / {SPLIT}) else ceil(sum / {2 * SPLIT}) end").cast("long").alias("groups")
    one = kinds.join(stored(many, "anchors-split"), "h", "left").select("h", groups, "w", "n", F.col("one.r").alias("r"), F.col("one.t").alias("t"), F.col("one.at").alias("at"))
    starts = F.expr("at & 255")
    data = F.substring(F.col("data"), (F.expr("at >> 8") + 1).cast("int"), (starts + (LENGTH - 1)).cast("int"))
    texts = docs.dropDuplicates(["r", "t"]) if docs.groupBy("r", "t").count().where("count > 1").limit(1).count() else docs
    one = stored(one.join(texts, ["r", "t"]).select("h", "groups", "w", starts.alias("starts"), "n", data.alias("data")), "windows-compared")
    few = one.where("groups = 1").select("h", F.lit(0).cast("long").alias("g"), "w", F.lit(0).cast("long").alias("a"), "starts", "n", "data", F.lit(None).cast("array<int>").alias("own"))
    rows = stored(one.where("groups > 1").mapInArrow(dealt, ROW_SCHEMA), "windows-dealt")
    rows, settled = small_groups(rows)
    marks = few.union(rows).repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(marked, "h bigint, w bigint, a bigint, n bigint")
    for more in settled:
        marks = marks.union(more)
    # One row for each window with marks, so that a window is joined once.
    marks = stored(marks, "windows-marked").groupBy("h", "w").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    # Windows that occur often are dealt to several tasks; there are at most 4 a partition of them.
    total = kinds.agg(F.sum("n")).first()[0] or 0
    unit = max(LEAST_OFTEN, total // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    often = F.broadcast(kinds.where(F.col("n") > unit).select("h", "w", F.ceil(F.col("n") / unit).alias("deals")))
    found = found.join(often, ["h", "w"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("r", "t", "at"), F.col("deals")), F.lit(0)))
    marks = marks.join(often, ["h", "w"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("deals"), F.lit(1)) - 1))).drop("deals")
    return found.join(marks, ["h", "w", "deal"]).select("r", "t", F.transform("runs", lambda x: F.struct((x["a"] + F.expr("at >> 8")).alias("a"), x["n"].alias("n"))).alias("runs"))


def deduplicated(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "data").alias("r"), F.xxhash64(F.lit("text"), "data", "doc_id").alias("t"), "data")
    runs = repeats(docs.select("r", "t", "data")).groupBy("r", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    rows = docs.join(runs, ["r", "t"], "left")
    return rows.select("doc_id", "data", "runs").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: what stays of every document without the bytes of repeated strings."""
    return deduplicated(table(spark, sf_dir, "documents"))
