"""Benchmark decontamination by edit distance over words: CGK embedding, bit-sampling LSH, exact verification.

A document holds an item if some run of its words is within `floor((1 - SIMILARITY) * words)` word edits of the item.
Words are runs of letters and digits, lower-cased; in scripts that put no blanks between words each letter is one. An item of n words and k allowed edits shares at least n - 1 - 2k of
its neighbouring word pairs with such a run (an edit destroys two pairs at most), so only places whose surroundings hold
that many word pairs of the benchmark can begin one; this filter loses nothing, and everything else is left at once.

From each such place a window of the item's size, and every item, is embedded by CGK random walks: a pointer copies its
word and moves on or stays by a random bit of step and word. Texts within few edits get walks that mostly agree
position by position. Repeated bit-sampling LSH takes some positions of a walk as a key. Windows and items with an equal
key are verified by exact edit distance. Keys of the first two thirds of a walk are the same for equal words, so copies
without edits always meet; with many insertions or deletions walks part, and the keys find few of the places.

So keys alone decide only where they find a copy without edits. Of every other text and item the word pairs they share
are counted for that item alone, which again loses nothing, and what has enough of them within a window is compared
exactly at all places. All pairs within the allowed edits are returned, with the fewest edits, and no others.

Items of 1 to 4 words allow no edit: they are looked up as they are.

The benchmark is taken in blocks of `BLOCK_ITEMS`, each broadcast to one pass over all documents.

Defined cases: null texts are empty and hold nothing; items without words are not searched for; repeated documents and
items each get their rows; null doc_ids and item_ids are kept as they are; of several best places the first one counts;
very long texts are searched whole, in pieces; columns beside doc_id and text, and item_id and text, are left out by
leaks(), and kept by the stage, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, unused

SIMILARITY = 0.8
LEAST_WORDS = 5
WALKS, SAMPLES, BITS = 8, 8, 3
BLOCK_ITEMS = 20_000
#: Items are searched by classes of size: the largest of a class is at most this much above the smallest.
CLASS_GROWTH = 1.25
#: Scripts without blanks between words: Thai, Lao, Burmese, Khmer, Chinese and Japanese signs.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|(?!_)\w")
SEED = 20_240_229
#: Texts searched, windows embedded, and word pairs looked up by item, at a time.
TEXTS, WINDOWS, PAIRS = 512, 8192, 1024


#: The same for texts that have nothing as high as the first of those scripts.
PLAIN_WORD, HIGH = re.compile(r"[^\W_]+"), re.compile("[\u0e00-\U0010ffff]")


def words(text: str) -> list[str]:
    text = text.lower()
    return (PLAIN_WORD if text.isascii() or not HIGH.search(text) else WORD).findall(text)


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


class Walks:
    """CGK walks over word numbers, the same for all texts."""

    def __init__(self, steps: int, walks: int = WALKS, samples: int = SAMPLES, bits: int = BITS):
        random = np.random.default_rng(SEED)
        self.keys = random.integers(1, 1 << 62, size=(walks, steps), dtype=np.uint64) | np.uint64(1)
        self.samples = [(w, random.random(bits)) for w in range(walks) for _ in range(samples)]
        self.steps = steps

    def embed(self, windows: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """Copies of each row's words, -1 beyond its end; windows: rows of word numbers, ended by -1."""
        at, rows = np.zeros(len(windows), dtype=np.int64), np.arange(len(windows))
        out = np.empty((len(windows), steps), dtype=np.int32)
        for j in range(steps):
            word = windows[rows, at]
            out[:, j] = word
            mixed = (word.astype(np.int64).astype(np.uint64) + np.uint64(77)) * self.keys[walk, j]
            at = np.minimum(at + (mixed >> np.uint64(61) & np.uint64(1)).astype(np.int64), windows.shape[1] - 1)
        return out

    def codes(self, windows: np.ndarray, reach: int) -> list[np.ndarray]:
        """A number for each row and sample, from positions below `reach`."""
        out, last, embedded = [], None, None
        for w, places in self.samples:
            if w != last:
                embedded, last = self.embed(windows, w, reach), w
            code = np.zeros(len(windows), dtype=np.uint64)
            for p in places:
                code = code * np.uint64(0x9E3779B97F4A7C15) + embedded[:, int(p * reach)].astype(np.int64).astype(np.uint64) + np.uint64(2)
            out.append(code)
        return out


def distances(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the least edit distance between the item and a beginning of the row, and that beginning's length."""
    n, width = len(item), windows.shape[1]
    steps = np.arange(1, width + 1, dtype=np.int16)
    before = np.broadcast_to(np.arange(width + 1, dtype=np.int16), (len(windows), width + 1)).copy()
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        best = np.minimum(before[:, 1:] + np.int16(1), before[:, :-1] + (windows != item[i]))
        # Insertions along the row: the least of best[j'] + (j - j').
        now[:, 1:] = np.minimum(np.minimum.accumulate(best - steps, axis=1), np.int16(i + 1)) + steps
        before = now
    at = before.argmin(axis=1)
    return before[np.arange(len(windows)), at], at


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance between the item and any run of the text's words, first word of the leftmost such run).

    Columns of the table of distances are bits of differences (Myers), from the text's end to its beginning.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << n - 1
    equal: dict[int, int] = {}
    for i, x in enumerate(item[::-1].tolist()):
        equal[x] = equal.get(x, 0) | 1 << i
    up, down, score, best = full, 0, n, (n, len(text))
    for s in range(len(text) - 1, -1, -1):
        eq = equal.get(int(text[s]), 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score <= best[0]:
            best = (score, s)
    return best


class Benchmark:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        self.short: dict[int, list[tuple[int, list[int]]]] = {}  # by the first word's number
        self.short_ids = []
        for item_id, text in items:
            w = words(text or "")
            if 0 < len(w) < LEAST_WORDS:
                numbers = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
                self.short.setdefault(numbers[0], []).append((len(self.short_ids), numbers))
                self.short_ids.append(item_id)
            elif w:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.int32))
        self.base = len(self.vocabulary) + 1
        pairs = [x[:-1].astype(np.int64) * self.base + x[1:] for x in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        # Of each word pair the items that have it, and of each item how many shared pairs within how many words it needs.
        of = np.concatenate([np.full(len(x), i) for i, x in enumerate(pairs)]) if pairs else np.empty(0, np.int64)
        both = np.unique(np.stack([np.searchsorted(self.pairs, np.concatenate(pairs)), of]), axis=1) if pairs else np.empty((2, 0), np.int64)
        self.owners, self.owned = both[1], np.searchsorted(both[0], np.arange(len(self.pairs) + 1))
        allowed = [edits_allowed(len(x), similarity) for x in self.items]
        self.need = np.array([max(1, len(x) - 1 - 2 * k) for x, k in zip(self.items, allowed)], dtype=np.int64)
        self.reach = np.array([len(x) + k for x, k in zip(self.items, allowed)], dtype=np.int64)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.slot(self.pairs)] = True
        sizes = sorted({len(x) for x in self.items})
        self.classes: list[tuple[int, int, int]] = []  # least and largest size, least number of shared pairs
        while sizes:
            own = [n for n in sizes if n <= max(sizes[0] + 1, sizes[0] * CLASS_GROWTH)]
            self.classes.append((own[0], own[-1], max(1, min(n - 1 - 2 * edits_allowed(n, similarity) for n in own))))
            sizes = sizes[len(own) :]
        self.walks = Walks(max(2, max((len(x) for x in self.items), default=1) * 3 // 2 + 2))
        # Of each class its items, and their codes in order. At step j a walk has come to word j / 2 or so: the positions
        # used lie in the part that all sizes of a class have.
        self.tables = []
        for low, high, _ in self.classes:
            own = [i for i, x in enumerate(self.items) if low <= len(x) <= high]
            rows = np.full((len(own), high + 1), -1, dtype=np.int32)
            for r, i in zip(rows, own):
                r[: len(self.items[i])] = self.items[i]
            codes = self.walks.codes(rows, low + low // 2)
            self.tables.append((own, [(order := np.argsort(c, kind="stable"), c[order]) for c in codes]))

    def id_of(self, i: int) -> int | None:
        return self.ids[i] if i < len(self.ids) else self.short_ids[i - len(self.ids)]

    @staticmethod
    def slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def shared(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the benchmark's word pairs among a text's words, and the number of each pair."""
        pairs = w[:-1].astype(np.int64) * self.base + w[1:]
        at = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0) & self.bitmap[self.slot(pairs)])
        pair = np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)
        real = self.pairs[pair] == pairs[at]
        return at[real], pair[real]

    def regions(self, w: np.ndarray) -> dict[int, list[list[int]]]:
        """Of each item that a text can hold, the parts of its words in which all such places lie."""
        at, pair = self.shared(w)
        spans: set[tuple[int, int, int]] = set()
        # A piece ends so far beyond the next one's beginning that every window lies in one.
        for i in range(0, len(at), PAIRS):
            places, own = at[i : i + PAIRS + int(self.reach.max())], pair[i : i + PAIRS + int(self.reach.max())]
            first, count = self.owned[own], self.owned[own + 1] - self.owned[own]
            item = self.owners[np.arange(int(count.sum())) + np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)]
            place = np.repeat(places, count)
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            other = np.arange(len(item)) + self.need[item] - 1
            last = np.minimum(other, len(item) - 1)
            ok = np.flatnonzero((other < len(item)) & (item[last] == item) & (place[last] - place <= self.reach[item] - 2))
            begin, end = np.maximum(place[last[ok]] + 2 - self.reach[item[ok]], 0), place[ok] + self.reach[item[ok]]
            spans.update(zip(item[ok].tolist(), begin.tolist(), end.tolist()))
        found: dict[int, list[list[int]]] = {}
        for k, a, e in sorted(spans):
            parts = found.setdefault(k, [])
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(e, parts[-1][1])
            else:
                parts.append([a, e])
        return found

    def complete(self, t: int, w: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Notes in best every item that the text holds, unless it is there without edits."""
        for i, parts in self.regions(w).items():
            if best.get((t, i), (1,))[0] == 0:
                continue
            item = self.items[i]
            allowed = int(self.reach[i]) - len(item)
            d, first = min((d, a + s) for a, e in parts for d, s in (nearest(item, w[a:e]),))
            if d <= allowed:
                best[t, i] = (d, first, int(distances(item, w[None, first : first + len(item) + allowed])[1][0]))

    def places(self, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """The text's words by number, and of each class the places at which an item can begin."""
        known = self.vocabulary.get
        w = np.array([known(x, 0) for x in words(text)], dtype=np.int32)
        none = [np.empty(0, np.int64)] * len(self.classes)
        if not self.items or len(w) < LEAST_WORDS - 1:
            return w, none
        at, _ = self.shared(w)
        if len(at) < min(need for *_, need in self.classes):
            return w, none
        shared = np.zeros(len(w) + 1, dtype=np.int64)
        shared[at + 1] = 1
        sums = np.cumsum(shared)
        out = []
        for low, high, need in self.classes:
            reach = high + edits_allowed(high, self.similarity)
            ends = np.minimum(np.arange(len(w)) + reach, len(w))
            out.append(np.flatnonzero(sums[ends] - sums[:-1] >= need) if len(at) >= need else none[0])
        return w, out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, number of the item, edits, first word, words) of every item that a text holds, at its best place."""
        held: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in self.classes]
        left, numbered = [], []
        for t, text in enumerate(texts):
            w, places = self.places(text)
            if self.short:
                numbered.append((t, w))
            if any(len(x) for x in places):
                left.append((t, w))
            for own, starts in zip(held, places):
                if len(starts):
                    own.append((t, w, starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.exactly(numbered, best)
        for k, own in enumerate(held):
            width = self.classes[k][1] + edits_allowed(self.classes[k][1], self.similarity) + 1
            parts, of, size = [], [], 0
            for t, w, starts in own:
                padded = np.concatenate([w, np.full(width, -1, dtype=np.int32)])
                for i in range(0, len(starts), WINDOWS):
                    at = starts[i : i + WINDOWS]
                    parts.append(padded[at[:, None] + np.arange(width)])
                    of.append(np.stack([np.full(len(at), t), at], axis=1))
                    size += len(at)
                    if size >= WINDOWS:
                        self.near(k, np.concatenate(parts), np.concatenate(of), best)
                        parts, of, size = [], [], 0
            if parts:
                self.near(k, np.concatenate(parts), np.concatenate(of), best)
        for t, w in left:
            self.complete(t, w, best)
        return [(*key, *value) for key, value in sorted(best.items())]

    def exactly(self, texts: list[tuple[int, np.ndarray]], best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Notes in best where items below LEAST_WORDS stand first; they are numbered after the others."""
        begins = np.zeros(self.base + 1, dtype=bool)
        begins[list(self.short)] = True
        for t, w in texts:
            for at in np.flatnonzero(begins[w]).tolist():
                for i, item in self.short[int(w[at])]:
                    if (t, len(self.ids) + i) not in best and w[at : at + len(item)].tolist() == item:
                        best[t, len(self.ids) + i] = (0, at, len(item))

    def near(self, k: int, windows: np.ndarray, of: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Notes in best what windows of a class hold; of: text and first word of each."""
        low, high, _ = self.classes[k]
        own, tables = self.tables[k]
        rows = windows[:, : high + 1].copy()
        rows[:, high] = -1
        meet = []
        for code, (order, codes) in zip(self.walks.codes(rows, low + low // 2), tables):
            left = np.searchsorted(codes, code)
            count = np.searchsorted(codes, code, side="right") - left
            r = np.flatnonzero(count)
            if len(r):
                first = np.repeat(left[r] - np.r_[0, np.cumsum(count[r])[:-1]], count[r])
                meet.append(np.repeat(r, count[r]) * len(own) + order[first + np.arange(len(first))])
        if not meet:
            return
        r, item = np.divmod(np.unique(np.concatenate(meet)), len(own))
        by_item = np.argsort(item, kind="stable")
        for group in np.split(by_item, np.flatnonzero(np.diff(item[by_item])) + 1):
            i = own[item[group[0]]]
            allowed = edits_allowed(len(self.items[i]), self.similarity)
            at = r[group]
            d, length = distances(self.items[i], windows[at, : len(self.items[i]) + allowed])
            for j in np.flatnonzero(d <= allowed).tolist():
                t, first = of[at[j]].tolist()
                got = (int(d[j]), first, int(length[j]))
                best[t, i] = min(best.get((t, i), got), got)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded size; never all of a large benchmark at once."""
    block: list = []
    for row in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, edits, first_word, n_words) for each item that a document holds."""
    spark = docs.sparkSession
    schema = "doc_id bigint, text_hash bigint, item_id bigint, edits bigint, first_word bigint, n_words bigint"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Benchmark(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                texts, found = b.column(2).to_pylist(), []
                for at in range(0, len(texts), TEXTS):
                    found += ((at + t, items.id_of(i), *x) for t, i, *x in items.search(texts[at : at + TEXTS]))
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([x[j] for x in found], pa.int64()) for j in range(1, 5))], names=["doc_id", "text_hash", "item_id", "edits", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: every pair of a document and an item that it holds, with the edits between them."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item go; the rest stay as they are."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    found = found.select(F.col("doc_id").alias("_held"), "text_hash")
    t = unused(docs, "_t")
    rows = docs.withColumn(t, F.xxhash64(text_or_empty()))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_held"]) & (rows[t] == found["text_hash"]), "left_anti")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
