"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is coded byte by byte, then an end sign (0xFF, which UTF-8 never has; it also stands before the text). A byte is
eight binary decisions along its bits; each (context, bits so far) is a node that counts the zeros and ones that followed
it in training, for contexts of the last 0 to `DEPTH` bytes. Every node estimates by Krichevsky and Trofimov, and mixes
its own estimate with that of its longer context by the weights that context-tree weighting gives them: half and half
before training, then in proportion to how well each coded the training data. Contexts that training never met leave
the estimate to the longest one that it met. The sum over a text of log10 of the mixed estimates is its score; -score /
bytes * log2(10) is its code length per byte.

Counts of all (context, byte) grams come from all training documents. Their tree is weighted from its leaves up, then
estimates are mixed on the way down. Grams are dealt by three-byte contexts and read in order; a task holds the grams of
one four-byte context (at most 65,536, whatever the corpus) and the nodes of one three-byte context (255) beyond a fixed
number of rows. Nodes for three and two bytes are tables, those for one byte and none (65,280 and 255) are in the driver
and broadcast. The result is a table of log10 estimates of all grams of the corpus. Grams up to a bounded number, the most frequent
ones, are broadcast for scoring; what a document has besides is joined with the table by a shuffle, so every gram counts
whatever the table's size. Words of the base are treated likewise.

Defined cases: a null text is empty and has its end alone; a null doc_id counts as training; repeated rows count as
often as they stand; with nothing to train on, every decision has probability one half and c, N and V are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table, text_or_empty

DEPTH = 5
END = 0xFF
FOLDS, HELD_FOLD = 7, 2
#: The most frequent grams and words that are broadcast: at most so many (16 bytes, and a word's length, each).
HEAD_GRAMS, HEAD_WORDS = 1 << 21, 1 << 18
#: What a Python worker holds at a time: grams and words counted, grams of a part of the tree, and bytes of text (or one
#: text), of which each takes some 50 bytes of arrays.
HELD_ROWS, HELD_WORDS = 1_500_000, 1 << 18
GROUP_ROWS = 75_000
PART_BYTES = 1 << 19
LOG_HALF = float(np.log(0.5))
NODES = 256
#: How far a gram is shifted for the context of DEPTH - 2 bytes whose grams go to one task.
SHARED = 8 * (DEPTH - 2)
NODES_SCHEMA = "node bigint, zero double, one double, weight double, coded double"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(last byte, the one before it, ..., byte that follows) of each byte and end of all texts, and each text's first place."""
    lead = b"\xff" * DEPTH
    data = np.frombuffer(b"".join([x for t in texts for x in (lead, t, b"\xff")] + [lead]), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    n = len(data) - DEPTH
    key = data[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= data[DEPTH - k : DEPTH - k + n] << (8 * (DEPTH + 1 - k))
    own = np.ones(n, dtype=bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    for k in range(1, DEPTH + 1):
        own[starts[1:] - k] = False
    own[n - DEPTH :] = False
    return key[own], np.r_[0, np.cumsum(sizes)]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *((np.add.reduceat(v[order], first) if len(first) else v[:0]) for v in values)


def in_texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first, UTF-8 bytes) of runs of texts that end with the one that makes them more than PART_BYTES."""
    held, size, first = [], 0, 0
    for k, t in enumerate(column.cast(pa.binary())):
        held.append(t.as_py())
        size += len(held[-1])
        if size > PART_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, c) of the grams in a part of the documents; c counts in training ones. Columns: held_out, text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(g: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(g), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 100_000]), pa.array(c[i : i + 100_000])], names=["g", "c"])

    for b in batches:
        out_of = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for first, texts in in_texts(b.column(1)):
            key, at = grams(texts)
            train = np.repeat(~out_of[first : first + len(texts)], np.diff(at))
            for part, counts in ((key[train], True), (key[~train], False)):
                g, c = np.unique(part, return_counts=True)
                held.append((g, c * counts))
                size += len(g)
            if size > HELD_ROWS:
                g, c = summed(*(np.concatenate(x) for x in zip(*held)))
                held, size = [(g, c)], len(g)
                if size > HELD_ROWS // 2:
                    yield from out(g, c)
                    held, size = [], 0
    if held:
        yield from out(*summed(*(np.concatenate(x) for x in zip(*held))))
        held.clear()
    release()


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000], pa.binary()), pa.array(counts[i : i + 100_000], pa.int64())], names=["word", "c"])

    for b in batches:
        for _, texts in in_texts(b.column(0)):
            for t in texts:
                held.update(t.lower().split())
                if len(held) > HELD_WORDS:
                    yield from out()
                    held.clear()
    yield from out()
    held.clear()
    release()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: Stirling's series at x + 8, carried down."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    down = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each of the eight decisions its place in the tree of bits, and the bit."""
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1


def node_rows(node: np.ndarray, zero: np.ndarray, one: np.ndarray, longer: np.ndarray) -> pa.RecordBatch:
    """NODES_SCHEMA: nodes with the weight of their own estimate beside the longer contexts', and how well both coded."""
    own = log_kt(zero, one)
    weight = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zero, one, weight, LOG_HALF + np.logaddexp(own, longer))], names=["node", "zero", "one", "weight", "coded"])


class Subtrees:
    """The nodes for contexts of DEPTH and DEPTH - 1 bytes over grams of whole contexts of DEPTH - 1 bytes. Nodes that
    only held-out grams have are there with no counts, which leaves all sums as they are."""

    def __init__(self, g: np.ndarray, c: np.ndarray):
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        below = None
        for depth in (DEPTH, DEPTH - 1):
            context = g >> (8 * (DEPTH + 1 - depth))
            pair, n = summed(context << 8 | g & 255, c)
            keys, zeros, ones = [], [], []
            for place, bit in decisions(pair & 255):
                keys.append((pair >> 8) << 8 | place)
                zeros.append(n * (1 - bit))
                ones.append(n * bit)
            node, zero, one = summed(np.concatenate(keys), np.concatenate(zeros).astype(np.float64), np.concatenate(ones).astype(np.float64))
            own = log_kt(zero, one)
            if below is None:
                weight, coded = np.ones(len(node)), own
            else:
                children, codes = below
                at = np.searchsorted(node, (children >> 16) << 8 | children & 255)
                longer = np.bincount(at, weights=codes, minlength=len(node))
                weight = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
                coded = LOG_HALF + np.logaddexp(own, longer)
            self.levels[depth] = (node, zero, one, weight)
            below = (node, coded)
        self.top = below

    def for_shorter(self) -> tuple[np.ndarray, ...]:
        """(context of DEPTH - 2 bytes << 8 | place, zeros, ones, coded) summed over the longer contexts."""
        node, zero, one, _ = self.levels[DEPTH - 1]
        return summed((node >> 16) << 8 | node & 255, zero, one, self.top[1])

    def estimates(self, g: np.ndarray, node_3: np.ndarray, of_node: np.ndarray, short: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of each gram's probability. of_node: ones' and all counts, and weights, of the nodes node_3 for contexts of
        DEPTH - 2 bytes, then of those for DEPTH - 3; short: the same for contexts of 1 and 0 bytes."""
        out = np.zeros(len(g))
        ones_1, all_1, weight_1, ones_0, all_0, weight_0 = short
        for place, bit in decisions(g & 255):
            p, known = np.zeros(len(g)), np.zeros(len(g), dtype=bool)

            def mix(found, one, every, weight, p=p, known=known, bit=bit):
                own = np.where(bit == 1, one + 0.5, every - one + 0.5) / (every + 1)
                p[:] = np.where(found, np.where(known, weight * own + (1 - weight) * p, own), p)
                known |= found

            for depth in (DEPTH, DEPTH - 1):
                node, zero, one, weight = self.levels[depth]
                at = np.searchsorted(node, (g >> (8 * (DEPTH + 1 - depth))) << 8 | place)
                every = (zero + one)[at]
                mix(every > 0, one[at], every, weight[at])
            at = np.searchsorted(node_3, (g >> SHARED) << 8 | place)
            for one, every, weight in (of_node[:3], of_node[3:]):
                mix(every[at] > 0, one[at], every[at], weight[at])
            key = (g >> (8 * DEPTH)) << 8 | place
            mix(all_1[key] > 0, ones_1[key], all_1[key], weight_1[key])
            mix(np.ones(len(g), dtype=bool), ones_0[place], all_0[place], weight_0[place])
            out += np.log10(p)
        return out


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of their first column, together where they agree in it but for its last 16 bits, so at most 65,536
    grams beyond `least`."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size > least:
            b = pa.concat_batches(held)
            key = b.column(0).to_numpy() >> 16
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield b.slice(0, cut)
                b = b.slice(cut)
            held, size = [b], b.num_rows
    if size:
        yield pa.concat_batches(held)


def model(found: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(g, c, lp): log10 estimates of all grams; found: g, c, distinct."""
    spark = found.sparkSession
    grams_ = found.select("g", "c")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unfinished = (np.empty(0, np.int64), *(np.empty(0) for _ in range(3)))  # of the last context: at most 255
        for b in whole_groups(batches, group_rows):
            g = b.column(0).to_numpy()
            nodes = Subtrees(g, b.column(1).to_numpy()).for_shorter()
            nodes = summed(*(np.concatenate(x) for x in zip(unfinished, nodes)))
            last = nodes[0] >> 8 == g[-1] >> SHARED
            unfinished = tuple(x[last] for x in nodes)
            yield node_rows(*(x[~last] for x in nodes))
        yield node_rows(*unfinished)
        release()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield node_rows(*(x.to_numpy() for x in b.columns))

    def of_shorter(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy(shorter(F.col("node")).alias("node")).agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("coded").alias("longer"))

    def shorter(node):
        return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(255))

    nodes_3 = stored(grams_.repartition(F.shiftright("g", SHARED)).sortWithinPartitions("g").mapInArrow(up, NODES_SCHEMA), "lm-nodes")
    nodes_2 = stored(of_shorter(nodes_3).mapInArrow(weighed, NODES_SCHEMA), "lm-nodes")
    zero, one, longer = (np.zeros(256 * NODES) for _ in range(3))
    for node, *x in of_shorter(nodes_2).collect():  # at most 256 * 255
        zero[node], one[node], longer[node] = x
    own = log_kt(zero, one)
    coded = np.where(zero + one > 0, LOG_HALF + np.logaddexp(own, longer), 0).reshape(256, NODES)
    weight_1 = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    zero_0, one_0 = zero.reshape(256, NODES).sum(axis=0), one.reshape(256, NODES).sum(axis=0)
    weight_0 = 1 / (1 + np.exp(np.clip(coded.sum(axis=0) - log_kt(zero_0, one_0), -700, 700)))
    short = spark.sparkContext.broadcast((one, zero + one, weight_1, one_0, zero_0 + one_0, weight_0))

    # Nodes come before the grams of their context: k is the context, 0 for a node or 1 for a gram, and the rest in 24 bits.
    a, b = nodes_3.alias("a"), nodes_2.alias("b")
    numbers = [x for t in "ab" for x in (F.col(f"{t}.one"), F.col(f"{t}.zero") + F.col(f"{t}.one"), F.col(f"{t}.weight"))]
    node = F.col("a.node")
    nodes = a.join(b, shorter(node) == F.col("b.node")).select(
        F.shiftleft(F.shiftright(node, 8), 25).bitwiseOR(node.bitwiseAND(255)).alias("k"), F.lit(0).cast("long").alias("c"), F.array(*numbers).alias("v"))
    g = F.col("g")
    rows = grams_.select(
        F.shiftleft(F.shiftright(g, SHARED), 25).bitwiseOR(g.bitwiseAND(0xFFFFFF)).bitwiseOR(F.lit(1 << 24)).alias("k"), "c", F.lit(None).cast("array<double>").alias("v"))
    rows = rows.unionByName(nodes).repartition(F.shiftright("k", 25)).sortWithinPartitions("k")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, of_node = np.empty(0, np.int64), np.empty((6, 0))
        for b in whole_groups(batches, group_rows):
            k, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            is_gram = (k >> 24 & 1).astype(bool)
            new = k[~is_gram]
            node = np.r_[node, new >> 25 << 8 | new & 255]
            of_node = np.hstack([of_node, b.column(2).flatten().to_numpy().reshape(-1, 6).T])
            g, c = k[is_gram], c[is_gram]
            g = g >> 25 << SHARED | g & 0xFFFFFF
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(Subtrees(g, c).estimates(g, node, of_node, short.value))], names=["g", "c", "lp"])
            last = node >> 8 == k[-1] >> 25
            node, of_node = node[last], of_node[:, last]
        release()

    return stored(rows.mapInArrow(down, "g bigint, c bigint, lp double"), "lm-model")


class Lookup:
    """A hash table of numbers: what doesn't find its slot free goes to the next, smaller one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(2 * len(keys) - 1).bit_length())
            slot = self.slot(keys, bits, len(self.levels))
            slots, values_at = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits)
            slots[slot], values_at[slot] = keys, values
            values_at[slot] = values
            out = slots[slot] != keys
            values_at[slot[~out]] = values[~out]
            self.levels.append((bits, slots, values_at))
            keys, values = keys[out], values[out]

    @staticmethod
    def slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found?)"""
        out, found = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for level, (bits, slots, values) in enumerate(self.levels):
            slot = self.slot(keys[left], bits, level)
            hit = slots[slot] == keys[left]
            out[left[hit]] = values[slot[hit]]
            found[left[hit]] = True
            left = left[~hit]
            if not len(left):
                break
        return out, found


def most_frequent(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """The rows whose count c is so large that there are at most `rows` of them, and whether these are all."""
    by = {r[0]: r[1] for r in df.groupBy(F.log2(F.col("c") + 1).cast("int").alias("k")).count().collect()}  # at most 64
    least, n = 64, 0
    for k in range(63, -1, -1):
        if n + by.get(k, 0) > rows:
            break
        least, n = k, n + by.get(k, 0)
    return df.where(F.log2(F.col("c") + 1).cast("int") >= least), n == sum(by.values())


def scored(docs: DataFrame, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), text_or_empty().alias("text"))
    found = docs.select("held_out", "text").mapInArrow(counted_grams, "g bigint, c bigint")
    lp = model(stored(found.groupBy("g").agg(F.sum("c").alias("c")), "lm-grams"), group_rows)
    training = docs.where("not held_out")
    words = stored(training.select("text").mapInArrow(counted_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    ends = training.count()
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    some, all_grams = most_frequent(lp, head_grams)
    some = some.select("g", "lp").toArrow()
    frequent, all_words = most_frequent(words, head_words)
    frequent = frequent.toArrow()
    heads = spark.sparkContext.broadcast((Lookup(some["g"].to_numpy(), some["lp"].to_numpy()), dict(zip(frequent["word"].to_pylist(), np.log10(frequent["c"].to_numpy() + 1.0).tolist()))))
    log_all, log_end = float(np.log10(n + v + 1)), float(np.log10(ends + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, counts = heads.value
        for b in batches:
            for first, texts in in_texts(b.column(3)):
                key, at = grams(texts)
                values, hit = table_.find(key)
                sums = np.add.reduceat(values, at[:-1])
                lost, lost_n, rare, rare_n = [], [], [], []
                lacking = np.flatnonzero(np.add.reduceat(~hit, at[:-1])) if not all_grams else []
                of = dict.fromkeys(lacking)
                n_tokens, n_known, base = [], [], []
                for k, t in enumerate(texts):
                    w = t.lower().split()
                    c = list(map(counts.get, w))  # log10 of count + 1
                    missing, n_missing = {}, 0
                    if None in c:
                        missing = Counter([x for x, y in zip(w, c) if y is None])
                        c = [y for y in c if y is not None]
                        n_missing = len(w) - len(c)
                        if all_words:
                            missing = {}
                    n_tokens.append(len(w) + 1)
                    n_known.append(len(c) + (ends > 0))
                    of_all = len(w) + 1 if all_words else len(w) + 1 - n_missing
                    base.append(sum(c) + log_end - of_all * log_all)
                    rare.append(list(missing))
                    rare_n.append(list(missing.values()) if missing else [])
                    if k in of:
                        g, m = np.unique(key[at[k] : at[k + 1]][~hit[at[k] : at[k + 1]]], return_counts=True)
                        lost.append(g.tolist())
                        lost_n.append(m.tolist())
                    else:
                        lost.append([])
                        lost_n.append([])
                rows = [b.column(i).slice(first, len(texts)) for i in range(3)]
                numbers = pa.list_(pa.int64())
                rows += [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(sums), pa.array(lost, numbers), pa.array(lost_n, numbers), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, numbers)]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "held_out", "t", "n_tokens", "n_known", "base_score", "score", "lost", "lost_n", "rare", "rare_n"])
            release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "held_out", F.md5(F.col("text")).alias("t"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, t string, n_tokens bigint, n_known bigint, base_score double, score double, lost array<bigint>, lost_n array<bigint>, rare array<binary>, rare_n array<bigint>")
    if not (all_grams and all_words):
        rows = stored(rows, "lm-rows")

        def besides(items: str, counts: str) -> DataFrame:
            """(t, item, n) of each text, once for all its copies."""
            each = rows.where(F.size(items) > 0).select("t", F.explode(F.arrays_zip(F.col(items).alias("item"), F.col(counts).alias("n"))).alias("e"))
            return each.groupBy("t", F.col("e.item").alias("item")).agg(F.max("e.n").alias("n"))

        more = besides("lost", "lost_n").join(lp.select(F.col("g").alias("item"), "lp"), "item").groupBy("t").agg(F.sum(F.col("n") * F.col("lp")).alias("more_score"))
        c = F.coalesce(F.col("c"), F.lit(0))
        rare = besides("rare", "rare_n").join(words.select(F.col("word").alias("item"), "c"), "item", "left").groupBy("t").agg(
            F.sum(F.col("n") * (F.log10(c + 1.0) - log_all)).alias("more_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
        rows = rows.join(more, "t", "left").join(rare, "t", "left")
        rows = rows.withColumns({x: F.col(x) + F.coalesce(F.col(y), F.lit(0)) for x, y in (("n_known", "more_known"), ("base_score", "more_base"), ("score", "more_score"))})
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: every document's base and model score."""
    return scored(table(spark, sf_dir, "documents"))
