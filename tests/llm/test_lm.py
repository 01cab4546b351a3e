import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notequarry.llm import lm

from .helpers import documents, odd_rows, prose


class Tree:
    """Context-tree weighting by the book, with a node for each context and place in the tree of bits."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])

    def steps(self, data):
        history = b"\xff" * self.depth
        for byte in [*data, 0xFF]:
            place = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield [(history[len(history) - d :], place) for d in range(self.depth + 1)], bit
                place = place * 2 + bit
            history = history[1:] + bytes([byte])

    def learn(self, data):
        for path, bit in self.steps(data):
            for node in path:
                self.counts[node][bit] += 1

    def finish(self):
        below = defaultdict(float)
        self.weight = {}
        for depth in range(self.depth, -1, -1):
            for (context, place), (a, b) in [x for x in self.counts.items() if len(x[0][0]) == depth]:
                own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                coded = own
                if depth < self.depth:
                    longer = below[context, place]
                    self.weight[context, place] = 1 / (1 + math.exp(min(longer - own, 700)))
                    coded = math.log(0.5) + max(own, longer) + math.log1p(math.exp(-abs(own - longer)))
                if depth:
                    below[context[1:], place] += coded

    def score(self, data):
        out = 0.0
        for path, bit in self.steps(data):
            p = None
            for node in reversed(path):
                if node in self.counts or not node[0]:
                    a, b = self.counts[node] if node in self.counts else (0, 0)
                    own = ((b if bit else a) + 0.5) / (a + b + 1)
                    p = own if p is None else self.weight[node] * own + (1 - self.weight[node]) * p
            out += math.log10(p)
        return out


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def expected(rows):
    tree, words, ends = Tree(lm.DEPTH), Counter(), 0
    for doc, t in rows:
        if not held_out(doc):
            tree.learn((t or "").encode())
            words.update((t or "").encode().lower().split())
            ends += 1
    tree.finish()
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for doc, t in rows:
        counts = [words[w] for w in (t or "").encode().lower().split()] + [ends]
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in counts)
        out.append(((doc is None, doc or 0, held_out(doc), len(counts), sum(c > 0 for c in counts), n), base, tree.score((t or "").encode())))
    return sorted(out)


ROWS = [r for r in odd_rows() if r[0] != 8] + [(100 + i, prose(i, 40)) for i in range(15)]


@pytest.mark.parametrize("grams, words, group_rows", [(1 << 21, 1 << 18, 150_000), (300, 20, 40), (0, 0, 0)])
def test_scores_against_the_book(spark, grams, words, group_rows):
    for rows in (ROWS, [(9, "a b")], [(i, "x y z") for i in range(40) if held_out(i)]):
        got = lm.scored(documents(spark, rows).repartition(3), grams, words, group_rows).collect()
        found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"]) for r in got)
        for a, b in zip(found, expected(rows), strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9)


def test_empty_table(spark):
    assert lm.scored(documents(spark, [])).count() == 0


def test_groups_stay_whole_and_bounded():
    k = np.sort(np.random.default_rng(2).integers(0, 1 << 22, 20_000))
    rows = pa.RecordBatch.from_arrays([pa.array(k)], names=["k"])
    parts = [p.column(0).to_numpy() for p in lm.whole_groups((rows.slice(i, 70) for i in range(0, len(k), 70)), 300)]
    assert np.concatenate(parts).tolist() == k.tolist()
    assert all(a[-1] >> 16 < b[0] >> 16 for a, b in zip(parts, parts[1:]))
    assert max(map(len, parts)) <= 300 + 70 + np.bincount(k >> 16).max()


def test_grams_and_lookups():
    texts = [b"abc", b"", "é".encode() * 3]
    keys, at = lm.grams(texts)
    assert list(at) == [0, 4, 5, 12]
    for k, t in enumerate(texts):
        data = b"\xff" * lm.DEPTH + t + b"\xff"
        assert keys[at[k] : at[k + 1]].tolist() == [int.from_bytes(data[i - lm.DEPTH : i][::-1] + data[i : i + 1], "big") for i in range(lm.DEPTH, len(data))]
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 47, 5000))
    values = r.random(len(keys))
    found, hit = lm.Lookup(keys, values).find(np.r_[keys, keys + 1])
    assert hit[: len(keys)].all() and (found[: len(keys)] == values).all()
    assert (hit[len(keys) :] == np.isin(keys + 1, keys)).all()


def test_a_worker_holds_little_beside_the_tables():
    """these texts took 140 MB of arrays and strings at once before."""
    texts = ["é" + prose(i, 20_000) for i in range(100)]
    column = pa.array(texts)
    table = lm.Lookup(np.arange(1000), np.ones(1000))
    tracemalloc.start()
    try:
        seen = []
        for first, part in lm.in_texts(column):
            assert first == len(seen)
            seen += [hash(t) for t in part]
            table.find(lm.grams(part)[0])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == [hash(t.encode()) for t in texts]
    assert peak < 80e6


def test_words_are_counted_in_bounded_parts():
    """a million distinct words were held before any went out."""
    texts = [" ".join(f"W{i}" for i in range(k, k + 3000)) for k in range(0, 400_000, 2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20])], names=["text"]) for i in range(0, len(texts), 20)]
    out = list(lm.counted_words(iter(batches)))
    found = Counter()
    for b in out:
        found.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert found == Counter(w.lower().encode() for t in texts for w in t.split())
    assert sum(b.num_rows for b in out[:3]) <= 265_000 < sum(b.num_rows for b in out)


def test_longer_training_codes_held_out_text_better(spark):
    def bits(n):
        rows = [(i, prose(i, 60)) for i in range(n) if not held_out(i)] + [(i, prose(i, 60)) for i in range(1000, 1100) if held_out(i)]
        out = [r for r in lm.scored(documents(spark, rows)).collect() if r["held_out"]]
        size = sum(len(t) + 1 for i, t in rows if held_out(i))
        return -sum(r["score"] for r in out) * math.log2(10) / size

    few, many = bits(10), bits(200)
    assert many < few < 8 and many < 3
