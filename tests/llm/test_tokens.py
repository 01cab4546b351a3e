import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from notequarry.llm import packing, token_files, tokens

from .helpers import documents, odd_rows, prose

TRICKY = ["a\n b", "a \nb", "a   b", " a", "a ", "", "  ", "a  b c\n", " x\n", "it's we'll 's", " 5a 6.7, (x) -- y", "don't  x\n\n y <|endoftext|> z", "日本 text ünï", "a\x85b \x1c c", "a., b.. c,, é, ñ. ×, «. a1, -. . , a\n, b .\n.", "\nab c", "ab\ncd e", "é\né. x÷, y", "\1 \1a", "a" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def encoded(library, texts, end):
    return [np.array([*e.ids, end], dtype="<u4") for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("cache", [10, 100_000])
def test_encoder_equals_the_library(library, cache):
    encoder = tokens.Encoder(tokens.vocabulary_path(), cache)
    texts = TRICKY + [prose(i, 300) for i in range(10)] + ["\n".join(prose(i, 8) for i in range(20)), *TRICKY[::-1]]
    for k in range(3):
        ids, at = encoder.encode(pa.array(texts[k:]))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts) - k)] == [e.ids for e in library.encode_batch(texts[k:], add_special_tokens=False)]
    for one in ([], [""], ["日本"]):
        assert encoder.encode(pa.array(one, pa.string()))[0].tolist() == [i for e in library.encode_batch(one, add_special_tokens=False) for i in e.ids]


def test_the_library_gets_bounded_calls(library):
    """as many new words as a part has, or texts beyond Latin, went to the library in one call before."""
    class Counting:
        calls = []

        def encode_batch_fast(self, texts, **k):
            self.calls.append((len(texts), sum(map(len, texts)), max(len(t.split()) for t in texts)))
            return library.encode_batch_fast(texts, **k)

    encoder = tokens.Encoder(tokens.vocabulary_path())
    encoder.tokenizer = Counting()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["x" + letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576] for i in range(40_000)]
    texts = [" ".join(words), *("日本 " + prose(i, 3000) for i in range(40)), " ".join(w + "5," for w in words)]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    longest = max(map(len, texts[1:-1]))
    assert all(n <= 1 << 14 and size <= (1 << 18) + longest and own <= 1 << 14 for n, size, own in Counting.calls)


def test_parts():
    texts = pa.array(["a" * 10] * 7 + ["b" * 50, "c"])
    assert [(a, len(t)) for a, t in tokens.in_parts(texts, 30)] == [(0, 3), (3, 3), (6, 1), (7, 1), (8, 1)]


def test_shards_give_any_id():
    r = np.random.default_rng(1)
    ids = [r.integers(0, (3, 300, 70_000, 2**32 - 1)[k % 4], size=3000 + k, dtype=np.uint32) for k in range(8)] + [np.empty(0, np.uint32)]
    shard = token_files.Shard(token_files.pack([None, *range(8)], ids))
    whole = np.concatenate(ids)
    assert shard.doc_ids == [None, *range(8)] and (shard.all() == whole).all() and (shard.at(np.arange(len(whole))) == whole).all()
    places = r.integers(0, len(whole), size=50)
    assert (shard.at(places) == whole[places]).all() and all((shard.document(i) == x).all() for i, x in enumerate(ids))
    assert token_files.Shard(token_files.pack([], [])).n_ids == 0
    with pytest.raises(ValueError):
        token_files.Shard(b"nope" + bytes(60))


def test_files_round_trip(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    rows = odd_rows() + [(900 + k, t) for k, t in enumerate(TRICKY)]
    documents(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = token_files.token_ids(spark, str(tmp_path)).collect()
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, at = [], 0
    for (doc, _), ids in zip(in_order, encoded(library, [t or "" for _, t in in_order], 2)):
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expected
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_files.token_ids(spark, f"{tmp_path}/none").count() == 0


def checked(rows, out, library, length=2048):
    pieces = Counter()
    for (doc, t), ids in zip(rows, encoded(library, [t or "" for _, t in rows], 1)):
        for a in range(0, len(ids), length):
            pieces[doc, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == pieces
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= length
    return sum(n for own in by.values() for _, n in own) / (length * max(1, len(by)))


def test_packing_places_every_id_once(spark, library):
    rows = odd_rows() + [(1000 + i, prose(i, 30 + 7 * i)) for i in range(150)]
    out = packing.packed(documents(spark, rows).repartition(4)).collect()
    assert checked(rows, out, library) > 0.9
    same = [(i, prose(1, 100)) for i in range(60)]
    checked(same, packing.packed(documents(spark, same)).collect(), library)
    assert packing.packed(documents(spark, [])).count() == 0


def test_plans_use_up_the_histogram():
    r = np.random.default_rng(2)
    for counts in ({}, {256: 3}, {1: 1000}, {255: 7, 1: 3}, dict(Counter(r.integers(1, 257, 5000).tolist())), {200: 50, 57: 10, 56: 41, 3: 9}):
        plan = packing.plan(counts)
        used = Counter()
        for bins, n in plan:
            assert sum(bins) <= 256 and n > 0
            for b in bins:
                used[b] += n
        assert used == Counter(counts)
    full = packing.plan({128: 1000, 64: 2000, 100: 500, 156: 500})
    assert sum(n for _, n in full) == 1000 // 2 + 2000 // 4 + 500


def test_combinations_and_least_squares():
    assert set(packing.combinations(6)) == {(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)}
    r = np.random.default_rng(3)
    for _ in range(20):
        a, x = r.random((8, 15)), np.maximum(r.normal(size=15), 0)
        x[r.permutation(15)[:9]] = 0
        found = packing.nnls(a, a @ x)
        assert (found >= 0).all() and np.linalg.norm(a @ found - a @ x) < 1e-6
