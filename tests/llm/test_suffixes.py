import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from notequarry.llm import suffixes

from .helpers import documents, odd_rows, prose


def brute(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc is None, doc or 0, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in df.collect())


def shared_passages():
    a, b = prose(50, 45)[:260], prose(51, 60)[:420]
    rows = [(i, prose(60 + i, 20) + a + prose(90 + i, 20)) for i in range(25)]
    rows += [(100 + i, b[i : i + 230] + prose(200 + i, 30)) for i in range(0, 190, 13)]
    rows += [(400, "z" * 1000), (401, "ab" * 300), (402, a[:199]), (403, "q" + a[:199]), (404, "é" * 150), (405, "x" + "é" * 120), (406, "\0" * 250)]
    return rows


def test_suffixes_are_in_order_and_repeats_found():
    random.seed(1)
    for _ in range(200):
        parts = [bytes(random.choice(b"ab\0c") for _ in range(random.randint(6, 30))) for _ in range(random.randint(1, 6))]
        starts = [len(x) - 4 for x in parts]
        _, order, owner = suffixes.sorted_suffixes(parts, starts)
        base = [sum(len(x) + 1 for x in parts[:k]) for k in range(len(parts))]
        found = [parts[owner[i]][i - base[owner[i]] :] for i in order]
        assert found == sorted(found)
        often = Counter(x[i : i + 5] for x, n in zip(parts, starts) for i in range(n))
        for x, n, hit in zip(parts, starts, suffixes.repeated(parts, starts, 5)):
            assert list(hit) == [i for i in range(n) if often[x[i : i + 5]] > 1]


def test_windows_cover_all_starts_and_depend_on_content():
    data = prose(7, 900).encode()
    first, count, anchors, whole = suffixes.windows(data)
    assert list(first) == [0, *(first + count)[:-1]] and first[-1] + count[-1] == len(data) - 199
    more = suffixes.windows(b"before " + data)
    assert set(whole.tolist()[1:-1]) <= set(more[3].tolist()) and set(anchors.tolist()[1:-1]) <= set(more[2].tolist())
    assert all(len(x) == 0 for x in suffixes.windows(b"short"))


def test_against_brute_force(spark, tmp_path):
    for k, rows in enumerate((odd_rows(), shared_passages(), [])):
        documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert got(suffixes.suffix_dedup(spark, f"{tmp_path}/{k}")) == brute(rows)


def test_texts_of_one_id_are_told_apart_where_16_bits_of_their_hashes_agree(spark):
    shared, seen, rows = prose(52, 50)[:300], {}, []
    for i in range(3000):
        # Each text holds the passage at another place.
        text = prose(5000 + i, 10)[: i % 37 + 5] + str(i) + shared + prose(9000 + i, 45)
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), 42) & 65535, text)
        if other != text:
            rows += [(None if len(rows) // 2 % 2 else 7, x) for x in (text, other)]
    rows = rows[:40]
    assert len(rows) == 40 and got(suffixes.deduplicated(documents(spark, rows))) == brute(rows)


def test_many_rows_without_or_with_equal_ids(spark):
    """2,000 rows without id and 200 of one id, all with different texts; one in ten holds the passage."""
    shared = prose(53, 50)[:300]
    rows = [(None if i < 2000 else 7, prose(20_000 + i, 30 + i % 9) + (shared if i % 10 == 0 else "") + prose(40_000 + i, 12)) for i in range(2200)]
    rows += rows[:3]
    assert got(suffixes.deduplicated(documents(spark, rows))) == brute(rows)


def test_windows_that_stand_for_several_are_marked_by_the_sorter():
    a, b = prose(54, 50).encode()[:230], prose(55, 50).encode()[:240]
    found = suffixes.repeated([a, b, b[3:]], [31, 41, 38], 200, None, [2, 1, 1])
    assert [x.tolist() for x in found] == [list(range(31)), list(range(3, 41)), list(range(38))]


def test_split_groups_and_segments_change_nothing(spark, monkeypatch):
    rows = shared_passages()
    monkeypatch.setattr(suffixes, "SPLIT", 3)
    monkeypatch.setattr(suffixes, "LEAST_OFTEN", 2)
    assert got(suffixes.deduplicated(documents(spark, rows))) == brute(rows)


def test_a_string_in_many_surroundings_is_settled_in_parts(spark, monkeypatch):
    """The passage is barely longer than a string, and each document puts it between other words: its group would hold all."""
    shared = [prose(56, 50)[:205], prose(57, 50)[:200]]
    rows = [(i, prose(30_000 + i, 12) + " " + (shared[0] if i % 4 else shared[1]) + prose(50_000 + i, 12)) for i in range(120)]
    rows += [(200, rows[0][1]), (201, prose(58, 50)), (202, shared[1][1:])]
    for name, value in (("SPLIT", 10), ("MOST", 20), ("LEAST_OFTEN", 2)):
        monkeypatch.setattr(suffixes, name, value)
    passes = []
    small_groups = suffixes.small_groups
    monkeypatch.setattr(suffixes, "small_groups", lambda rows: passes.append((rows, *small_groups(rows))) or passes[-1][1:])
    assert got(suffixes.deduplicated(documents(spark, rows))) == brute(rows)
    (before, after, settled), = passes

    def holding(df, string):
        return df.where(F.contains("data", F.lit(string.encode()))).groupBy("h", "g").count().agg(F.max("count")).first()[0] or 0

    # A string of a passage is in 30 or 90 windows of its group; few of them are left to one task.
    assert settled
    for string in (shared[0][:200], shared[0][3:203], shared[1]):
        assert holding(before, string) >= 30 and holding(after, string) <= 12


def test_parts_keep_one_row_of_each_string():
    a, b = prose(59, 50).encode()[:201], prose(60, 50).encode()[:200]
    marks, kept = suffixes.compared([a, a[:200], b, a[1:]], [2, 1, 1, 1], 200, None, None)
    assert [x.tolist() for x in marks] == [[0, 1], [0], [], [0]]
    strings = [x[i : i + 200] for x, starts in zip([a, a[:200], b, a[1:]], kept) for i in starts]
    assert sorted(strings) == sorted({a[:200], a[1:], b})
