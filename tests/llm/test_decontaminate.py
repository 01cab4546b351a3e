import random

import numpy as np

from notequarry.llm import decontaminate as d

from .helpers import documents, odd_rows, prose, saved

ITEMS = [(i, prose(400 + i, 16 + 3 * i)) for i in range(14)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distances_are_exact():
    r = np.random.default_rng(1)
    for _ in range(60):
        item, rows = r.integers(1, 5, size=7).astype(np.int32), r.integers(1, 5, size=(4, 10)).astype(np.int32)
        found, length = d.distances(item, rows)
        for k in range(4):
            every = [edit_distance(item.tolist(), rows[k, :n].tolist()) for n in range(11)]
            assert found[k] == min(every) and every[length[k]] == min(every)


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        j, how = r.randrange(len(words)), r.random()
        if how < 0.4:
            words[j] = "zz%d" % r.randrange(9)
        elif how < 0.7:
            del words[j]
        else:
            words.insert(j, "qq")
    return words


def test_recall_against_exact_search():
    r = random.Random(7)
    benchmark, hit, total = d.Benchmark(ITEMS), 0, 0
    for t in range(250):
        i = r.randrange(len(ITEMS))
        item = benchmark.items[i]
        k = d.edits_allowed(len(item))
        host = prose(t, 120).split()
        at = r.randrange(len(host))
        text = " ".join(host[:at] + edited(ITEMS[i][1].split(), r.randint(0, k), r) + host[at:])
        w, _ = benchmark.places(text)
        padded = np.concatenate([w, np.full(len(item) + k + 1, -1, dtype=np.int32)])
        exact = d.distances(item, padded[np.arange(len(w))[:, None] + np.arange(len(item) + k)])[0].min()
        if exact <= k:
            total += 1
            found = [x for x in benchmark.search([text]) if x[1] == i]
            hit += bool(found)
            assert not found or exact <= found[0][2] <= k
        else:
            assert not [x for x in benchmark.search([text]) if x[1] == i]
    assert total > 150 and hit / total >= 0.99


def most_edited(words, k, how, r):
    """Exactly k edits of one sort, or of all."""
    words = list(words)
    if how == "block":
        at = r.randrange(1, len(words) - k)
        return words[:at] + words[at + k :]
    places = sorted(r.sample(range(1, len(words)), k), reverse=True)
    for e, j in enumerate(places):
        kind = ("insert", "delete", "change")[e % 3] if how == "mixed" else how
        words[j : j + (kind != "insert")] = [] if kind == "delete" else ["zz%d" % r.randrange(9)]
    return words


def test_every_leak_is_found_at_exactly_the_allowed_edits():
    r = random.Random(11)
    words = ["w%d" % i for i in range(5000)]
    for n, times in ((5, 30), (10, 30), (50, 30), (100, 20), (200, 12), (400, 6)):
        items = [(i, " ".join(r.choices(words, k=n + i % 2))) for i in range(4)]
        benchmark = d.Benchmark(items)
        for how in ("insert", "delete", "change", "block", "mixed"):
            for _ in range(times):
                i = r.randrange(4)
                k = d.edits_allowed(len(benchmark.items[i]))
                host = r.choices(words, k=60)
                text = " ".join(host[:30] + most_edited(items[i][1].split(), k, how, r) + host[30:])
                (found,) = benchmark.search([text])
                assert found[1] == i and found[2] <= k, (n, how)


def test_best_place_is_that_of_exhaustive_search():
    r, few = random.Random(3), "a b c d e f".split()
    for _ in range(150):
        items = [(i, " ".join(r.choices(few, k=r.randint(5, 12)))) for i in range(6)]
        text = r.choices([*few, "x"], k=40)
        benchmark, expected = d.Benchmark(items), []
        for i, (_, item) in enumerate(items):
            k = d.edits_allowed(len(item.split()))
            every = min((edit_distance(item.split(), text[a:e]), a, e - a) for a in range(40) for e in range(a, min(40, a + len(item.split()) + k) + 1))
            expected += [(0, i, *every)] if every[0] <= k else []
        assert benchmark.search([" ".join(text)]) == expected


def test_texts_with_many_pairs_are_searched_in_pieces(monkeypatch):
    text = "q " * 40 + ITEMS[9][1] + " q" * 150 + " " + ITEMS[9][1].replace(" ", " q ", 3)
    whole = d.Benchmark(ITEMS).regions(d.Benchmark(ITEMS).places(text)[0])
    monkeypatch.setattr(d, "PAIRS", 2)
    assert d.Benchmark(ITEMS).regions(d.Benchmark(ITEMS).places(text)[0]) == whole and len(whole[9]) == 2


def test_query_and_stage(spark, tmp_path):
    r = random.Random(2)
    leak = " ".join(edited(ITEMS[9][1].split(), 3, r)).upper()
    rows = odd_rows() + [(50, prose(1, 40) + " " + leak), (51, ITEMS[3][1]), (51, ITEMS[3][1]), (None, ITEMS[4][1] + " and " + ITEMS[5][1]), (52, " ".join(ITEMS[7][1].split()[: len(ITEMS[7][1].split()) // 2]))]
    items = [*ITEMS, (100, None), (101, ""), (102, "two words"), (3, ITEMS[3][1])]
    at = saved(spark, tmp_path, documents=documents(spark, rows), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    found = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["item_id"], x["edits"]) for x in d.benchmark_decontamination(spark, at).collect()))
    assert [x[:3] for x in found] == [(False, 50, 9), (False, 51, 3), (False, 51, 3), (False, 51, 3), (False, 51, 3), (True, 0, 4), (True, 0, 5)]
    assert 0 < found[0][3] <= 3 and not any(x[3] for x in found[1:])
    docs = documents(spark, rows)
    out = d.without_leaks(spark, docs, at)
    assert out.columns == docs.columns
    gone = {len(rows) - k for k in (2, 3, 4, 5)}
    assert {x["_id"] for x in out.collect()} == set(range(len(rows))) - gone
    none = saved(spark, tmp_path / "none", documents=documents(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert d.benchmark_decontamination(spark, none).count() == 0 and d.without_leaks(spark, docs, none).count() == len(rows)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 4)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(i, t) for i, t in ITEMS])
    assert sorted((x["doc_id"], x["item_id"]) for x in d.leaks(docs, benchmark).collect()) == [(i, i) for i, _ in ITEMS]


def test_recall_at_all_allowed_edits_by_size():
    """Planted items with exactly as many insertions, deletions, changes or dropped blocks as allowed, 5 to 800 words long."""
    r = random.Random(11)
    for size in (5, 15, 60, 200, 400, 800):
        item = prose(7000 + size, size)
        benchmark, k = d.Benchmark([(1, item), (2, prose(77, 30))]), d.edits_allowed(size)
        for how in ("mixed", "delete", "insert", "block"):
            for trial in range(3):
                w = item.split()
                if how == "mixed":
                    w = edited(w, k, r)
                elif how == "delete":
                    for _ in range(k):
                        del w[r.randrange(len(w))]
                elif how == "insert":
                    for _ in range(k):
                        w.insert(r.randrange(len(w)), "qq")
                else:
                    at = r.randrange(len(w) - k)
                    del w[at : at + k]
                text = " ".join([prose(trial, 40), *w, prose(trial + 9, 40)])
                assert [x[1] for x in benchmark.search([text])] == [0], (size, how)


def test_short_items_and_scripts_without_blanks():
    items = [(1, "one"), (2, "Two words!"), (3, "three of them"), (4, "four of them here"), (5, "日本語の試験問題です"), (6, "東京"), (7, "..."), (None, "one")]
    benchmark = d.Benchmark(items)
    found = benchmark.search(["ONE more", "these two, words", "three of the", "that is four of them here, three of them", "これは日本語の試験間題です。", "東 京 and 京東", "", "onemore"])
    assert [(t, benchmark.id_of(i), n, at, w) for t, i, n, at, w in found] == [
        (0, 1, 0, 0, 1), (0, None, 0, 0, 1), (1, 2, 0, 1, 2), (3, 3, 0, 6, 3), (3, 4, 0, 2, 4), (4, 5, 1, 3, 10), (5, 6, 0, 0, 2),
    ]
