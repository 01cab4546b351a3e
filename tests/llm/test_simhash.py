import random

import numpy as np
import xxhash

from notequarry.llm import simhash

from .helpers import documents, odd_rows


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_anchors_meet_for_every_near_pair():
    random.seed(4)
    for _ in range(400):
        x = random.getrandbits(64)
        y = x
        for b in random.sample(range(64), random.randint(1, 2)):
            y ^= 1 << b
        a, b = (set(simhash.anchors(np.array([v], dtype=np.uint64))[1].tolist()) for v in (x, y))
        assert a & b and len(a) <= 33
    codeword = simhash.anchors(np.array([0, 1], dtype=np.uint64))
    assert len(codeword[0]) == 4


def test_forest_connects_what_links_connect():
    random.seed(3)
    for _ in range(50):
        base = random.getrandbits(64)
        x = np.array(sorted({base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(60)}), dtype=np.uint64)
        links = simhash.forest(x)
        near = {i: {j for j in range(len(x)) if bin(int(x[i]) ^ int(x[j])).count("1") <= 2} for i in range(len(x))}
        assert all(j in near[i] for i, j in links)
        assert classes(range(len(x)), links) == classes(range(len(x)), [(i, j) for i in near for j in near[i]])


def classes(nodes, links):
    of = {v: v for v in nodes}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in links:
        of[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in of}


def grouped(rows):
    prints = [brute_print(t) for _, t in rows]
    return prints, classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])


def expected(rows):
    prints, of = grouped(rows)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[of[k]] = min(least.get(of[k], doc), doc)
    return sorted(((doc is None, doc or 0), f"{p:016x}", least.get(of[k]) is None, least.get(of[k]) or 0) for k, ((doc, _), p) in enumerate(zip(rows, prints)))


def got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"] is None, r["component_id"] or 0) for r in df.collect())


def near_copies():
    """A chain of texts, each one word from the next, and copies."""
    r = random.Random(8)
    words, rows = [f"w{r.randrange(40)}" for _ in range(400)], []
    for i in range(40):
        words[r.randrange(400)] = f"w{r.randrange(40)}"
        rows.append((500 - i, " ".join(words)))
    return rows + [(700 + i, rows[3][1]) for i in range(30)]


def test_components_against_brute_force(spark, tmp_path):
    for rows in (odd_rows(), near_copies(), []):
        documents(spark, rows).write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        assert got(simhash.simhash_near_dedup(spark, f"{tmp_path}/{len(rows)}")) == expected(rows)


def test_stage_keeps_one_of_each_group(spark):
    for rows in (odd_rows(), near_copies()):
        docs = documents(spark, rows)
        out = simhash.first_of_each(spark, docs, "")
        assert out.columns == docs.columns
        kept = out.collect()
        wanted = {(e[2], e[3], e[1] if e[2] else "") for e in expected(rows)}
        assert len(kept) == len(set(grouped(rows)[1].values()))  # two texts may share an id, and so a group's name
        assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {c for null, c, _ in wanted if not null}
        assert all(r["_t"] == "clash" for r in kept)
