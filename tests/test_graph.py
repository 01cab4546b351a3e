import numpy as np
import pytest

from notequarry.operators import community, graph

CHAIN = [(1, "Python", "language"), (2, "PostgreSQL", "database"), (3, "SQLAlchemy", "library"), (4, "Docker", "tool")]
CHAIN_EDGES = [(1, 3, "uses", 0.9), (3, 2, "connects", 0.8), (1, 4, "runs_in", 0.7)]
MAP = [(10, "Python", "language"), (11, "Rust", "language"), (12, "PostgreSQL", "database"), (13, "Docker", "tool"), (14, "SQLAlchemy", "library"), (15, "Actix", "library"), (16, "Tokio", "library"), (20, "_root", "root"), (21, "_system", "system")]
MAP_EDGES = [(10, 14, "uses", 0.9), (14, 12, "connects", 0.8), (10, 13, "runs_in", 0.7), (11, 15, "uses", 0.6), (11, 16, "depends", 0.9), (15, 16, "depends", 0.8), (10, 11, "similar", 0.4), (20, 10, "contains", 1.0), (20, 11, "contains", 1.0), (21, 20, "links", 1.0)]


def nodes(spark, rows):
    return spark.createDataFrame([(i, f"node:{label}", label, kind, None) for i, label, kind in rows], "id long, key string, label string, type string, metadata string")


def edges(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "source_id long, target_id long, type string, weight double, context string")


def test_expansion_reaches_one_hop_more_than_its_depth(spark):
    n, e = nodes(spark, CHAIN), edges(spark, CHAIN_EDGES)
    found = {r["label"]: r["distance"] for r in graph.expand_neighbors(n, e, 1, 1).collect()}
    assert found == {"SQLAlchemy": 0, "Docker": 0, "PostgreSQL": 1}
    assert graph.expand_neighbors(n, e, 1, 0).count() == 0
    assert {r["label"] for r in graph.expand_neighbors(n, e, 1, 2, min_weight=0.8).collect()} == {"SQLAlchemy", "PostgreSQL"}


def test_expansion_of_random_multigraphs(spark):
    import random

    random.seed(5)
    links = [(random.randrange(30), random.randrange(30), "x", random.random()) for _ in range(45)]
    n, e = nodes(spark, [(i, f"n{i}", "t") for i in range(30)]), edges(spark, links)
    near = {i: {b for a, b, *_ in links if a == i} | {a for a, b, *_ in links if b == i} for i in range(30)}
    for depth in (1, 2, 4):
        level, seen = {0: -1}, {0}
        frontier = {0}
        for hop in range(depth + 1):
            frontier = {x for v in frontier for x in near[v]} - seen
            seen |= frontier
            level |= dict.fromkeys(frontier, hop)
        level.pop(0)
        expected = sorted((d, "t", i) for i, d in level.items())[:20]
        assert [(r["distance"], r["type"], r["id"]) for r in graph.expand_neighbors(n, e, 0, depth).collect()] == expected


def test_shortest_path(spark):
    n, e = nodes(spark, CHAIN), edges(spark, CHAIN_EDGES)
    assert graph.shortest_path(n, e, "Python", "PostgreSQL", 5) == ["Python", "SQLAlchemy", "PostgreSQL"]
    assert graph.shortest_path(n, e, "Docker", "PostgreSQL") == ["Docker", "Python", "SQLAlchemy", "PostgreSQL"]
    assert graph.shortest_path(n, e, "Docker", "PostgreSQL", 2) is None
    assert graph.shortest_path(n, e, "Docker", "Docker") == ["Docker"]
    with pytest.raises(ValueError, match="Nowhere"):
        graph.shortest_path(n, e, "Nowhere", "Docker")


def test_subgraph(spark):
    n, e = nodes(spark, MAP), edges(spark, MAP_EDGES)

    def sizes(*args):
        a, b = graph.subgraph(n, e, *args)
        return a.count(), b.count()

    assert sizes() == (7, 7)
    assert sizes("Python", 2)[0] == 7
    assert {r["label"] for r in graph.subgraph(n, e, "Python", 1)[0].collect()} == {"Python", "SQLAlchemy", "Docker", "Rust"}
    assert sizes("Python", 0) == (1, 0)
    with pytest.raises(ValueError, match="Nobody"):
        graph.subgraph(n, e, "Nobody", 1)
    assert graph.subgraph(nodes(spark, []), edges(spark, []))[0].count() == 0


def test_labels_prefer_keys_then_low_ids(spark):
    rows = [(1, "note:a/dup.md", "Dup", "note", None), (2, "note:b/dup.md", "Dup", "note", None), (3, "node:Entity", "Entity", "concept", None)]
    n = spark.createDataFrame(rows, "id long, key string, label string, type string, metadata string")
    e = edges(spark, [(2, 3, "mentions", 1.0)])
    assert [r["label"] for r in graph.graph_only(n, e, "note:b/dup.md", 1).collect()] == ["Entity"]
    assert graph.graph_only(n, e, "Dup", 1).count() == 0


def test_components_and_degrees(spark):
    e = edges(spark, [(1, 2, "x", 1.0), (2, 3, "x", 1.0), (3, 4, "x", 1.0), (9, 8, "x", 1.0), (7, 7, "x", 1.0), *[(100 + i, 101 + i, "x", 1.0) for i in range(30)]])
    found = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert {found[i] for i in (1, 2, 3, 4)} == {1} and found[9] == found[8] == 8 and {found[100 + i] for i in range(31)} == {100}
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()}[2] == 2


def test_views_and_layouts(spark):
    n, e = nodes(spark, MAP), edges(spark, MAP_EDGES)
    shown, inside = graph.around(n, e, 10, ["library"])
    assert {r["label"] for r in shown.collect()} == {"Python", "SQLAlchemy"} and inside.count() == 1
    sides = {r["id"]: r["side"] for r in graph.column_layout(e, 14).collect()}
    assert sides == {10: -1, 14: 0, 12: 1}
    ids, links = list(range(12)), [(i, i + 1) for i in range(11) if i != 5] + [(3, 9)]
    at = graph.force_layout(ids, links)
    assert len(at) == 12 and all(5 <= x <= 95 and 5 <= y <= 95 for x, y in at.values())

    def gap(a, b):
        return ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5

    pairs = [(a, b) for a in ids for b in ids if a < b]
    assert min(gap(a, b) for a, b in pairs) > 1e-6
    joined = [gap(a, b) for a, b in pairs if (a, b) in links]
    assert sum(joined) / len(joined) < sum(gap(a, b) for a, b in pairs if (a, b) not in links) / (len(pairs) - len(joined))
    assert {r["label"] for r in graph.find_labels(n, "TO").collect()} == {"Tokio"}


TWO = [(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7), (4, 5, 0.9), (4, 6, 0.8), (5, 6, 0.7), (3, 4, 0.1), (2, 5, 0.05)]


def test_leiden_finds_two_clusters_and_never_loses_quality():
    import random

    levels = community.leiden(TWO, 0.5)
    assert levels[-1] == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    random.seed(2)
    for _ in range(20):
        links = [(a, b, random.random()) for a in range(25) for b in range(a) if random.random() < 0.2]
        weights: dict = {}
        for a, b, w in links:
            weights[a, b] = weights.get((a, b), 0) + w
        found = community.leiden(links, 0.3)
        scores = [community.quality(weights, level, 0.3) for level in found]
        alone = community.quality(weights, {v: v for v in found[0]}, 0.3)
        assert scores == sorted(scores) and scores[0] >= alone - 1e-9


def test_no_single_move_gains_after_many_at_once():
    rng = np.random.default_rng(3)
    for low, resolution in ((0.0, 0.3), (0.0, 0.05), (-0.3, 0.1)):
        n, (a, b) = 60, rng.integers(0, 60, (2, 300))
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        w = rng.uniform(low, 1, len(a))
        g = community.Linked(n, a, b, w)
        size, of = np.ones(n), np.arange(n)
        community.moved(g, size, of, resolution)
        weights: dict = {}
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist()):
            weights[x, y] = weights.get((x, y), 0) + z
        best = community.quality(weights, dict(enumerate(of.tolist())), resolution)
        for v in range(n):
            for c in set(of[g.far[g.start[v] : g.start[v + 1]]].tolist()):
                assert community.quality(weights, dict(enumerate(of.tolist())) | {v: c}, resolution) <= best + 1e-6


def test_components_worked_on_together_are_as_alone():
    rng = np.random.default_rng(4)
    parts = [(rng.integers(k * 100, k * 100 + n, (2, 4 * n)), rng.random(4 * n)) for k, n in enumerate((3, 40, 90, 12))]
    rows = [np.concatenate(x, axis=-1) for x in zip(*parts)]
    component = np.repeat(np.arange(4) * 7, [len(w) for _, w in parts])
    link = rows[0][0] != rows[0][1]
    together = {(c, k, v): m for found in community.by_component(component[link], *np.sort(rows[0], axis=0)[:, link], rows[1][link], 0.2) for c, k, v, m in zip(*(x.tolist() for x in found))}
    alone = {(7 * i, k, v): m for i, ((a, b), w) in enumerate(parts) for k, level in enumerate(community.leiden(list(zip(a.tolist(), b.tolist(), w.tolist())), 0.2)) for v, m in level.items()}
    assert together == alone and len({k for _, k, _ in alone}) > 1


def test_a_hub_takes_many_at_once(monkeypatch):
    rounds, n = [], 20_000
    monkeypatch.setattr(community, "wishes", lambda *args, f=community.wishes: rounds.append(1) or f(*args))
    found = community.leiden([(0, i, 1.0) for i in range(1, n)], 1e-6)
    assert set(found[-1].values()) == {0} and len(rounds) < 30


def test_links_of_a_task_become_a_forest():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, (2, 3000)) * 1_000_000_007
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 500]) for x in (a, b)], names=["source_id", "target_id"]) for i in range(0, 3000, 500)]
    rows = [r for out in graph.spanning(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns))]
    assert len(rows) < len(set(a) | set(b)) and rows == sorted(rows)

    def groups(links):
        of = {}
        for x, y in links:
            old, new = of.get(x, x), of.get(y, y)
            of |= {x: old, y: new}
            of = {v: min(old, new) if c in (old, new) else c for v, c in of.items()}
        return {v: c for v, c in of.items() if v != c}

    assert groups(rows) == groups(zip(a.tolist(), b.tolist())) == dict(rows)


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """Each round joins all nodes with all links: over 72 million links, of which tasks had brought few to one a node, rounds took most of the time."""
    rng = np.random.default_rng(6)
    sparse = rng.integers(0, 400, (2, 300)) * 1_000_000_007
    dense = rng.integers(-60, 60, (2, 150))
    for a, b in (sparse, dense):
        links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "source_id long, target_id long")
        with monkeypatch.context() as patch:
            patch.setattr(graph, "LINKS_AT_ONCE", 10)
            by_rounds = sorted(map(tuple, graph.components(links).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(graph, "symmetrised", lambda edges: 1 / 0)
            found = sorted(map(tuple, graph.components(links).collect()))
        apart = a != b
        ids, least = graph.least_reached(a[apart] * 7_001, b[apart] * 7_001)
        assert found == by_rounds == sorted(zip((ids // 7_001).tolist(), (least // 7_001).tolist()))
    assert graph.components(links.limit(0)).count() == 0


def test_links_stay_where_they_are_for_few_entities(spark):
    n = nodes(spark, [(i, f"entity_{i}", "language") for i in range(1, 7)])
    e = edges(spark, [(a, b, "co_occurs_with", w) for a, b, w in TWO])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = community.entity_graph(n, e)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan


def test_levels_are_found_once(spark):
    """What the communities are read from is stored: the search was in the plan several times, and ran as often."""
    n = nodes(spark, [(i, f"entity_{i}", "language") for i in range(1, 7)])
    e = edges(spark, [(a, b, "co_occurs_with", w) for a, b, w in TWO])
    plan = community.detect(n, e, 0.5)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_missing_weights_and_loops_count_nothing(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.4), (2, 3, None), (3, 3, 5.0), (4, 4, 1.0)], "source_id long, target_id long, weight double")
    assert sorted(map(tuple, community.memberships(e, 0.5).collect())) == [(0, 1, 1), (0, 2, 1), (0, 3, 3)]


def test_detection(spark):
    n = nodes(spark, [(i, f"entity_{i}", "language") for i in range(1, 7)] + [(10, "N", "note"), (11, "T", "tag")])
    e = edges(spark, [(a, b, "co_occurs_with", w) for a, b, w in TWO] + [(1, 10, "mentioned_in", 0.3)])
    found = community.detect(n, e, 0.5).orderBy("level", "index").collect()
    assert [(r["label"], r["member_ids"], r["member_count"]) for r in found] == [("community_0_0", [1, 2, 3], 3), ("community_0_1", [4, 5, 6], 3)]
    assert community.detect(n, e.limit(0), 0.5).count() == 0
    assert [tuple(r) for r in community.level_counts(community.detect(n, e, 0.5)).collect()] == [(0, 2, 6)]


def test_summaries(spark):
    assert community.parse_summary('x {"summary": "s", "keywords": ["k"]} y') == ("s", ["k"], [])
    assert community.parse_summary('```json\n{"summary": "s"}\n```') == ("s", [], [])
    for bad in ("nothing", "{}", "{broken"):
        with pytest.raises(ValueError):
            community.parse_summary(bad)
