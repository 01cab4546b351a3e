"""Bounded expansion, shortest paths and subgraphs of an undirected multigraph.

Walks are loops of joins between a frontier and the edges, once by their sources and once by their targets, so that edges
are neither doubled nor shuffled for a small frontier: it is written each round, and Spark broadcasts it by its size. What
was seen before is taken off by an anti join, so that a round holds each node once. Rounds are bounded by the depth asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SENTINELS
from ..sources.store import cut


def symmetrised(edges: DataFrame) -> DataFrame:
    """(source_id, target_id) in both directions, without repetitions."""
    there = edges.select("source_id", "target_id")
    return there.unionByName(there.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()


def beyond(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The columns of frontier, and in `far` the other end of each edge at its `id`, in either direction; with repetitions."""
    there = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("far")).join(frontier, "id")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("far")).join(frontier, "id")
    return there.unionByName(back)


def resolve_label(nodes: DataFrame, name: str) -> int:
    """The id of the node with this key, else the least id of those with this label. Raises ValueError if there is none."""
    hit = nodes.where((F.col("key") == name) | (F.col("label") == name)).orderBy(F.when(F.col("key") == name, 0).otherwise(1), "id").select("id").first()
    if hit is None:
        raise ValueError(f"no node is called {name!r}")
    return hit["id"]


def reached(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(origin, id, hop) of what lies within so many hops of each origin, origins (hop 0) included; starts: origin."""
    seen = frontier = cut(starts.select("origin", F.col("origin").alias("id"), F.lit(0).alias("hop")), "frontier")
    for hop in range(1, hops + 1):
        near = beyond(edges, frontier.select("origin", "id")).select("origin", F.col("far").alias("id")).distinct()
        frontier = near.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            frontier = cut(frontier, "frontier")
            if not frontier.limit(1).count():
                break
        seen = seen.unionByName(frontier)
    return seen


def neighbors_of(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, min_weight: float | None = None, limit: int | None = 20) -> DataFrame:
    """(origin, id, label, type, distance): distance 0 are direct neighbours, and depth + 1 hops are walked.

    The first `limit` of each origin by distance, type and id; none for depth 0.
    """
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    found = reached(edges, starts, depth + 1 if depth > 0 else 0).where("hop > 0")
    rows = found.join(nodes.select("id", "label", "type"), "id").select("origin", "id", "label", "type", (F.col("hop") - 1).alias("distance"))
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("distance", "type", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def expand_neighbors(nodes: DataFrame, edges: DataFrame, node_id: int, depth: int = 1, min_weight: float | None = None, limit: int = 20) -> DataFrame:
    starts = nodes.sparkSession.createDataFrame([(node_id,)], "origin long")
    return neighbors_of(nodes, edges, starts, depth, min_weight, None).drop("origin").orderBy("distance", "type", "id").limit(limit)


def graph_only(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 2) -> DataFrame:
    return expand_neighbors(nodes, edges, resolve_label(nodes, name), depth)


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, max_depth: int = 10) -> list[str] | None:
    """Labels along a shortest path, or None. Of equal ones that with the least ids from the end backwards."""
    a, b = resolve_label(nodes, start), resolve_label(nodes, end)
    spark = nodes.sparkSession
    rounds = [spark.createDataFrame([(a, None)], "id long, parent long")]
    seen = rounds[0].select("id")
    while a != b and len(rounds) <= max_depth:
        near = beyond(edges, rounds[-1].select("id")).groupBy(F.col("far").alias("id")).agg(F.min("id").alias("parent"))
        rounds.append(cut(near.join(seen, "id", "left_anti"), "path"))
        if not rounds[-1].limit(1).count():
            return None
        if rounds[-1].where(F.col("id") == b).limit(1).count():
            break
        seen = seen.unionByName(rounds[-1].select("id"))
    else:
        if a != b:
            return None
    ids = [b]
    for found in reversed(rounds[1:]):
        ids.append(found.where(F.col("id") == ids[-1]).first()["parent"])
    labels = {r["id"]: r["label"] for r in nodes.where(F.col("id").isin(ids)).select("id", "label").collect()}
    return [labels[i] for i in reversed(ids)]


def subgraph(nodes: DataFrame, edges: DataFrame, start: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within exactly `depth` hops of a node, or of the whole graph; sentinels are walked over but left out."""
    kept = nodes
    if start is not None:
        starts = nodes.sparkSession.createDataFrame([(resolve_label(nodes, start),)], "origin long")
        kept = nodes.join(reached(edges, starts, max(0, depth)).select("id"), "id", "left_semi")
    kept = kept.where(~F.col("type").isin(*SENTINELS)).select("id", "label", "type")
    ids = kept.select("id")
    inside = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return kept, inside.select("source_id", "target_id", "type", "weight", "context")


def around(nodes: DataFrame, edges: DataFrame, focus: int, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The direct view of a node: it, its neighbours of the given types, and the edges among them."""
    near = symmetrised(edges).where(F.col("source_id") == focus).select(F.col("target_id").alias("id"))
    shown = nodes.join(near, "id", "left_semi")
    if types:
        shown = shown.where(F.col("type").isin(types))
    shown = shown.unionByName(nodes.where(F.col("id") == focus)).dropDuplicates(["id"])
    ids = shown.select("id")
    inside = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return shown, inside


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node; parallel ones count each."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def find_labels(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.lower("label").contains(part.lower()))


#: Fixed value: the links that a task looks at in one go for components.
LINKS_AT_ONCE = 1 << 22


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes at links (and maybe others between them), and the least node that each reaches by them."""
    low, high = (int(min(a.min(), b.min())), int(max(a.max(), b.max()))) if len(a) else (0, -1)
    if high - low < len(a):
        # Numbered without large gaps: no sorting needed.
        ids, a, b = np.arange(low, high + 1), a - low, b - low
    else:
        ids = np.union1d(np.unique(a), np.unique(b))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    least = np.arange(len(ids))
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least != (up := least[least])).any():
            least = up
        a, b = least[a], least[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return ids, ids[least]


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what the links of a task connect: each node's with the least that it reaches there, but for those to itself."""
    held: list[np.ndarray] = []
    rows = 0

    def joined() -> np.ndarray:
        links = np.concatenate(held, axis=1)
        held.clear()
        ids, least = least_reached(*links)
        return np.stack([ids, least])[:, ids != least]

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
        rows += batch.num_rows
        if rows >= LINKS_AT_ONCE:
            held = [joined()]
            rows = held[0].shape[1]
            if rows > LINKS_AT_ONCE // 2:  # it would hardly shrink by more
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["source_id", "target_id"])
                rows = 0
    if rows:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, joined())), names=["source_id", "target_id"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that links reach, by hooking to the least neighbour and shortening, round by round.

    Tasks first bring the links that they have to one for each node at most, fewer and fewer tasks while that helps; what one
    task can look at in one go then gives the components, and only more than that takes rounds.
    """
    links = edges.select(F.col("source_id").cast("long"), F.col("target_id").cast("long")).where("source_id != target_id")

    def fewer(links: DataFrame, tasks: int) -> DataFrame:
        return cut(links.coalesce(tasks).mapInArrow(spanning, "source_id long, target_id long"), "forest")

    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    forest = fewer(links, tasks)
    n = forest.count()
    while n > LINKS_AT_ONCE and tasks > 1:
        tasks = max(1, tasks // 4)
        forest, before = fewer(forest, tasks), n
        n = forest.count()
        if n > before // 2:
            break
    if n <= LINKS_AT_ONCE:
        forest = fewer(forest, 1)
        least = forest.select(F.col("target_id").alias("id"), F.col("target_id").alias("component")).distinct()
        return cut(forest.select(F.col("source_id").alias("id"), F.col("target_id").alias("component")).unionByName(least), "component")
    both = cut(symmetrised(forest), "links")
    label = cut(both.select(F.col("source_id").alias("id")).distinct().withColumn("component", F.col("id")), "component")
    while True:
        of = label.select(F.col("id").alias("target_id"), F.col("component").alias("other"))
        least = both.join(of, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("other").alias("other"))
        hooked = label.join(least, "id").select("id", "component", F.least("component", "other").alias("next"))
        up = label.select(F.col("id").alias("next"), F.col("component").alias("above"))
        now = cut(hooked.join(up, "next").select("id", F.least("next", "above").alias("new"), "component"), "component")
        changed = now.where("new != component").limit(1).count()
        label = now.select("id", F.col("new").alias("component"))
        if not changed:
            return label


def force_layout(ids: list[int], links: list[tuple[int, int]], width: float = 100.0, height: float = 100.0, rounds: int = 100, seed: int = 0x5EED, padding: float = 5.0) -> dict[int, tuple[float, float]]:
    """Places for drawing a subgraph: all nodes repel, links attract, steps cool down; for the few that a picture holds."""
    n = len(ids)
    if not n:
        return {}
    at = np.random.default_rng(seed).uniform((padding, padding), (width - padding, height - padding), size=(n, 2))
    k = np.sqrt(width * height / n)
    index = {x: i for i, x in enumerate(ids)}
    pairs = np.array([(index[a], index[b]) for a, b in links if a in index and b in index and a != b], dtype=int).reshape(-1, 2)
    for step in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum(np.sqrt((gap**2).sum(axis=2)), 1e-3)
        move = (gap * (k * k / far**2)[..., None]).sum(axis=1)
        pull = at[pairs[:, 0]] - at[pairs[:, 1]]
        pull *= (np.sqrt((pull**2).sum(axis=1)) / k)[:, None]
        np.add.at(move, pairs[:, 0], -pull)
        np.add.at(move, pairs[:, 1], pull)
        length = np.maximum(np.sqrt((move**2).sum(axis=1)), 1e-9)
        heat = min(width, height) / 10 * (1 - step / rounds)
        at += move / length[:, None] * np.minimum(length, heat)[:, None]
        at = np.clip(at, padding, (width - padding, height - padding))
    return {x: (float(p[0]), float(p[1])) for x, p in zip(ids, at)}


def column_layout(edges: DataFrame, focus: int) -> DataFrame:
    """(id, side, row): predecessors to the left (-1), the node in the middle (0), successors to the right (1)."""
    left = edges.where(F.col("target_id") == focus).select(F.col("source_id").alias("id"), F.lit(-1).alias("side"))
    right = edges.where(F.col("source_id") == focus).select(F.col("target_id").alias("id"), F.lit(1).alias("side"))
    sides = left.unionByName(right).where(F.col("id") != focus).groupBy("id").agg(F.min("side").alias("side"))
    sides = sides.unionByName(edges.sparkSession.createDataFrame([(focus, 0)], "id long, side int"))
    return sides.withColumn("row", F.row_number().over(Window.partitionBy("side").orderBy("id")) - 1)
