import json

import pytest
from pyspark.sql import functions as F

from notequarry.operators import changes, rag, render, vector
from notequarry.plans import ingest, service
from notequarry.plans.knowledge import Config, KnowledgeBase
from notequarry.plugins import ExtractiveGenerator, GazetteerExtractor
from notequarry.schema import conformed, with_keys
from notequarry.sources import seed, store

BODY = "Content about {} that is long enough to make one chunk of it."
NAMES = GazetteerExtractor((("Rust", "language"), ("Docker", "tool")))


def write(folder, name, title, about, extra=""):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(f"---\ntitle: {title}\n{extra}---\n# {title}\n\n{BODY.format(about)}\n")


@pytest.fixture(scope="module")
def demo(spark):
    tables = store.empty(spark) | seed.demo(spark)
    return KnowledgeBase(spark, tables)


def test_demo_counts(demo):
    assert demo.stats().first().asDict() == {"nodes": 44, "notes": 20, "entities": 24, "tags": 0, "edges": 113, "with_embeddings": 20, "chunks": 20}
    assert changes.searchable(demo.nodes).count() == 20


def test_build_is_incremental(spark, tmp_path):
    source, root = tmp_path / "vault", str(tmp_path / "kb")
    write(source, "alpha.md", "Alpha", "Rust and Docker", "tags: docker, tools\ndate: 2024\n")
    write(source, "sub/beta.md", "Dup", "Rust")
    write(source, "gamma.md", "Dup", "nothing")
    first = ingest.build(spark, str(source), root, NAMES)
    kb = KnowledgeBase.open(spark, root)
    assert first.files == 3 and kb.nodes.where("type = 'note'").count() == 3
    assert {r["label"] for r in kb.nodes.where("type = 'tag'").collect()} == {"vault", "sub", "docker", "tools"}
    kinds = {r["type"]: r["count"] for r in kb.edges.groupBy("type").count().collect()}
    assert kinds == {"mentioned_in": 3, "co_occurs_with": 1, "belongs_to": 3, "tagged_with": 2}
    assert kb.nodes.groupBy("key").count().where("count > 1").count() == 0 and kb.nodes.select("id").distinct().count() == kb.nodes.count()
    assert json.loads(kb.nodes.where("label = 'Alpha'").first()["metadata"])["date"] == "2024"
    again = ingest.build(spark, str(source), root, NAMES)
    assert again.files == 0 and again.total_nodes == first.total_nodes and again.total_edges == first.total_edges
    write(source, "alpha.md", "Alpha", "Rust alone")
    (source / "gamma.md").unlink()
    third = ingest.build(spark, str(source), root, NAMES)
    kb = KnowledgeBase.open(spark, root)
    assert third.files == 1 and kb.nodes.where("type = 'note'").count() == 2 and kb.chunks.count() == 2
    assert {r["label"] for r in kb.nodes.where("type not in ('note', 'tag')").collect()} == {"Rust"}
    with pytest.raises(ValueError, match="no Markdown"):
        (tmp_path / "empty").mkdir()
        ingest.build(spark, str(tmp_path / "empty"), root)


def test_stream_ingest(spark, tmp_path):
    from notequarry.streaming.ingest import ingest_stream

    source, root = tmp_path / "in", str(tmp_path / "kb")
    for name in ("a", "b"):
        write(source, f"{name}.md", name, "Rust")
        ingest_stream(spark, str(source), root, str(tmp_path / "offsets"), NAMES).awaitTermination()
    assert {r["label"] for r in store.load(spark, root)["nodes"].where("type = 'note'").collect()} == {"a", "b"}


def test_search(demo):
    found = demo.search("Lathe tool", k=3, depth=1).collect()
    scores = [r["score"] for r in found]
    assert 3 < len(found) <= 6 and scores == sorted(scores, reverse=True) and scores[0] == 1 and scores[-1] == 0
    assert len({r["id"] for r in found}) == len(found)
    assert all(r["type"] == "note" for r in demo.search("Lathe", k=3, notes_only=True).collect())
    assert demo.search("Lathe", k=3, filters=["slug = note-0"]).where("type = 'note'").count() <= 1
    assert demo.search("Lathe", k=3, filters=["slug = note-7"], prefilter=True).where("type = 'note'").first()["label"] == "Note 7"
    assert demo.search("", k=3).count() == 0
    with pytest.raises(ValueError, match="filter"):
        demo.search("x", filters=["broken"])


def test_suppressed_candidates_bring_no_neighbours(spark):
    nodes = conformed(spark.createDataFrame([(i, f"note:{i}", f"n{i}", "note", None) for i in range(1, 6)], "id long, key string, label string, type string, metadata string"), "nodes")
    edges = conformed(spark.createDataFrame([(1, 1, 2, "x", 1.0), (2, 2, 5, "x", 1.0)], "id long, source_id long, target_id long, type string, weight double"), "edges")
    chunks = conformed(spark.createDataFrame([(1, 1, "", "one", "s", [1.0, 0.0]), (2, 2, "", "two", "s", [0.9, 0.1]), (3, 3, "", "three", "s", [0.0, 1.0])], "id long, note_id long, header string, text string, slug string, embedding array<float>"), "chunks")
    from notequarry.operators.hybrid import hybrid_search

    rows = {r["id"]: r for r in hybrid_search(nodes, edges, chunks, "q", [1.0, 0.0], k=3, depth=1).collect()}
    assert rows[2]["chunk_text"] == "" and rows[1]["chunk_text"] == "one" and set(rows) == {1, 2, 3, 5}


def test_similar(demo, tmp_path):
    found = demo.similar(label="Note 3", k=4).collect()
    assert len(found) == 4 and "Note 3" not in {r["label"] for r in found} and found[0]["score"] == 1
    write(tmp_path, "x.md", "X", "Lathe is a tool")
    assert demo.similar(file=str(tmp_path / "x.md"), k=2).count() == 2
    for bad in ({}, {"label": "a", "file": "b"}, {"label": "Nobody"}):
        with pytest.raises(ValueError):
            demo.similar(**bad)


def test_similar_floors_at_zero(spark):
    rows = [(1, 1, "h", "t", [1.0, 0.0]), (2, 2, "h", "t", [-1.0, 0.0]), (3, 3, "h", "t", None)]
    chunks = spark.createDataFrame(rows, "id long, note_id long, header string, text string, embedding array<float>")
    found = {r["note_id"]: r for r in vector.note_similarities(chunks, [[1.0, 0.0]]).collect()}
    assert (found[2]["similarity"], found[2]["text"]) == (0.0, "") and found[1]["text"] == "t" and 3 not in found
    assert vector.similar_notes(chunks, [], 3).count() == 0 and vector.topk_chunks(chunks, [0.0, 0.0], 3).count() == 0


def test_fts_and_graph(demo):
    assert demo.fts('"lathe is a tool"').count() > 0
    assert demo.fts("lathe*", notes_only=True).first()["type"] == "note"
    assert demo.graph("Lathe", 1).count() > 0
    assert demo.path("Lathe", "Oak") in (["Lathe", "Oak"], ["Lathe", "Note 0", "Oak"])
    assert demo.subgraph("Lathe", 1)[0].count() > 1 and len(demo.layout("Lathe", 1)) > 1


def test_communities_and_answers(spark):
    kb = KnowledgeBase(spark, store.empty(spark) | seed.demo(spark), generator=ExtractiveGenerator())
    found = kb.detect_communities(0.3)
    assert found.count() > 1 and found.where("member_count < 2").count() == 0

    class Writer:
        def generate(self, prompt):
            return '{"summary": "All about a lathe", "keywords": ["lathe"]}'

    class Mute:
        def generate(self, prompt):
            return "no json"

    assert kb.summarize_communities(Mute()).where("summary is not null").count() == 0
    done = kb.summarize_communities(Writer())
    assert done.where("summary is null").count() == 0 and done.first()["keywords"] == ["lathe"] and done.first()["summary_tokens"] > 0
    assert kb.related("lathe", 2).count() == 2
    answer = kb.ask("What is a lathe?", k=3)
    assert answer.answer and answer.sources and {"label", "path"} == set(answer.sources[0])
    kb.tables["chunks"] = kb.chunks.limit(0)
    assert kb.ask("x").answer == rag.NOTHING


def test_sources_and_prompts(spark):
    rows = [(1, "nginx", "/notes/nginx.md"), (2, "nginx", "/notes/nginx.md"), (3, "docker", None), (4, "rust", "/r.md"), (5, "docker", "")]
    df = spark.createDataFrame(rows, "rank long, label string, file string")
    assert [(r["label"], r["path"]) for r in rag.sources(df).collect()] == [("nginx", "/notes/nginx.md"), ("docker", None), ("rust", "/r.md")]
    options = rag.Options(communities=1, evidence=3)
    text = rag.build_prompt("q", [("a", "x")] * 3, [("n", "y" * 500)] * 5, options)
    assert text.count("Community: ") == 1 and text.count("Note: ") == 3 and "y" * 301 not in text
    assert "Community" not in rag.build_prompt("q", [], [("n", "y")], options)


def test_rendering(demo):
    found = demo.search("Lathe", k=2, depth=1)
    assert isinstance(json.loads(render.rendered(found, "json")), list)
    assert render.rendered(found, "list").startswith("- [Note")
    assert render.rendered(found).splitlines()[0].split() == ["score", "type", "label", "content"]
    with pytest.raises(ValueError):
        render.rendered(found, "xml")


def test_keys_of_old_nodes(spark):
    rows = [(1, "Foo", "note", '{"path":"a/foo.md"}'), (2, "Python", "language", "{}"), (3, "Other", "note", None)]
    found = with_keys(spark.createDataFrame(rows, "id long, label string, type string, metadata string"))
    assert [r["key"] for r in found.orderBy("id").collect()] == ["note:a/foo.md", "node:Python", "note:legacy:3"]
    with pytest.raises(ValueError, match="node:A"):
        with_keys(spark.createDataFrame([(1, "A", "x", None), (2, "A", "y", None)], "id long, label string, type string, metadata string"))


def test_pruning(spark):
    nodes = spark.createDataFrame(
        [(100, "note", '{"path":"gone.md","hash":"h"}'), (101, "note", '{"path":"here.md","hash":"h2"}'), (102, "note", "{}"), (103, "note", "broken"), (201, "language", None), (202, "tool", None), (203, "system", None), (204, "root", None)],
        "id long, type string, metadata string",
    )
    edges = spark.createDataFrame([(100, 201), (202, 101)], "source_id long, target_id long")
    chunks = spark.createDataFrame([(1, 100), (2, 101)], "id long, note_id long")
    present = spark.createDataFrame([("here.md",)], "path string")
    stale = changes.stale_notes(nodes, present)
    assert {r["id"] for r in stale.collect()} == {100, 102}
    n, e, c = changes.pruned(nodes, edges, chunks, stale)
    assert e.count() == c.count() == 1
    assert {r["id"] for r in changes.without_orphans(n, e).collect()} == {101, 103, 202, 203, 204}
    assert [tuple(r) for r in changes.stored_hashes(nodes).orderBy("id").collect()] == [("gone.md", "h", 100), ("here.md", "h2", 101)]


def test_service(demo):
    def call(method, **params):
        return service.answer(demo, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))

    assert "tools" in call("initialize")["result"]["capabilities"]
    assert call("tools/call", name="stats", arguments={})["result"][0]["nodes"] == 44
    assert call("resources/read", name="notes")["result"][0]["type"] == "note"
    assert len(call("resources/read", name="edges")["result"]) == 113
    assert call("tools/call", name="path", arguments={"start": "Lathe", "end": "Oak"})["result"][0] == "Lathe"
    for got, code in ((service.answer(demo, "{"), -32700), (service.answer(demo, "[]"), -32600), (call("nope"), -32601), (call("tools/call", name="nope"), -32602), (call("tools/call", name="graph", arguments={"name": "Nobody"}), -32602)):
        assert got["error"]["code"] == code
    assert service.answer(demo, '{"jsonrpc": "2.0", "method": "initialize"}') is None


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("k = 9\n[search]\nalpha = 0.5\n[other]\nx = 1\n")
    assert Config.from_toml(str(tmp_path / "c.toml")) == Config(k=9, alpha=0.5)


def test_store_round_trip_and_reset(demo, tmp_path):
    root = str(tmp_path / "kb")
    demo.save(root)
    assert KnowledgeBase.open(demo.spark, root).stats().first()["nodes"] == 44
    store.reset(demo.spark, root)
    assert KnowledgeBase.open(demo.spark, root).stats().first()["nodes"] == 0


def test_import_of_a_single_file_store(spark, tmp_path):
    import sqlite3
    import struct

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table nodes (id integer, key text, label text, type text, embedding blob, metadata text, created_at text)")
        db.execute("create table edges (id integer, source_id integer, target_id integer, type text, weight real, context text)")
        db.execute("create table chunks (id integer, note_id integer, header text, text text, slug text, embedding blob, metadata text)")
        db.execute("create table communities (id integer, label text, level integer, member_ids text, member_count integer)")
        db.execute("insert into chunks values (1, 1, 'h', 't', 's', ?, null)", (struct.pack("<2f", 0.5, 2),))
        db.execute("insert into communities values (1, 'c', 0, '[1,2]', 2), (2, 'd', 0, 'broken', 0)")
    tables = store.import_sqlite(spark, str(tmp_path / "s.db"))
    assert tables["chunks"].first()["embedding"] == [0.5, 2.0]
    assert [r["member_ids"] for r in tables["communities"].orderBy("id").collect()] == [[1, 2], []]
    assert tables["nodes"].where(F.lit(True)).count() == 0
