import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notequarry import catalog, plugins
from notequarry.functions import jsons, texts, vectors
from notequarry.operators import entities, filters, fts
from notequarry.sources import markdown


@pytest.mark.parametrize("text, slug", [("FastAPI", "fastapi"), ("Sebastián Ramírez", "sebastian-ramirez"), ("Linux capabilities", "linux-capabilities"), ("a_b  --c!", "ab-c"), ("", "")])
def test_slugs(text, slug):
    assert texts.slug(text) == slug


def test_frontmatter():
    fields, body = markdown.frontmatter("---\ntitle: Mi Nota\ntags: docker, rust\ntitle: Two: b\n---\n\n# Contenido")
    assert fields == {"title": "Two: b", "tags": "docker, rust"} and body == "\n# Contenido"
    assert markdown.frontmatter("---\nopen") == ({}, "---\nopen")
    assert markdown.frontmatter("x") == ({}, "x")


def test_chunks_by_headings():
    long = "word " * 20
    found = markdown.chunks(f"{long}\n# A\n{long}\n## B b\nshort\n#### not a heading\n### C\n{long}")
    assert [h for h, _ in found] == ["", "# A", "### C"]
    assert len(markdown.chunks(f"# Only\n{long}\n```\n# This is not a real header\n{long}\n```\n{long}")) == 1
    assert len(markdown.chunks(f"# Only\n{long}\n```\n# An open fence is none\n{long}")) == 2
    assert markdown.chunks("é" * 24) == [] and len(markdown.chunks("é" * 25)) == 1


def test_text_columns(spark):
    df = spark.createDataFrame([("a/b.md", "Ñandú  éé x", "one, ,two ,")], "path string, text string, tags string")
    row = df.select(
        texts.tokens(F.col("text")).alias("t"), texts.clip_text(F.col("text"), 12).alias("c"), texts.clip_text(F.col("text"), 100).alias("w"), texts.truncate_chars(F.col("text"), 5).alias("u"),
        texts.tags(F.col("tags")).alias("g"), texts.directory(F.col("path"), "root").alias("d"), texts.directory(F.lit("x.md"), "root").alias("r"), texts.directory(F.lit("muestra/x.md"), "root").alias("h"),
        texts.slugify(F.col("text")).alias("s"), texts.chunk_ref(F.col("path"), F.lit("# H")).alias("ref"), texts.embed_text(F.lit(""), F.lit("x")).alias("e"),
    ).first()
    assert row["t"] == ["nandu", "ee", "x"] and row["c"] == "Ñandú  éé x..."[:14] and row["w"] == "Ñandú  éé x" and row["u"] == "Ñandú..."
    assert row["g"] == ["one", "two"] and (row["d"], row["r"], row["h"]) == ("a", "root", None) and row["s"] == "nandu-ee-x" and row["ref"] == "a/b.md## H" and row["e"] == "x"


def test_slugs_of_documents_in_all_languages(spark, tmp_path):
    rows = [(1, "en", "A plain Line", "a-plain-line"), (2, "fr", "Été à  Nîmes, où ça?", "ete-a-nimes-ou-ca"), (3, "de", "Größe - Übung", "groe-ubung"), (4, "es", "¿Qué Ñandú?", "que-nandu"), (None, None, "Ÿ", "y"), (5, "fr", None, None), (6, "fr", "é" * 90, "e" * 80)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["slug"] for r in catalog.QUERIES["slugify"](spark, str(tmp_path)).collect()}
    assert found == {r[0]: r[3] for r in rows}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("z")), vectors.normalize(F.col("a")), vectors.normalize(F.col("z")), vectors.from_blob(vectors.to_blob("b"))).first()
    assert (row[0], row[1], row[2]) == (24.0, 5.0, 0.0) and row[3] == pytest.approx([0.6, 0.8]) and row[4] == [0, 0] and row[5] == [4.0, 3.0, 9.0]


def test_json_functions(spark):
    df = spark.createDataFrame([('{"a.b": "x", "n": 3, "s": "7.5x"}',), ("broken",), (None,)], "m string")
    rows = df.select(jsons.field(F.col("m"), "a.b"), jsons.string_field(F.col("m"), "n"), jsons.string_field(F.col("m"), "s")).collect()
    assert tuple(rows[0]) == ("x", None, "7.5x") and tuple(rows[1]) == tuple(rows[2]) == (None, None, None)
    values = ["abc", "12abc", "  7.5x", ".5", "-3e2", "", "inf", "1e", "+4", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(jsons.real(F.col("v"))).collect()]
    assert got == [0.0, 12.0, 7.5, 0.5, -300.0, 0.0, 0.0, 1.0, 4.0, None]


def test_entity_lists():
    assert jsons.entity_list('```json\n[{"text": "A"}, 3]\n```') == [{"text": "A"}]
    assert jsons.entity_list('{"entities": [{"text": "A"}]}') == jsons.entity_list('{"results": [{"text": "A"}]}') == [{"text": "A"}]
    assert jsons.entity_list('So: [{"text": "A"}] and more') == [{"text": "A"}]
    assert jsons.entity_list("nothing") == []
    found = plugins.cleaned([{"text": " Rust ", "label": "language", "score": 0.4}, {"text": "Go"}, {"text": "go", "label": "x"}, {"text": " "}])
    assert found == [{"id": "go", "label": "Go", "type": "concept", "score": 0.5}]


def test_retries():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        plugins.retried(fails, sleep=waits.append)
    assert len(calls) == 3 and waits == [2, 4]


ROWS = ['{"date":2023,"category":"tutorial"}', '{"date":2021,"category":"guide"}', '{"date":2023}', '{"date":2023,"category":"tutorial","status":"published"}', '{"date":2021,"category":"guide","status":"archived"}', None, "broken"]


@pytest.mark.parametrize(
    "given, rows",
    [(["category = tutorial"], [0, 3]), (["date >= 2023"], [0, 2, 3]), ([], [0, 1, 2, 3, 4, 5, 6]), (["nonexistent = value"], []), (["nonexistent != value"], []), (["category = tutorial", "date >= 2023"], [0, 3]), (["category = guide", "date >= 2023"], []), (["status != archived"], [3]), (["category < 5"], [0, 1, 3, 4]), (["date < abc"], [0, 1, 2, 3, 4])],
)
def test_filters(spark, given, rows):
    df = spark.createDataFrame(list(enumerate(ROWS)), "i int, m string")
    assert [r["i"] for r in df.where(filters.all_of(F.col("m"), given)).orderBy("i").collect()] == rows


def test_filter_parser():
    assert filters.parse("nested.field = value") == filters.Predicate("nested.field", "=", "value")
    assert filters.parse("score<=0.9 ") == filters.Predicate("score", "<=", "0.9")
    for bad in ("badformat", "", "justfield", "= x"):
        with pytest.raises(ValueError):
            filters.parse(bad)


DOCS = [(1, "Rust", "the quick brown fox"), (2, "Niño", "quick quick quick and the lazy dog"), (3, "Python", "a lazy fox sleeps, quick"), (4, "Empty", ""), (5, "Other", "brown bears and brown foxes")]


@pytest.fixture(scope="module")
def index(spark):
    return fts.indexed(spark.createDataFrame(DOCS, "id long, title string, content string"))


@pytest.mark.parametrize(
    "query, ids",
    [("quick", {1, 2, 3}), ("quick fox", {1, 3}), ("quick AND NOT lazy", None), ("quick NOT lazy", {1}), ("bears OR dog", {2, 5}), ('"quick brown"', {1}), ("fox*", {1, 3, 5}), ("title:nino", {2}), ("content:rust", set()), ("title:rust quick", {1}), ("(bears OR dog) and", {2, 5}), ("NEAR(the dog, 1)", {2}), ("NEAR(the dog, 0)", set()), ("NEAR(quick fox, 1)", {1, 3}), ("QUICK OR nothing", {1, 2, 3}), ('"bro" + "wn"', set())],
)
def test_full_text_queries(index, query, ids):
    if ids is None:
        with pytest.raises(fts.QueryError):
            fts.parse(query)
    else:
        assert {r["id"] for r in fts.search(index, query).collect()} == ids


@pytest.mark.parametrize("query", ["python-x", "", "  ", "(a", "a)", "a AND", "nocolumn:a", '"open', "OR a"])
def test_full_text_errors(query):
    with pytest.raises(fts.QueryError):
        fts.parse(query)


@pytest.mark.parametrize("query", ["quick", "quick fox", "bears OR dog", '"quick quick"', "fox*", "quick NOT lazy", "title:rust OR brown", "NEAR(quick fox, 3)"])
def test_ranks_are_those_of_sqlite(index, query):
    import sqlite3

    with sqlite3.connect(":memory:") as db:
        db.execute("create virtual table d using fts5(title, content)")
        db.executemany("insert into d(rowid, title, content) values (?, ?, ?)", [d for d in DOCS if d[2]])
        expected = dict(db.execute("select rowid, rank from d where d match ?", (query,)).fetchall())
    assert {r["id"]: r["rank"] for r in fts.search(index, query, None).collect()} == pytest.approx(expected, abs=1e-9)


def test_postings(spark):
    rows = {(r["term"], r["id"], r["col"]): (r["tf"], r["positions"]) for r in fts.postings(spark.createDataFrame(DOCS, "id long, title string, content string")).collect()}
    assert rows["quick", 2, "content"] == (3, [0, 1, 2]) and rows["nino", 2, "title"] == (1, [0]) and not any(k[1] == 4 for k in rows)


def test_entity_edges(spark):
    found = [("a.md", "# H", [("rust", "Rust", "language", 0.9), ("go", "Go", "language", 0.6), ("rust", "RUST", "language", 0.8)])]
    df = spark.createDataFrame(found, f"path string, header string, entities {entities.ENTITY}")
    assert {(r["source"], r["target"], r["weight"]) for r in entities.co_occurrences(df).collect()} == {("node:Rust", "node:Go", 0.6), ("node:Go", "node:RUST", 0.6)}
    assert {(r["source"], r["target"], r["weight"], r["context"]) for r in entities.mentions(df).collect()} == {("node:Rust", "note:a.md", 0.9, "a.md## H"), ("node:Go", "note:a.md", 0.6, "a.md## H"), ("node:RUST", "note:a.md", 0.8, "a.md## H")}


def test_plugin_columns(spark):
    df = spark.createDataFrame([("Rust and Go",), ("nothing",)], "text string")
    found = entities.extract(df, plugins.GazetteerExtractor((("Go", "language"), ("Rust", "language")))).collect()
    assert [[e["label"] for e in r["entities"]] for r in found] == [["Rust", "Go"], []]
    rows = entities.embed(df, F.col("text"), plugins.HashingEmbedder(16)).collect()
    assert all(len(r["embedding"]) == 16 for r in rows)

    assert [r["embedding"] for r in entities.embed(df.limit(1), F.col("text"), Broken()).collect()] == [None]


def cancelling(dimension):
    """Two words that a hashing embedder puts at one place with opposite signs."""
    embedder, seen = plugins.HashingEmbedder(dimension), {}
    for i in range(100_000):
        row = embedder.embed([f"w{i}"])[0]
        at = int(np.flatnonzero(row)[0])
        if (at, -row[at]) in seen:
            return f"{seen[at, -row[at]]} w{i}"
        seen[at, row[at]] = f"w{i}"


def test_one_text_does_not_take_the_vectors_of_others(spark):
    texts = [f"text {i}" for i in range(700)] + ["bad", None, "", cancelling(16)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, text string").coalesce(1)
    got = {r["i"]: r["embedding"] for r in entities.embed(df, F.col("text"), Picky()).collect()}
    assert [i for i in range(704) if got[i] is None] == [700, 701] and not any(got[702]) and any(got[703])
    assert got[5] == plugins.HashingEmbedder(16).embed(["text 5"])[0].tolist()


class Picky(plugins.HashingEmbedder):
    """Fails by a bad text, a null, and more than 256 at once."""

    def __init__(self):
        super().__init__(16)

    def embed(self, texts):
        if "bad" in texts or len(texts) > 256:
            raise MemoryError
        return super().embed(texts)


def test_embedded_texts_of_odd_documents(spark, tmp_path):
    rows = [(1, "s", "one two"), (2, "s", None), (3, "s", ""), (4, "s", "-- _"), (5, "s", cancelling(4096)), (6, "", "gone"), (7, None, "gone"), (8, "s", f"{cancelling(4096)}\n" * 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["embedded_texts"](spark, str(tmp_path)).select("doc_id", "embedded", "length").collect()
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        expected = db.execute(catalog.ORACLES["embedded_texts"]).fetchall()
    assert sorted(map(tuple, got)) == sorted((a, b, float(c)) for a, b, c in expected)


class Broken:
    dimension = 2

    def embed(self, texts):
        raise MemoryError


FOREIGN = [
    "йод и ёлка", "и\u0306од", "Việt Nam", "Vie\u0323\u0302t", "piñata", "pin\u0303ata", "ΟΔΟΣ οδός", "Ärger straße ŠKODA", "don't stop", "naïve façade œuvre", "İstanbul ıslak", "ﬁne x²", "日本語 テスト", "a_b c-d", "ſun µm",
]
ASKED = ["йод", "ёлка", "елка", "Việt", "viet", "piñata", "pinata", "οδος", "οδός", "arger", "straße", "skoda", "naive", "œuvre", "istanbul", "日本語", "b", "c", "sun", "vi*", '"и од"', "x²"]


def test_words_fold_as_in_a_full_text_index(spark):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, content)")
    db.executemany("insert into f(rowid, title, content) values (?, '', ?)", enumerate(FOREIGN, 1))
    index = fts.indexed(spark.createDataFrame([(i, "", x) for i, x in enumerate(FOREIGN, 1)], "id long, title string, content string"))
    for q in ASKED:
        match = q if q.startswith('"') else f'"{q[:-1]}"*' if q.endswith("*") else f'"{q}"'
        expected = [r[0] for r in db.execute("select rowid from f where f match ? order by rowid", (match,))]
        assert sorted(r["id"] for r in fts.search(index, q, None).collect()) == expected, q
