"""More queries of the driver contract: parts of the inventory that the catalog's larger queries don't show by themselves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from .catalog import BASES, CHUNKS_SQL, FTS_SQL, PLACES_SQL, bm25_sql, chunks, documents, expand_sql, fts_docs, place_edges, places, query, query_vector, ranked, region_name, t, times, vector_communities, vector_notes
from .functions import jsons, texts, vectors
from .operators import changes, community, entities, graph, hybrid, rag, vector
from .plugins import ExtractiveGenerator, GazetteerExtractor, HashingEmbedder
from .schema import with_keys
from .sources import markdown, store

# Graphs.


@query(expand_sql(""))
def graph_only(spark, sf_dir):
    """The neighbours of a node that is named, not numbered."""
    return graph.graph_only(places(spark, sf_dir), place_edges(spark, sf_dir), "region:" + region_name(spark, sf_dir), 1)


@query(f"with {PLACES_SQL} select id, label, type from places where lower(label) like '%r#%12%' or lower(label) like '%r#%21%'")
def find_labels(spark, sf_dir):
    rows = graph.find_labels(places(spark, sf_dir), "R#").select("id", "label", "type")
    return rows.where(F.col("label").contains("12") | F.col("label").contains("21"))


FOCUS = BASES["nation"] + 3
AROUND_SQL = f"with {PLACES_SQL}, s as (select * from places where id = {FOCUS} or (type = 'supplier' and id in (select b from both_ways where a = {FOCUS})))"


@query(AROUND_SQL + " select id, label, type from s")
def graph_around_nodes(spark, sf_dir):
    return graph.around(places(spark, sf_dir), place_edges(spark, sf_dir), FOCUS, ["supplier"])[0].select("id", "label", "type")


@query(AROUND_SQL + " select a as source_id, b as target_id, weight from links where a in (select id from s) and b in (select id from s)")
def graph_around_edges(spark, sf_dir):
    return graph.around(places(spark, sf_dir), place_edges(spark, sf_dir), FOCUS, ["supplier"])[1].select("source_id", "target_id", "weight")


@query(f"""with {PLACES_SQL}, s as (select {FOCUS}::bigint as id, 0 as side union all select distinct a, -1 from links where b = {FOCUS} union all select distinct b, 1 from links where a = {FOCUS})
select id, side::int as side, (row_number() over (partition by side order by id) - 1)::int as "row" from s""")
def graph_columns(spark, sf_dir):
    return graph.column_layout(place_edges(spark, sf_dir), FOCUS).select("id", "side", F.col("row").cast("int").alias("row"))


# Notes and their chunks.


@query(f"with {CHUNKS_SQL} select note_id as id, 'Note ' || note_id as label, case when note_id % 2 = 0 then arg_min(text, id) else 'about ' || note_id end as preview from chunks group by note_id")
def note_previews(spark, sf_dir):
    """The first chunk of a note; for notes without chunks (here those of odd numbers) the content in its metadata."""
    meta = F.to_json(F.struct(F.concat(F.lit("about "), F.col("id").cast("string")).alias("content")))
    return hybrid.previews(vector_notes(spark, sf_dir).withColumn("metadata", meta), chunks(spark, sf_dir).where("note_id % 2 = 0"))


@query(f"""with {CHUNKS_SQL}, k as (select id, note_id, list_cosine_similarity(v, qv) as c from chunks, q order by c desc, id limit 20)
select note_id, case when note_id % 2 = 0 then 'Note ' || note_id else 'note#' || note_id end as label, round(0.5 * (max(c) + 0.2), 6) as score from k group by note_id""")
def fallback_labels(spark, sf_dir):
    """Notes that are missing (here those of odd numbers) are labelled by their ids."""
    top = vector.topk_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), 20)
    rows = hybrid.reranked(vector_notes(spark, sf_dir).where("id % 2 = 0"), top, "nothing", 0.5)
    return rows.select("note_id", "label", F.round("score", 6).alias("score"))


SIMILAR_TO_SQL = f"""with {CHUNKS_SQL}, s as (select v as sv from chunks where id in (1, 7, 11)),
n as (select note_id, greatest(0.0, max(list_cosine_similarity(v, sv))) as similarity from chunks, s group by note_id),
k as (select *, similarity as score from n order by similarity desc, note_id limit 10)
select note_id, round(similarity, 6) as similarity, round(case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else score end, 6) as score from k"""


@query(SIMILAR_TO_SQL)
def similar_by_vectors(spark, sf_dir):
    """Notes like the vectors of something from outside: nothing is left out."""
    own = [r[0] for r in chunks(spark, sf_dir).where(F.col("id").isin(1, 7, 11)).select("embedding").collect()]
    return vector.similar_notes(chunks(spark, sf_dir), own, 10).select("note_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query("select doc_id as id, text as content, source || '/' || doc_id || '.md' as file from documents")
def metadata_projection(spark, sf_dir):
    return documents(spark, sf_dir).select("id", hybrid.content_of(F.col("metadata")).alias("content"), hybrid.file_of(F.col("metadata")).alias("file"))


@query("select doc_id as id, source as title, text as content from documents where text <> ''")
def searchable_nodes(spark, sf_dir):
    """What the full-text index is made of."""
    return changes.searchable(documents(spark, sf_dir))


@query(f"select h.id, h.rank, source as label, 'note' as type from ({bm25_sql([times('un')], 'f0 > 0', 'order by r, id limit 10')}) h join documents on doc_id = h.id")
def fts_hits(spark, sf_dir):
    """Hits with the nodes that they are."""
    hits = ranked(fts_docs(spark, sf_dir), "un", 10)
    return hits.join(documents(spark, sf_dir).select("id", "label", "type"), "id")


@query(f"with {FTS_SQL} select sum(len(regexp_extract_all(content, '[^ ]+')))::bigint as words, count(*) as documents from d where content like '% un %'")
def fts_columns(spark, sf_dir):
    """The stored index: words between blanks, by column."""
    rows = fts_docs(spark, sf_dir).where(F.col("content").contains(" un "))
    return rows.agg(F.sum(F.size(F.filter(F.split("content", " "), lambda w: w != ""))).alias("words"), F.count(F.lit(1)).alias("documents"))


# Ingest.


@query("select 'note:' || doc_id || '.md' as key, source as label, 'note' as type, doc_id || '.md' as path, sha256(text) as hash, lang from documents")
def note_rows(spark, sf_dir):
    """Files as notes: the title from the front matter, the rest of it in the metadata."""
    name, meta = F.concat(F.col("doc_id").cast("string"), F.lit(".md")), F.col("metadata")
    text = F.concat(F.lit("---\ntitle: "), "source", F.lit("\nlang: "), "lang", F.lit("\npath: elsewhere\n---\n"), "text")
    files = t(spark, sf_dir, "documents").select(name.alias("path"), text.alias("text"), F.sha2("text", 256).alias("hash"))
    rows = markdown.notes(markdown.parsed(files))
    return rows.select("key", "label", "type", *(jsons.string_field(meta, f).alias(f) for f in ("path", "hash", "lang")))


@query("select doc_id, source, doc_id || '.md' as path, trim(text, ' \t\n\r\x0b\x0c') as body from documents")
def frontmatter_bodies(spark, sf_dir):
    """The text that stays without its front matter, trimmed."""
    text = F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n"), "text")
    files = t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), "doc_id")
    return markdown.parsed(files).select("doc_id", F.col("fields")["source"].alias("source"), "path", "body")


@query(f"with {PLACES_SQL} select id, case when id % 3 = 0 and type = 'supplier' then 'note:legacy:' || id when type = 'supplier' then 'note:s/' || id || '.md' else 'node:' || label end as key from places")
def key_migration(spark, sf_dir):
    """Keys for a table without: suppliers as notes, every third of them without a path."""
    meta = F.when((F.col("type") == "supplier") & (F.col("id") % 3 != 0), F.to_json(F.struct(F.concat(F.lit("s/"), F.col("id").cast("string"), F.lit(".md")).alias("path"))))
    old = places(spark, sf_dir).drop("key").withColumns({"metadata": meta, "type": F.when(F.col("type") == "supplier", "note").otherwise(F.col("type")), "label": F.col("label")})
    return with_keys(old).select("id", "key")


@query(f"with {PLACES_SQL} select a as source_id, b as target_id, weight from links where a not between 2000000000 and 2000000009 and b not between 2000000000 and 2000000009")
def edges_without_nodes(spark, sf_dir):
    gone = places(spark, sf_dir).where(F.col("id").between(BASES["nation"], BASES["nation"] + 9))
    return changes.without_edges_of(place_edges(spark, sf_dir), gone).select("source_id", "target_id", "weight")


PRUNED = "note_id % 4 = 1"


@query(f"with {CHUNKS_SQL}, n as (select distinct note_id from chunks) select 'chunk' as kind, id from chunks where not ({PRUNED}) union all select 'node', note_id from n where not ({PRUNED}) union all select 'edge', note_id from n where note_id > 0 and not ({PRUNED}) and not ((note_id // 2) % 4 = 1)")
def pruned_tables(spark, sf_dir):
    """Notes whose files are gone, with their edges and chunks."""
    from .catalog import note_edges

    notes = vector_notes(spark, sf_dir)
    present = notes.where("id % 4 <> 1").select(jsons.string_field(F.col("metadata"), "path").alias("path"))
    kept = changes.pruned(notes, note_edges(spark, sf_dir), chunks(spark, sf_dir), changes.stale_notes(notes, present))
    rows = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("node", "edge", "chunk"), kept)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("select o_orderkey, 100 + row_number() over (order by o_orderkey) as id from orders")
def appended_ids(spark, sf_dir):
    """Ids that go on above the last one, by an order, without sorting in one task."""
    return changes.next_ids(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100).select("o_orderkey", "id")


@query("select 'nation:' || n_name as key, n_name as label, 'nation' as type from nation union all select 'region:' || r_name, upper(r_name) || '!', 'fresh' from region")
def upsert_first_writer(spark, sf_dir):
    """Entities that are stored keep label and type; new ones come in."""
    blank = F.lit(None).cast("array<float>")
    nodes = places(spark, sf_dir).where(F.col("type") == "nation").withColumns({"embedding": blank, "created_at": F.current_timestamp()})
    fresh = places(spark, sf_dir).where(F.col("type").isin("nation", "region")).withColumns({"label": F.concat(F.upper("label"), F.lit("!")), "type": F.lit("fresh"), "embedding": blank})
    columns = ["key", "label", "type", "metadata", "embedding"]
    return changes.upserted(nodes.select("id", *columns, "created_at"), fresh.select(columns), ("label", "type")).select("key", "label", "type")


@query("select l_orderkey, l_linenumber, l_partkey as target_id, l_orderkey + 5000000000 as source_id from lineitem")
def edges_by_key(spark, sf_dir):
    """Mentions by key, brought to ids."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("node:Part "), F.col("l_partkey").cast("string")).alias("target"), F.concat(F.lit("note:"), F.col("l_orderkey").cast("string")).alias("source"))
    parts = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("node:Part "), F.col("l_partkey").cast("string")).alias("key"), F.col("l_partkey").alias("id")).distinct()
    orders = t(spark, sf_dir, "orders").select(F.concat(F.lit("note:"), F.col("o_orderkey").cast("string")).alias("key"), (F.col("o_orderkey") + 5_000_000_000).alias("id"))
    return changes.with_ids(rows, parts.unionByName(orders)).select("l_orderkey", "l_linenumber", "target_id", "source_id")


@query("select doc_id, source || chr(10) || text as embedded, case when regexp_matches(text, '[\\p{L}\\p{N}]') then 1.0 else 0.0 end as length from documents where source <> ''")
def embedded_texts(spark, sf_dir):
    """Header and text as what is embedded, and the length of its vector without the header: one, or zero without words."""
    rows = t(spark, sf_dir, "documents").where("source <> ''").select("doc_id", "source", "text")
    rows = entities.embed(rows, F.coalesce("text", F.lit("")), HashingEmbedder(4096))
    return rows.select("doc_id", texts.embed_text(F.col("source"), F.col("text")).alias("embedded"), F.round(vectors.norm(F.col("embedding")), 3).alias("length"))


NAMES = (("un", "article"), ("The", "article"), ("erst", "word"))


@query("""select doc_id, list_sort(list_filter(['un', 'The', 'erst'], lambda n: regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || n || '($|[^\\p{L}\\p{N}_])', 'i')))::varchar[] as names from documents""".replace(
    "list_sort(", "array_to_string(list_sort(", 1).replace("::varchar[]", ", ',')"))
def extracted_names(spark, sf_dir):
    rows = entities.extract(t(spark, sf_dir, "documents").select("doc_id", "text"), GazetteerExtractor(NAMES))
    return rows.select("doc_id", F.array_join(F.sort_array(F.transform("entities", lambda e: e["label"])), ",").alias("names"))


@query("select vec_id, len(embedding) as n, round(embedding[1], 5)::double as first, round(embedding[64], 5)::double as last from embeddings")
def vector_blobs(spark, sf_dir):
    """Vectors to bytes and back."""
    rows = t(spark, sf_dir, "embeddings").select("vec_id", vectors.to_blob("embedding").alias("blob"))
    rows = rows.select("vec_id", vectors.from_blob("blob").alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.element_at("v", 1), 5).cast("double").alias("first"), F.round(F.element_at("v", 64), 5).cast("double").alias("last"))


@query("select event_id, props as object from events")
def json_objects(spark, sf_dir):
    """The object inside a text around it."""
    said = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` as asked"))
    return t(spark, sf_dir, "events").select("event_id", jsons.json_object(said).alias("object"))


# Communities and answers.


@query("select l_orderkey as a, l_partkey as b, 1 - l_discount as weight from lineitem where l_linenumber % 2 = 0 and l_partkey % 5 <> 0")
def entity_graph(spark, sf_dir):
    """Co-occurrences between entities; edges of other kinds, and ends that are notes or tags, go."""
    lines = t(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + BASES["nation"]).alias("target_id"), F.when(F.col("l_linenumber") % 2 == 0, "co_occurs_with").otherwise("mentions").alias("type"), (1 - F.col("l_discount")).alias("weight"))
    parts = lines.select((F.col("l_partkey") + BASES["nation"]).alias("id"), F.when(F.col("l_partkey") % 5 == 0, "tag").otherwise("part").alias("type"))
    nodes = parts.unionByName(lines.select(F.col("l_orderkey").alias("id"), F.lit("order").alias("type"))).distinct()
    return community.entity_graph(nodes, rows).select(F.col("source_id").alias("a"), (F.col("target_id") - BASES["nation"]).alias("b"), "weight")


@query("with c as (select label as id, count(*) as member_count from embeddings group by label) select id::bigint as id, 'community_0_' || id as label, member_count from c where id % 3 = 1")
def communities_of_level(spark, sf_dir):
    return store.communities(vector_communities(spark, sf_dir), level=1).select("id", "label", "member_count")


@query("""with c as (select distinct label as n from embeddings), r as (select row_number() over (order by n % 3, n) as id, n, n % 3 as level from c)
select r.id, 'community_' || r.level || '_' || r.n as label, p.id as parent_id, 'leiden' as algorithm, 'cpm' as quality_fn from r left join r p on p.level = r.level + 1 and p.n = r.n + 1""")
def communities_table(spark, sf_dir):
    """Detected communities as rows of the table: numbered by level and index, parents by id."""
    n = F.col("n").cast("int")
    rows = t(spark, sf_dir, "embeddings").select(F.col("label").alias("n")).distinct().select(n.alias("index"), (n % 3).alias("level"))
    known = {(int(r["index"]) % 3, int(r["index"])) for r in rows.collect()}  # ten labels
    up = F.when((F.col("level") < 2) & (F.col("index") + 1).isin([i for _, i in known]), F.concat(F.lit("community_"), (F.col("level") + 1).cast("string"), F.lit("_"), (F.col("index") + 1).cast("string")))
    rows = rows.withColumns({"label": F.concat(F.lit("community_"), F.col("level").cast("string"), F.lit("_"), F.col("index").cast("string")), "parent_label": up})
    return community.as_table(rows).select("id", "label", "parent_id", "algorithm", "quality_fn")


@dataclass(frozen=True)
class Naming:
    """Answers a summary's prompt by its second line, as JSON in a fence."""

    def generate(self, prompt: str) -> str:
        import json

        return "```json\n" + json.dumps({"summary": prompt.splitlines()[1], "keywords": ["k"]}) + "\n```"


@query("select label::bigint as id, 'Members: ' || string_agg('v' || vec_id, ', ' order by vec_id) as summary, 'k' as keywords, 0 as topics from embeddings group by label")
def community_summaries(spark, sf_dir):
    """Summaries of communities without one, from an answer that names the members."""
    blank = {"summary": "string", "summary_embedding": "array<float>", "keywords": "array<string>", "topics": "array<string>", "summary_tokens": "long", "summary_model": "string", "embed_model": "string"}
    found = vector_communities(spark, sf_dir).withColumns({c: F.lit(None).cast(k) for c, k in blank.items()})
    rows = t(spark, sf_dir, "embeddings")
    nodes = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"))
    edges = rows.where("vec_id > 0").select(F.col("vec_id").alias("source_id"), (F.col("vec_id") - 1).alias("target_id"), F.lit(0.5).alias("weight"))
    out = community.summarized(found, nodes, edges, Naming(), HashingEmbedder(16))
    return out.select("id", "summary", F.array_join("keywords", ",").alias("keywords"), F.size("topics").alias("topics"))


@dataclass(frozen=True)
class Fixed:
    """Embeds every text as one vector."""

    vector: tuple[float, ...]

    @property
    def dimension(self) -> int:
        return len(self.vector)

    def embed(self, texts):
        return np.tile(np.asarray(self.vector, dtype=np.float32), (len(texts), 1))


def answers(spark, sf_dir):
    """Five documents as results, best first, and the communities of the vectors."""
    rows = t(spark, sf_dir, "documents").where("text <> ''").orderBy("doc_id").limit(5)
    results = rows.select(F.col("doc_id").alias("id"), (-F.col("doc_id")).cast("double").alias("score"), F.col("source").alias("label"), F.lit("note").alias("type"), F.concat("source", F.lit(".md")).alias("file"), F.col("text").alias("content"), F.lit("").alias("chunk_text"))
    return results, vector_communities(spark, sf_dir), Fixed(tuple(query_vector(spark, sf_dir)))


ASKED_SQL = """with n as (select doc_id as id, source as label, case when length(text) <= 300 then text else substring(text, 1, 300) || '...' end as t from documents where text <> '' order by doc_id limit 5),
e as (select label::bigint as id, arg_min(embedding, vec_id)::double[] as v from embeddings group by label), q as (select embedding::double[] as qv from embeddings where vec_id = 0),
c as (select id, 'community_0_' || id as label, 'vectors of ' || id as s, list_cosine_similarity(v, qv) as x from e, q order by x desc, id limit 3), k as (select * from c where x > 0)"""


@dataclass(frozen=True)
class Echo:
    def generate(self, prompt: str) -> str:
        return prompt


@query(ASKED_SQL + r""" select 'Answer the question from what is given here, and name the notes that you use.' || chr(10) || chr(10) || '## Communities' || chr(10) || (select string_agg('Community: ' || label || chr(10) || s, chr(10) order by x desc, id) from k)
  || chr(10) || chr(10) || '## Notes' || chr(10) || (select string_agg('Note: ' || label || chr(10) || t, chr(10) order by id) from n) || chr(10) || chr(10) || 'Question: what is it?' as answer""")
def rag_prompt(spark, sf_dir):
    """The prompt of a question, as a generator sees it."""
    results, found, embedder = answers(spark, sf_dir)
    said = rag.ask("what is it?", results, found, embedder, Echo())
    return spark.createDataFrame([(said.answer,)], "answer string")


@query(ASKED_SQL + """, a as (select (select string_agg(label, ' ' order by x desc, id) from k) || ' ' || (select string_agg(label, ' ' order by id) from n) as answer)
select answer, min(id) as first, label, label || '.md' as path from n, a group by answer, label""")
def rag_answer(spark, sf_dir):
    """The answer of the extractive generator (what names the evidence), and its sources."""
    results, found, embedder = answers(spark, sf_dir)
    said = rag.ask("what is it?", results, found, embedder, ExtractiveGenerator())
    rows = spark.createDataFrame([(said.answer, s["label"], s["path"]) for s in said.sources], "answer string, label string, path string")
    return rows.join(results.groupBy("label").agg(F.min("id").alias("first")), "label").select("answer", "first", "label", "path")


@query("select 44::bigint as nodes, 20::bigint as notes, 24::bigint as entities, 113::bigint as edges, 20::bigint as chunks, 70::bigint as mentions")
def demo_corpus(spark, sf_dir):
    from .sources import seed

    made = seed.demo(spark)
    row = store.db_stats(made["nodes"], made["edges"], made["chunks"])
    return row.select("nodes", "notes", "entities", "edges", "chunks", F.lit(made["edges"].where("type = 'mentioned_in'").count()).alias("mentions"))
