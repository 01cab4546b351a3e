"""The queries of the driver contract and the SQL that they are held against.

The tables of the driver are read as a knowledge base: vectors as chunks of notes (five to a note), documents as notes
with their metadata, parts that share an order as entities that co-occur, suppliers, customers, nations and regions as a
graph. Every query takes whole tables; limits are those of the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import texts, vectors
from .functions.jsons import real
from .operators import changes, entities, filters, fts, graph, hybrid, rag, render, vector
from .sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The driver's tables as a knowledge base.


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).cast("long").alias("note_id"), F.concat(F.lit("# "), F.col("label").cast("string")).alias("header"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding")


def vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for every five vectors."""
    ids = chunks(spark, sf_dir).select("note_id").distinct()
    label = F.concat(F.lit("Note "), F.col("note_id").cast("string"))
    meta = F.to_json(F.struct(F.concat(F.lit("notes/"), F.col("note_id").cast("string"), F.lit(".md")).alias("path"), (F.col("note_id") % 7).alias("rank")))
    return ids.select(F.col("note_id").alias("id"), F.concat(F.lit("note:notes/"), F.col("note_id").cast("string"), F.lit(".md")).alias("key"), label.alias("label"), F.lit("note").alias("type"), meta.alias("metadata"))


def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes linked to the note of half their number."""
    return vector_notes(spark, sf_dir).where("id > 0").select("id", F.col("id").alias("source_id"), F.floor(F.col("id") / 2).cast("long").alias("target_id"), F.lit("links").alias("type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("context"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    meta = F.to_json(F.struct(path.alias("path"), F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), "lang", "n_chars"))
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("note:"), path).alias("key"), F.col("source").alias("label"), F.lit("note").alias("type"), meta.alias("metadata"))


BASES = {"region": 1_000_000_000, "nation": 2_000_000_000, "supplier": 3_000_000_000, "customer": 4_000_000_000}


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey"}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, base in BASES.items():
        part = t(spark, sf_dir, name).select((F.col(KEYS[name]).cast("long") + base).alias("id"), F.col(f"{name[0]}_name").alias("label"), F.lit(name).alias("type"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumns({"key": F.concat("type", F.lit(":"), "label"), "metadata": F.lit(None).cast("string")})


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, type, weight): customers and suppliers in nations, nations in regions."""
    parts = (("nation", "n_nationkey", "region", "n_regionkey", 0.8), ("supplier", "s_suppkey", "nation", "s_nationkey", 1.0), ("customer", "c_custkey", "nation", "c_nationkey", 0.5))
    rows = None
    for a, own, b, other, weight in parts:
        part = t(spark, sf_dir, a).select((F.col(own).cast("long") + BASES[a]).alias("source_id"), (F.col(other).cast("long") + BASES[b]).alias("target_id"), F.lit("belongs_to").alias("type"), F.lit(weight).alias("weight"), F.lit(None).cast("string").alias("context"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


PLACES_SQL = """places as (
  select r_regionkey + 1000000000::bigint as id, r_name as label, 'region' as type from region
  union all select n_nationkey + 2000000000::bigint, n_name, 'nation' from nation
  union all select s_suppkey + 3000000000::bigint, s_name, 'supplier' from supplier
  union all select c_custkey + 4000000000::bigint, c_name, 'customer' from customer),
links as (
  select n_nationkey + 2000000000::bigint as a, n_regionkey + 1000000000::bigint as b, 0.8::double as weight from nation
  union all select s_suppkey + 3000000000::bigint, s_nationkey + 2000000000::bigint, 1.0::double from supplier
  union all select c_custkey + 4000000000::bigint, c_nationkey + 2000000000::bigint, 0.5::double from customer),
both_ways as (select a, b, weight from links union all select b, a, weight from links)"""
CHUNKS_SQL = "chunks as (select vec_id as id, vec_id // 5 as note_id, '# ' || label as header, 'chunk ' || vec_id as text, embedding::double[] as v from embeddings), q as (select v as qv from chunks where id = 0)"


def fts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fts.indexed(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content")))
    return store.cut(rows, "fts")


FTS_SQL = r"""d as (select doc_id as id,
    ' ' || array_to_string(regexp_extract_all(lower(strip_accents(source)), '[\p{L}\p{N}]+'), ' ') || ' ' as title,
    ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), ' ') || ' ' as content,
    len(regexp_extract_all(lower(strip_accents(source)), '[\p{L}\p{N}]+')) + len(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) as length
  from documents where text <> '')"""


def bm25_sql(counts: list[str], condition: str, limit: str) -> str:
    f = ", ".join(f"{c} as f{i}" for i, c in enumerate(counts))
    n = ", ".join(f"count(*) filter (where f{i} > 0) as n{i}" for i in range(len(counts)))
    score = " + ".join(f"(case when ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 then ln((N - n{i} + 0.5) / (n{i} + 0.5)) else 1e-6 end) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(counts)))
    return f"with {FTS_SQL}, c as (select *, {f} from d), s as (select count(*) as N, avg(length) as mean, {n} from c) select id, round(r, 6) as rank from (select id, -({score}) as r from c, s where {condition}) {limit}"


def times(word: str) -> str:
    """How often a word stands in either column, in SQL: blanks are doubled so that matches don't share them."""
    return f"((length(replace(title || content, ' ', '  ')) - length(replace(replace(title || content, ' ', '  '), ' {word} ', ''))) // {len(word) + 2})"


def ranked(index: DataFrame, text: str, limit: int | None) -> DataFrame:
    return fts.search(index, text, limit).withColumn("rank", F.round("rank", 6))


# Vectors.


@query(f"with {CHUNKS_SQL} select id, note_id, header, text, round(list_cosine_similarity(v, qv), 6) as similarity from chunks, q order by list_cosine_similarity(v, qv) desc, id limit 10")
def vector_topk(spark, sf_dir):
    return vector.topk_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))


@query(f"with {CHUNKS_SQL} select id, round(sqrt(list_inner_product(v, v)), 6) as norm, round(list_inner_product(v, qv), 6) as dot, round(list_cosine_similarity(v, qv), 6) as cosine from chunks, q")
def vector_functions(spark, sf_dir):
    q, v = vectors.literal(query_vector(spark, sf_dir)), F.col("embedding")
    return chunks(spark, sf_dir).select("id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.dot(v, q), 6).alias("dot"), F.round(vectors.cosine(v, q), 6).alias("cosine"))


SIMILAR_SQL = f"""with {CHUNKS_SQL}, s as (select v as sv from chunks where note_id = 0),
p as (select note_id, id, header, text, max(list_cosine_similarity(v, sv)) as c from chunks, s where note_id <> 0 group by all),
n as (select note_id, greatest(0.0, max(c)) as similarity, arg_max(header, (c, -id)) as header, arg_max(text, (c, -id)) as text, max(c) as m from p group by note_id),
k as (select *, similarity as score from n order by similarity desc, note_id limit 10)
select note_id, round(similarity, 6) as similarity, case when m > 0 then header else '' end as header, case when m > 0 then text else '' end as text,
  round(case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else score end, 6) as score from k"""


@query(SIMILAR_SQL)
def similar_by_label(spark, sf_dir):
    note = graph.resolve_label(vector_notes(spark, sf_dir), "Note 0")
    own = [r[0] for r in store.chunks_of(chunks(spark, sf_dir), note).select("embedding").collect()]
    found = vector.similar_notes(chunks(spark, sf_dir), own, 10, note)
    return found.withColumns({"similarity": F.round("similarity", 6), "score": F.round("score", 6)})


@query(f"with {CHUNKS_SQL}, n as (select note_id, greatest(0.0, max(list_cosine_similarity(v, qv))) as similarity from chunks, q group by note_id) select note_id, round(similarity, 6) as similarity from n")
def note_similarities(spark, sf_dir):
    return vector.note_similarities(chunks(spark, sf_dir), [query_vector(spark, sf_dir)]).select("note_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {CHUNKS_SQL}, r as (select *, list_cosine_similarity(v, qv) as c, row_number() over (partition by note_id order by list_cosine_similarity(v, qv) desc, id) as k from chunks, q) select id, note_id, round(c, 6) as similarity from r where k = 1")
def best_chunk_per_note(spark, sf_dir):
    q = vectors.literal(query_vector(spark, sf_dir))
    rows = chunks(spark, sf_dir).select("id", "note_id", vectors.cosine(F.col("embedding"), q).alias("similarity"))
    return vector.first_per_note(rows).withColumn("similarity", F.round("similarity", 6))


@query("select s_suppkey, case when max(s_acctbal) over () > min(s_acctbal) over () then (s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over ()) else s_acctbal end as score from supplier")
def minmax_normalised(spark, sf_dir):
    return vector.min_max(t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score")), "score")


@query(f"""with {CHUNKS_SQL}, k as (select id, note_id, list_cosine_similarity(v, qv) as c from chunks, q order by c desc, id limit 20),
b as (select note_id, max(c) as c from k group by note_id)
select note_id, 'Note ' || note_id as label, round(0.7 * (c + case when note_id in (0, 3) then 0.1 else 0.0 end + 0.2), 6) as score from b where note_id % 7 < 5""")
def hybrid_rerank(spark, sf_dir):
    notes = vector_notes(spark, sf_dir).withColumn("label", F.when(F.col("id").isin(0, 3), F.concat("label", F.lit(" special"))).otherwise(F.col("label")))
    top = vector.topk_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), 20)
    rows = hybrid.reranked(notes, top, "something SPECIAL", 0.7, ["rank < 5"])
    return rows.select("note_id", F.regexp_replace("label", " special$", "").alias("label"), F.round("score", 6).alias("score"))


HYBRID_SQL = f"""with recursive {CHUNKS_SQL}, n as (select distinct note_id from chunks),
e as (select note_id as a, note_id // 2 as b from n where note_id > 0 union select note_id // 2, note_id from n where note_id > 0),
k as (select *, list_cosine_similarity(v, qv) as c from chunks, q order by c desc, id limit 10),
best as (select *, 0.7 * (c + 0.1 + 0.2) as score from k qualify row_number() over (partition by note_id order by c desc, id) = 1),
cand as (select *, row_number() over (order by score desc, note_id) as r from best),
near as (select origin, id, min(d) as d from (select note_id as origin, b as id, 0 as d from cand join e on a = note_id union all select note_id, y.b, 1 from cand join e x on x.a = note_id join e y on y.a = x.b) where id <> origin group by origin, id),
listed as (select origin, list({{'id': id, 'label': 'Note ' || id, 'type': 'note', 'distance': d}} order by d, id) as l from (select * from near qualify row_number() over (partition by origin order by d, id) <= 20) group by origin),
c as (select cand.*, coalesce(l, []) as l, coalesce(list_transform(l[:3], lambda x: x.id), []) as three from cand left join listed on origin = note_id),
w as (select 0::bigint as r, []::struct(id bigint, r bigint, own boolean)[] as found
  union all select c.r, case when list_contains(list_transform(found, lambda x: x.id), c.note_id) then found else found || [{{'id': c.note_id, 'r': c.r, 'own': true}}]
    || list_transform(list_filter(three, lambda y: not list_contains(list_transform(found, lambda x: x.id), y)), lambda y: {{'id': y, 'r': c.r, 'own': false}}) end from w join c on c.r = w.r + 1),
shown as (select unnest(found, recursive := true) from (select found from w order by r desc limit 1)),
rows as (select s.id, s.own, case when own then c.score else (1 - 0.7) * c.score end as score, c.l, c.header, c.text from shown s join c on c.r = s.r order by score desc, s.id limit 20)
select id, 'Note ' || id as label, 'note' as type, round(case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else score end, 6) as score,
  case when own then text else '' end as content, 'notes/' || id || '.md' as file, case when own then to_json(l)::varchar else '[]' end as neighbors, case when own then header else '' end as chunk_header, case when own then text else '' end as chunk_text from rows"""


@query(HYBRID_SQL)
def hybrid_search(spark, sf_dir):
    out = hybrid.hybrid_search(vector_notes(spark, sf_dir), note_edges(spark, sf_dir), chunks(spark, sf_dir), "note about nothing", query_vector(spark, sf_dir), k=10, depth=1)
    return out.withColumns({"score": F.round("score", 6), "neighbors": F.to_json("neighbors")})


# Metadata.


@query("select event_id from events where try_cast(json_extract_string(props, '$.k') as double) >= 50")
def metadata_filter_numeric(spark, sf_dir):
    return t(spark, sf_dir, "events").where(filters.all_of(F.col("props"), ["k >= 50"])).select("event_id")


@query("select doc_id as id from documents where lang = 'fr'")
def metadata_filter_string(spark, sf_dir):
    return documents(spark, sf_dir).where(filters.all_of(F.col("metadata"), ["lang = fr"])).select("id")


@query("select doc_id as id from documents where lang <> 'en' and n_chars > 1000")
def metadata_filter_and(spark, sf_dir):
    return documents(spark, sf_dir).where(filters.all_of(F.col("metadata"), ["lang != en", "n_chars > 1000"])).select("id")


@query("select event_type, count(*) as events, 0::bigint as without_it, count(*) as with_it from events group by event_type")
def metadata_filter_missing(spark, sf_dir):
    """A field that no event has is never selected, not even by !=; one that all have is."""
    rows = t(spark, sf_dir, "events")
    lacking, having = (filters.all_of(F.col("props"), [f]) for f in ("nothing != 5", "k != -5"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(lacking).alias("without_it"), F.count_if(having).alias("with_it"))


@query("select o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^\\s*([+-]?[0-9]+)', 1) as double), 0.0) as n from orders")
def real_coercion(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", real(F.col("o_orderpriority")).alias("n"))


# Graphs.


def expand_sql(weight: str) -> str:
    return f"""with recursive {PLACES_SQL},
w as (select b as id, 0 as level from both_ways where a = 1000000001 {weight}
  union select e.b, w.level + 1 from w join both_ways e on e.a = w.id where w.level < 1 {weight.replace('weight', 'e.weight')})
select p.id, p.label, p.type, min(level)::int as distance from w join places p using (id) where p.id <> 1000000001 group by p.id, p.label, p.type order by distance, type, id limit 20"""


@query(expand_sql(""))
def graph_neighbors(spark, sf_dir):
    return graph.expand_neighbors(places(spark, sf_dir), place_edges(spark, sf_dir), BASES["region"] + 1, 1)


@query(expand_sql("and weight >= 0.8"))
def graph_neighbors_weighted(spark, sf_dir):
    return graph.expand_neighbors(places(spark, sf_dir), place_edges(spark, sf_dir), BASES["region"] + 1, 1, min_weight=0.8)


@query("""with a as (select c_name, n_name, n_nationkey, n_regionkey from customer join nation on n_nationkey = c_nationkey order by c_custkey limit 1),
b as (select s_name, nation.n_name, nation.n_nationkey from supplier join nation on n_nationkey = s_nationkey join a on a.n_regionkey = nation.n_regionkey order by s_suppkey desc limit 1),
x as (select case when a.n_nationkey = b.n_nationkey then [c_name, a.n_name, s_name] else [c_name, a.n_name, r_name, b.n_name, s_name] end as path from a, b, region where r_regionkey = a.n_regionkey)
select generate_subscripts(path, 1)::int as step, unnest(path) as label from x""")
def graph_shortest_path(spark, sf_dir):
    """From the first customer to the last supplier of its region."""
    nodes, nation = places(spark, sf_dir), t(spark, sf_dir, "nation")
    customers = t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name, region = customers.agg(F.min_by(F.struct("c_name", "n_regionkey"), "c_custkey")).first()[0]
    end = t(spark, sf_dir, "supplier").join(nation.where(F.col("n_regionkey") == region), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.max_by("s_name", "s_suppkey")).first()[0]
    found = graph.shortest_path(nodes, place_edges(spark, sf_dir), f"customer:{name}", f"supplier:{end}") or [] if end else []
    return spark.createDataFrame(list(enumerate(found, 1)), "step int, label string")


SUBGRAPH_SQL = f"""with recursive {PLACES_SQL}, w as (select 1000000001::bigint as id, 0 as level union select b, level + 1 from w join both_ways on a = id where level < 2),
n as (select * from places where id in (select id from w))"""


@query(SUBGRAPH_SQL + " select id, label, type from n")
def graph_subgraph_nodes(spark, sf_dir):
    return graph.subgraph(places(spark, sf_dir), place_edges(spark, sf_dir), "region:" + region_name(spark, sf_dir), 2)[0]


@query(SUBGRAPH_SQL + " select a as source_id, b as target_id, 'belongs_to' as type, weight from links where a in (select id from n) and b in (select id from n)")
def graph_subgraph_edges(spark, sf_dir):
    return graph.subgraph(places(spark, sf_dir), place_edges(spark, sf_dir), "region:" + region_name(spark, sf_dir), 2)[1].drop("context")


def region_name(spark, sf_dir) -> str:
    return t(spark, sf_dir, "region").where("r_regionkey = 1").first()["r_name"]


@query("select min(doc_id) as id from documents where source = 'src3'")
def resolve_label(spark, sf_dir):
    return spark.createDataFrame([(graph.resolve_label(documents(spark, sf_dir), "src3"),)], "id long")


@query(f"with {PLACES_SQL} select a as id, count(*) as degree from both_ways group by a")
def graph_degrees(spark, sf_dir):
    return graph.degrees(place_edges(spark, sf_dir))


@query(f"""with recursive {PLACES_SQL}, r as (select id, id as component from places union select b, component from r join both_ways on a = id)
select id, min(component) as component from r where id in (select a from both_ways) group by id""")
def graph_components(spark, sf_dir):
    """All customers and suppliers hang on the nations of a region."""
    return graph.components(place_edges(spark, sf_dir))


# Notes, entities, changes.


def order_parts(spark, sf_dir) -> DataFrame:
    """Orders as chunks whose entities are the parts of their lines, scored by what isn't discounted."""
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount"))).alias("l"))
    each = F.transform("l", lambda x: F.struct(x["l_partkey"].cast("string").alias("id"), F.concat(F.lit("Part "), x["l_partkey"].cast("string")).alias("label"), F.lit("part").alias("type"), F.round(1 - x["l_discount"], 4).alias("score")))
    return rows.select(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("path"), F.lit("# lines").alias("header"), each.alias("entities"))


@query("""select 'node:Part ' || a.l_partkey as source, 'node:Part ' || b.l_partkey as target, 'co_occurs_with' as type, least(round(1 - a.l_discount, 4), round(1 - b.l_discount, 4)) as weight, 'orders/' || a.l_orderkey || '.md## lines' as context
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and (a.l_linenumber, a.l_partkey, a.l_discount) < (b.l_linenumber, b.l_partkey, b.l_discount) and a.l_partkey <> b.l_partkey""")
def co_occurrence_edges(spark, sf_dir):
    return entities.co_occurrences(order_parts(spark, sf_dir))


@query("select 'node:Part ' || l_partkey as source, 'note:orders/' || l_orderkey || '.md' as target, 'mentioned_in' as type, round(1 - l_discount, 4) as weight, 'orders/' || l_orderkey || '.md## lines' as context from lineitem")
def mentioned_in_edges(spark, sf_dir):
    return entities.mentions(order_parts(spark, sf_dir))


def doc_notes(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), texts.tags(F.concat("lang", F.lit(", , "), "source")).alias("tags"))


@query("select 'note:' || source || '/' || doc_id || '.md' as source, 'node:' || source as target, 'belongs_to' as type, 1.0::double as weight from documents where source not in ('notas', 'muestra', '')")
def belongs_to_edges(spark, sf_dir):
    return entities.memberships(doc_notes(spark, sf_dir), "root").drop("context")


@query("select 'note:' || source || '/' || doc_id || '.md' as source, 'node:' || unnest([lang, source]) as target, 'tagged_with' as type, 1.0::double as weight from documents")
def tagged_with_edges(spark, sf_dir):
    return entities.taggings(doc_notes(spark, sf_dir)).drop("context")


@query("select c_custkey + 4000000000::bigint as id from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def orphan_nodes(spark, sf_dir):
    """Customers without urgent orders; nations, regions and suppliers all have edges."""
    nodes = places(spark, sf_dir)
    links = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + BASES["customer"]).alias("source_id"), F.col("o_orderkey").alias("target_id"))
    links = links.unionByName(place_edges(spark, sf_dir).where(F.col("source_id") < BASES["customer"]).select("source_id", "target_id"))
    return nodes.select("id").join(changes.without_orphans(nodes, links).select("id"), "id", "left_anti")


@query("select doc_id as id from documents where lang = 'de'")
def stale_notes(spark, sf_dir):
    present = doc_notes(spark, sf_dir).where(F.element_at("tags", 1) != "de")
    return changes.stale_notes(documents(spark, sf_dir), present).select("id")


@query("select source || '/' || doc_id || '.md' as path, sha256(text || case when lang = 'es' then '!' else '' end) as hash from documents where lang = 'es'")
def changed_files(spark, sf_dir):
    files = t(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(F.concat("text", F.when(F.col("lang") == "es", "!").otherwise("")), 256).alias("hash"))
    return changes.changed(files, documents(spark, sf_dir)).select("path", "hash")


@query("""select 'nation:' || n_name as key, case when n_nationkey % 2 = 0 then upper(n_name) || '!' else n_name end as label, 'nation' as type from nation
union all select 'region:' || r_name, r_name, 'region' from region""")
def upsert_nodes(spark, sf_dir):
    nodes = places(spark, sf_dir).where(F.col("type") == "nation").withColumns({"embedding": F.lit(None).cast("array<float>"), "created_at": F.current_timestamp()})
    fresh = nodes.where("id % 2 = 0").withColumns({"label": F.concat(F.upper("label"), F.lit("!")), "type": F.lit("other")})
    more = places(spark, sf_dir).where(F.col("type") == "region").withColumn("embedding", F.lit(None).cast("array<float>"))
    columns = ["key", "label", "type", "metadata", "embedding"]
    return changes.upserted(nodes.select("id", *columns, "created_at"), fresh.select(columns).unionByName(more.select(columns)), ("type",)).select("key", "label", "type")


# Full text.


@query(bm25_sql([times("un")], "f0 > 0", "order by r, id limit 10"))
def fts_match(spark, sf_dir):
    return ranked(fts_docs(spark, sf_dir), "un", 10)


@query(bm25_sql([times("un"), times("erst")], "f0 > 0 or f1 > 0", ""))
def fts_bm25(spark, sf_dir):
    return ranked(fts_docs(spark, sf_dir), "un OR erst", None)


@query(bm25_sql([r"len(regexp_extract_all(title, ' src1[^ ]*')) + len(regexp_extract_all(content, ' src1[^ ]*'))"], "f0 > 0", ""))
def fts_prefix(spark, sf_dir):
    return ranked(fts_docs(spark, sf_dir), "src1*", None)


@query(bm25_sql([times("of  the")], "f0 > 0", ""))
def fts_phrase(spark, sf_dir):
    return ranked(fts_docs(spark, sf_dir), '"of the"', None)


@query(f"with {FTS_SQL} select id from d where (content like '% of %' or content like '% de %') and content like '% the %' and not (content like '% was %')")
def fts_boolean(spark, sf_dir):
    return fts.search(fts_docs(spark, sf_dir), "(content:of OR content:de) AND content:the NOT content:was", None).select("id")


@query(f"with {FTS_SQL} select id from d where regexp_matches(content, ' of ([^ ]+ ){{0,2}}that ') or regexp_matches(content, ' that ([^ ]+ ){{0,2}}of ')")
def fts_near(spark, sf_dir):
    return fts.search(fts_docs(spark, sf_dir), "NEAR(of that, 2)", None).select("id")


@query(f"with {FTS_SQL} select id, length from d")
def doc_lengths(spark, sf_dir):
    return fts_docs(spark, sf_dir).select("id", F.col("length").cast("long").alias("length"))


@query(r"""with w as (select doc_id as id, unnest(regexp_extract_all(lower(strip_accents(source)), '[\p{L}\p{N}]+')) as term from documents where text <> ''
  union all select doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) from documents where text <> '')
select term, count(distinct id) as n, count(*) as occurrences from w group by term""")
def term_frequencies(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))
    # A term's documents: rows of one (term, id, col) are unique, so a document counts once if it is counted by its id.
    return fts.postings(docs).groupBy("term", "id").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("occurrences"))


# Text functions.


@query("""select doc_id, case when strlen(text) <= 200 then text else substring(text, 1, 200) || '...' end as clipped, case when length(text) <= 300 then text else substring(text, 1, 300) || '...' end as truncated,
  'note:' || source as note_key, 'node:' || lang as node_key, strlen(text) // 4 + strlen(source) // 4 as estimate, sha256(text) as hash from documents""")
def text_functions(spark, sf_dir):
    text = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", texts.clip_text(text, 200).alias("clipped"), texts.truncate_chars(text, 300).alias("truncated"), texts.note_key(F.col("source")).alias("note_key"), texts.node_key(F.col("lang")).alias("node_key"), texts.token_estimate(text, F.col("source")).alias("estimate"), F.sha2(text, 256).alias("hash"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(left(text, 80))), '[^a-z0-9\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-') as slug from documents")
def slugify(spark, sf_dir):
    """Slugs in all languages."""
    return t(spark, sf_dir, "documents").select("doc_id", texts.slugify(F.substring("text", 1, 80)).alias("slug"))


@query(r"""with b as (select 'pages/' || page_id || '.md' as path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
    '(?is)<h([1-3])[^>]*>', chr(10) || '@H\1 ', 'g'), '(?is)</h[1-3]>', chr(10), 'g'), '<[^>]*>', ' ', 'g') as body from pages),
l as (select path, unnest(string_split(replace(replace(replace(body, '@H1 ', '# '), '@H2 ', '## '), '@H3 ', '### '), chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as i from b),
h as (select *, regexp_matches(line, '^#{1,3}\s+\S') as head from l), g as (select *, count(*) filter (where head) over (partition by path order by i) as g from h),
p as (select path, g, coalesce(max(trim(line, ' ' || chr(9) || chr(13))) filter (where head), '') as header, trim(coalesce(string_agg(line, chr(10) order by i) filter (where not head), ''), ' ' || chr(9) || chr(10) || chr(13)) as text from g group by path, g)
select path, (row_number() over (partition by path order by g) - 1)::int as ord, header, text,
  trim(regexp_replace(regexp_replace(lower(strip_accents(left(text, 80))), '[^a-z0-9\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-') as slug from p where strlen(text) >= 50""")
def chunk_sections(spark, sf_dir):
    """Headings of pages as Markdown, cut into chunks."""
    from .sources import markdown

    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", ""), r"(?is)<h([1-3])[^>]*>", "\n@H$1 ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)</h[1-3]>", "\n"), "<[^>]*>", " ")
    for i in (1, 2, 3):
        body = F.regexp_replace(body, f"@H{i} ", "#" * i + " ")
    files = t(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), body.alias("text"), F.sha2("html", 256).alias("hash"))
    return markdown.note_chunks(markdown.parsed(files))


@query(r"""select doc_id, lang, source, length(text) as body_chars from documents""")
def frontmatter_fields(spark, sf_dir):
    from .sources import markdown

    text = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\nsource:  "), "source", F.lit("\n---\n"), "text")
    files = t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.length("text").alias("n"), F.length(F.trim("text")).alias("m"))
    rows = markdown.parsed(files)
    return rows.select(F.col("fields")["id"].cast("long").alias("doc_id"), F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"), (F.length("body") + F.col("n") - F.col("m")).cast("long").alias("body_chars"))


@query("""select o_custkey, label, type, score, k from (select o_custkey, o_orderpriority as label, 'concept' as type, 0.5::double + o_totalprice / 1e7 as score,
  row_number() over (partition by o_custkey, lower(o_orderpriority) order by o_orderkey) as k from orders where 0.5::double + o_totalprice / 1e7 >= 0.5) where k = 1""")
def entity_dedupe(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("type"), (0.5 + F.col("o_totalprice") / 1e7).alias("score"))
    return entities.raw_entities(rows, ["o_custkey"]).select("o_custkey", "label", "type", "score", F.lit(1).cast("long").alias("k"))


@query("""with s as (select l_orderkey, coalesce(case when l_linenumber > 1 then l_linenumber end - 1, 0) as section, l_linenumber, 'part ' || l_partkey as label from lineitem)
select l_orderkey, section::int as section, array_to_string(list(label order by l_linenumber, label), ', ') as labels from s where section < 4 group by l_orderkey, section""")
def entity_sections(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("section"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("label"), F.lit("part").alias("type"), F.lit(1.0).alias("score"))
    return entities.by_section(rows, ["l_orderkey"], F.lit(4)).select("l_orderkey", F.col("section").cast("int").alias("section"), F.array_join("labels", ", ").alias("labels"))


# Listings, communities, evidence.


@query(f"with {PLACES_SQL} select (select count(*) from places) as nodes, 0::bigint as notes, (select count(*) from places) as entities, 0::bigint as tags, (select count(*) from links) as edges, (select count(*) from embeddings) as with_embeddings, (select count(*) from embeddings) as chunks")
def db_stats(spark, sf_dir):
    return store.db_stats(places(spark, sf_dir), place_edges(spark, sf_dir), chunks(spark, sf_dir))


@query(f"with {PLACES_SQL} select id, type || ':' || label as key, label, type from places")
def node_listing(spark, sf_dir):
    return store.node_listing(places(spark, sf_dir), "entity")


@query(f"with {PLACES_SQL}, k as (select a as id, * from links order by a limit 500) select k.id, x.label as source, y.label as target, 'belongs_to' as type, weight from k join places x on x.id = a join places y on y.id = b")
def edge_listing(spark, sf_dir):
    """The first edges of the whole graph; an edge's id is that of its source, which has one edge only."""
    return store.edge_listing(places(spark, sf_dir), place_edges(spark, sf_dir).withColumn("id", F.col("source_id"))).drop("context")


def vector_communities(spark, sf_dir) -> DataFrame:
    """The vectors of each label as a community, its summary's vector being that of the least id."""
    rows = t(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("id")).agg(F.min_by("embedding", "vec_id").alias("summary_embedding"), F.sort_array(F.collect_list("vec_id")).alias("member_ids"), F.count(F.lit(1)).alias("member_count"))
    return rows.withColumns({"label": F.concat(F.lit("community_0_"), F.col("id").cast("string")), "summary": F.concat(F.lit("vectors of "), F.col("id").cast("string")), "level": (F.col("id") % 3).cast("int")})


COMMUNITIES_SQL = "c as (select label::bigint as id, arg_min(embedding, vec_id)::double[] as v, count(*) as member_count, (label % 3)::int as level from embeddings group by label), q as (select embedding::double[] as qv from embeddings where vec_id = 0)"


@query(f"with {COMMUNITIES_SQL} select id, 'community_0_' || id as label, 'vectors of ' || id as summary, round(list_cosine_similarity(v, qv), 6) as similarity from c, q order by list_cosine_similarity(v, qv) desc, id limit 2")
def related_communities(spark, sf_dir):
    return vector.related_communities(vector_communities(spark, sf_dir), query_vector(spark, sf_dir), 2).withColumn("similarity", F.round("similarity", 6))


@query(f"with {COMMUNITIES_SQL}, k as (select id, list_cosine_similarity(v, qv) as s from c, q order by s desc, id limit 5) select id, round(s, 6) as similarity from k where s > 0")
def community_topn(spark, sf_dir):
    return vector.related_communities(vector_communities(spark, sf_dir), query_vector(spark, sf_dir), 5, 0.0).select("id", F.round("similarity", 6).alias("similarity"))


@query("select label::bigint as id, unnest(list(vec_id)) as member from embeddings group by label")
def community_members(spark, sf_dir):
    return vector_communities(spark, sf_dir).select("id", F.explode("member_ids").alias("member"))


@query("select (label % 3)::int as level, count(distinct label) as communities, count(*) as members from embeddings group by label % 3")
def community_level_counts(spark, sf_dir):
    from .operators.community import level_counts

    return level_counts(vector_communities(spark, sf_dir))


@query()
def community_detect(spark, sf_dir):
    """Parts that share orders, in communities."""
    from .operators import community

    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("p"), F.round(1 - F.col("l_discount"), 4).alias("w"))
    other = lines.select("l_orderkey", F.col("p").alias("q"), F.col("w").alias("x"))
    pairs = lines.join(other, "l_orderkey").where("p < q").select(F.col("p").alias("source_id"), F.col("q").alias("target_id"), F.lit("co_occurs_with").alias("type"), F.least("w", "x").alias("weight"))
    nodes = lines.select(F.col("p").alias("id")).distinct().withColumn("type", F.lit("part"))
    return community.detect(nodes, pairs, 0.5).withColumn("member_ids", F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ","))


def as_results(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("rank"), F.col("source").alias("label"), F.lit("note").alias("type"), F.when(F.col("doc_id") % 3 > 0, F.concat("source", F.lit("/"), "lang", F.lit(".md"))).alias("file"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 400)).otherwise("").alias("chunk_text"))


@query("""select doc_id as rank, source as label, case when length(x) <= 300 then x else substring(x, 1, 300) || '...' end as text
from (select *, case when doc_id % 2 = 0 and text <> '' then substring(text, 1, 400) else text end as x from documents) order by doc_id limit 5""")
def rag_evidence(spark, sf_dir):
    return rag.evidence(as_results(spark, sf_dir))


@query("""with r as (select doc_id as rank, source as label, case when doc_id % 3 > 0 then source || '/' || lang || '.md' end as path from documents),
k as (select *, row_number() over (partition by coalesce('f:' || path, 'l:' || label) order by rank) as n from r) select rank, label, path from k where n = 1""")
def rag_sources(spark, sf_dir):
    return rag.sources(as_results(spark, sf_dir))


@query("select '- [' || source || '](' || source || '/' || lang || '.md)' as line from documents where doc_id % 3 > 0")
def result_markdown_list(spark, sf_dir):
    return render.links(as_results(spark, sf_dir))


from . import inventory  # noqa: E402, F401  registers its queries here
