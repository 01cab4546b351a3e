import duckdb

from notequarry.llm import urls

from .helpers import saved

PAGES = [
    (1, None), (2, "nope"), (3, "http://A.NET"), (4, "x://org/fr/"), (5, "http://EXample.net/en/?q://"), (5, "http://EXample.net/en/?q://"), (6, "https://a.Example.com/de/x"), (7, "https://example.com/de"),
    (8, "https://notexample.com/de/"), (9, "http://x.net/"), (10, "http://example.net/en"), (11, "HTTP://www.Spam-Farm.example.org/a/?utm_source=x&b=2&a=1#f"), (12, "https://m.spam-farm.example.org/a?a=1&b=2"),
    (13, "https://spam-farm.example.org/fr/x"), (14, "https://good.example.org/a?ref=1"), (15, "https://good.example.org/a"), (16, "://"), (17, "http://é.org/ä?ö#ü"), (18, ""), (None, "http://x.net/y"),
]


def test_against_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "x", "clash", "clash") for i, u in PAGES], "page_id long, url string, html string, key string, block string")
    at = saved(spark, tmp_path, pages=pages)
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from '{at}/pages.parquet/*.parquet'")
        cursor = db.execute(urls.ORACLE)
        columns = [c[0] for c in cursor.description]
        expected = sorted(map(repr, cursor.fetchall()))
    out = urls.url_filter(spark, at)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in out.collect()) == expected
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()}
    assert verdicts[11] == verdicts[12] == (None, "block") and verdicts[13] == ("org/fr/", "allow") and verdicts[9] == ("net/", "block") and verdicts[3] == (None, "allow")


def test_filter_passes_every_listed_key_and_the_join_removes_the_rest(spark, monkeypatch):
    listed = spark.createDataFrame([(f"h{i}.org/p",) for i in range(400)] + [(None,)], "key string")
    pages = spark.createDataFrame([(i, f"https://h{i}.org/p") for i in range(2000)], "page_id long, url string")
    for most in (250_000, 0):  # broadcast, and by a shuffle
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", most)
        out = urls.judged(pages, listed, ())
        assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(400)) and out.count() == 2000
    none = urls.judged(pages, listed.limit(0), ())
    assert none.where("verdict = 'block'").count() == 0 and urls.judged(pages.limit(0), listed).count() == 0


def test_list_is_an_input_table(spark, tmp_path):
    at = saved(spark, tmp_path, pages=spark.createDataFrame([(1, "http://www.a.org/x/?utm_source=q"), (2, "http://a.org/y"), (3, "http://b.org/")], "page_id long, url string"))
    spark.createDataFrame([("https://m.a.org/x#top",), (None,)], "url string").write.parquet(f"{tmp_path}/list")
    spark.conf.set(urls.LIST_SETTING, f"{tmp_path}/list")
    try:
        found = {r["page_id"]: r["verdict"] for r in urls.url_filter(spark, at).collect()}
    finally:
        spark.conf.unset(urls.LIST_SETTING)
    assert found == {1: "block", 2: "allow", 3: "allow"}
