"""URL filters in DataFrame functions: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

A rule decides where it fits. For the rest, the listed canonical URLs are put into a blocked Bloom filter: a hash picks
one block of eight 32-bit words, eight 5-bit parts of another hash one bit in each of them. The filter is a table of
blocks; it is broadcast if its number of blocks, known from the count of the list, is within a bound, and joined by a
shuffle on the block beyond that. Only URLs that the filter passes go to the exact join with the list, which removes the
filter's false positives; all others never meet the list. The pages are read once for that: what is judged of each (not
its html) is written to the shared folder, and hits and the rest are taken from there.

The list is an input: a Parquet table with a column `url` or `key`, named by the setting `spark.notequarry.urlList`.
Without that setting the query makes a stand-in from its own pages, see default_list().

Defined cases: a null URL or one without "://" has empty host and path, no rule, and is allowed; an empty list blocks
nothing; repeated pages each get their row, whatever their ids; null entries of the list don't count, repeated ones count
once; a very long URL is one key like any other; columns beside page_id and url are left out, so that no name clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): host, then path from its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labels of hosts whose pages are on the stand-in list.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Parameters that don't belong to a canonical URL.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
#: The table of listed URLs, by this setting.
LIST_SETTING = "spark.notequarry.urlList"
KEYS_PER_BLOCK = 16
BROADCAST_BLOCKS = 250_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and m., path without a slash at its end, and the parameters that count, in order."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    base = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.length(base) > 0, F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def ruled(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.expr("shiftleft(1, cast(shiftrightunsigned(_h, %d) & 31 as int))" % (5 * i)) for i in range(8)], h


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of the keys in column `key`."""
    words, h = masks(F.col("key"))
    rows = listed.select(block_of(F.col("key"), blocks).alias("block"), h.alias("_h"))
    return rows.groupBy("block").agg(*(F.bit_or(w).alias(f"w{i}") for i, w in enumerate(words)))


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; listed: canonical URLs in column `key`."""
    listed = stored(listed.select("key").where("key is not null").distinct(), "listed-urls")
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    table_of_blocks = bloom(listed, blocks)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), canonical(F.col("url")).alias("key"))
    words, h = masks(F.col("key"))
    rows = rows.withColumns({"block": F.when(F.col("rule").isNull(), block_of(F.col("key"), blocks)), "_h": h})
    if blocks <= BROADCAST_BLOCKS:
        rows = rows.join(F.broadcast(table_of_blocks), "block", "left")
    else:  # rows that no block can pass stay out of the shuffle, where they would all be one key
        probed = rows.where("block is not null").join(table_of_blocks, "block", "left")
        rows = probed.unionByName(rows.where("block is null"), allowMissingColumns=True)
    passes = F.col("rule").isNull() & F.col("key").isNotNull()
    for i, w in enumerate(words):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(w) != 0)
    rows = stored(rows.select("page_id", "host", "path", "rule", "verdict", F.when(passes, F.col("key")).alias("key")), "judged-urls")
    hits = rows.where("key is not null").join(listed.withColumn("on_list", F.lit(True)), "key", "left")
    out = ["page_id", "host", "path", "rule", "verdict"]
    hits = hits.withColumn("verdict", F.when(F.col("on_list"), "block").otherwise("allow")).select(out)
    rest = rows.where("key is null").withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(out)
    return rest.unionByName(hits)


def default_list(pages: DataFrame) -> DataFrame:
    """(key): a stand-in for a list of single URLs: the canonical URLs of pages under listed labels, and of one in sixteen of
    all others, by the first digit of the URL's MD5, which neither host nor path gives away."""
    labels = F.split(host(F.col("url")), r"\.", -1)
    rows = pages.select(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS))).alias("bad"), canonical(F.col("url")).alias("key"))
    return rows.where(F.col("bad") | F.md5(F.col("key").cast("binary")).startswith("0")).select("key")


def listed_urls(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(key): the table of the setting, its URLs made canonical where it holds `url`; else the stand-in."""
    at = spark.conf.get(LIST_SETTING, None)
    if not at:
        return default_list(pages)
    rows = spark.read.parquet(at)
    return rows.select("key") if "key" in rows.columns else rows.select(canonical(F.col("url")).alias("key"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: the verdict on every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, listed_urls(spark, pages))


ORACLE = r"""
with p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) as params
  from pages),
k as (
  select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') as base,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from p),
c as (select *, case when base <> '' then base || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as key from k),
l as (select distinct key from c where key is not null and (md5(key) like '0%' or list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])))
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when l.key is not null then 'block' else 'allow' end as verdict
from c left join l on c.key = l.key
"""
