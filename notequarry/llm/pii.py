"""Keyed surrogates for personal data, in DataFrame functions only.

E-mail addresses, IPv4 addresses, payment cards that pass their check digit, social security numbers, telephone numbers
and names after a title are found by one expression. Each gets a surrogate of its kind, derived from a keyed hash of its
canonical form: the same entity gets the same surrogate everywhere, in the format in which it stands there (separators,
letter case, script, a title's gender, a telephone's country code, a valid check digit).

Names are resolved to persons. Within a document a surname after a title stands for the first full name with that surname
whose gender doesn't contradict it, and shows that person's new surname. A title without gender (Dr) takes the gender of the
document's other mentions of the person; where it has none, that of the same name elsewhere in the corpus (the first of f
and m if both occur), and where that has none either, one by a hash of the name.

Surrogates are checked over the whole corpus: one that is an entity of the corpus, or the surrogate of another entity,
is derived again with the next attempt (of entities that meet, the first in order keeps its own), until all differ. Names
are held apart by their surnames, as these may stand alone. Entities with later attempts, or with a gender that only the
corpus knows, are the only ones that reach the texts by a join; all others are computed in place.

The key comes from the setting `spark.notequarry.surrogate.secret` or the environment's NOTEQUARRY_SURROGATE_SECRET. If
neither is set, a random one is drawn for the session: surrogates then hold within it, and nobody can derive them again.

Defined cases: a null text stays null; texts without entities stay as they are; repeated rows get the same result;
null doc_ids take part, and rows that share an id are told apart by their texts; an empty table gives an empty one; very
long texts are searched whole, in one row; columns beside doc_id and text are kept, whatever their names.
"""

from __future__ import annotations

import os
import secrets as random_keys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, unused

KINDS = ("email", "ip", "card", "ssn", "phone", "name")
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "г-жа")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLE = r"(?<![\p{L}\d])(?:" + "|".join(sorted((*MALE, *FEMALE, "Dr"), key=len, reverse=True)) + r")\.? "
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    r"(?<![\d.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\d|\.\d)",
    r"(?<![\d\-])(?:\d{16}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|3[47]\d{13})(?![\d])",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",
    r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
    r"(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
    TITLE + r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
))
#: What a text with an entity has; cheaper to look for. From first to last digit an entity has 7 characters (8.8.8.8) or
#: more, and only telephone numbers with a plus sign have as few as 5 (+12233).
QUICK = r"@|\d[\d .()\-]{5,}\d|\+\d[\d .()\-]{3,}\d|(?:" + "|".join((*MALE, *FEMALE, "Dr")) + r")\.? \p{Lu}"
LETTERS, CYRILLIC = "bcdfghklmnprstvz", "бвгджзклмнпрстфх"
VOWELS, CYRILLIC_VOWELS = "aeiouaeiouaeioua", "аеиоуаеиоуаеиоуа"
HEX = "0123456789abcdef"
NAMES = {
    (False, "m"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lucas", "Martin", "Oscar", "Paul", "Simon"),
    (False, "f"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Sara"),
    (True, "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур"),
    (True, "f"): ("Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Майя", "Нина", "Ольга", "Полина", "Раиса"),
}
MAX_ATTEMPTS = 40
SECRET, SECRET_VARIABLE = "spark.notequarry.surrogate.secret", "NOTEQUARRY_SURROGATE_SECRET"


def secret(spark: SparkSession) -> str:
    """The key of the session; a drawn one is noted in its settings."""
    found = spark.conf.get(SECRET, None) or os.environ.get(SECRET_VARIABLE)
    if not found:
        found = random_keys.token_hex(32)
        spark.conf.set(SECRET, found)
    return found


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn_sum(number: Column, weights_from_right: int) -> Column:
    """The sum of digits where every second one, counted from the right, is doubled; the first doubled is at `weights_from_right`."""
    each = F.split(F.reverse(number), "")
    each = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when((i + weights_from_right) % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def kind_of(m: Column) -> Column:
    """Null where a card's check digit is wrong: no entity."""
    number = digits(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(m.rlike(r"^\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}$|^3[47]\d{13}$"), F.when(luhn_sum(number, 0) % 10 == 0, "card"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\p{L}"), "name")
        .otherwise("phone")
    )


def bare_name(m: Column) -> Column:
    return F.regexp_replace(m, "^" + TITLE.split(")", 1)[1], "")


def gender(m: Column) -> Column:
    """Of the title; null for one that says nothing."""
    title = F.regexp_extract(m, r"^([\p{L}\-]+)", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f")


def guessed(of: Column) -> Column:
    """A person's canonical form with a gender by its name's hash where it has none (?:name)."""
    even = F.pmod(F.xxhash64(F.substring(of, F.lit(3), F.length(of))), F.lit(2)) == 0
    return F.when(of.startswith("?:"), F.concat(F.when(even, "m").otherwise("f"), F.substring(of, F.lit(2), F.length(of)))).otherwise(of)


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def with_persons(rows: DataFrame, found: str, to: str) -> DataFrame:
    """rows with an array `to`: of each name in found (kind, m) the canonical form of its person (gender:name, gender m, f or ?).

    Null where found has no names. Each step is a column of its own, as steps are used several times."""
    names, full = unused(rows, "_names"), unused(rows, "_full")
    is_name = F.exists(found, lambda e: e["kind"] == "name")
    each = F.transform(found, lambda e: F.struct(F.when(e["kind"] == "name", F.lower(bare_name(e["m"]))).alias("name"), F.when(e["kind"] == "name", gender(e["m"])).alias("g")))
    rows = rows.withColumn(names, F.when(is_name, each))

    def known(e: Column) -> Column:
        """The gender of a full name: of its own mentions, else of its surname's."""

        def mentioned(name: Column) -> Column:
            return first(F.transform(F.filter(names, lambda x: (x["name"] == name) & x["g"].isNotNull()), lambda x: x["g"]))

        return F.coalesce(e["g"], mentioned(e["name"]), mentioned(F.substring_index(e["name"], " ", -1)))

    people = F.filter(names, lambda e: e["name"].contains(" "))
    rows = rows.withColumn(full, F.transform(people, lambda e: F.struct(e["name"].alias("name"), F.substring_index(e["name"], " ", -1).alias("last"), known(e).alias("g"))))

    def form(e: Column) -> Column:
        of = first(F.filter(full, lambda p: F.when(e["name"].contains(" "), p["name"] == e["name"]).otherwise(p["last"] == e["name"]) & (p["g"].isNull() | e["g"].isNull() | (p["g"] == e["g"]))))
        return F.struct(e["name"].alias("name"), e["g"].alias("g"), of.alias("of"))

    def told(e: Column) -> Column:
        return F.when(e["name"].isNotNull(), F.concat(F.coalesce(e["g"], e["of"]["g"], F.lit("?")), F.lit(":"), F.coalesce(e["of"]["name"], e["name"])))

    return rows.withColumn(to, F.transform(F.transform(names, form), told)).drop(names, full)


def canonical(kind: Column, m: Column, person: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits(m)))
        .when(kind == "name", person)
        .otherwise(digits(m))
    )


def shaped(form: Column, letters: Column, numbers: Column) -> Column:
    """form with its letters and digits replaced by those given, in turn and in its case."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("l"), F.lit(0).alias("d"))

    def step(s: Column, c: Column) -> Column:
        digit, letter = c.rlike(r"^\d$"), c.rlike(r"^\p{L}$")
        x = F.substring(letters, s["l"] % F.length(letters) + 1, F.lit(1))
        y = F.when(digit, F.substring(numbers, s["d"] % F.length(numbers) + 1, F.lit(1))).when(letter, F.when(c.rlike(r"^\p{Lu}$"), F.upper(x)).otherwise(x)).otherwise(c)
        return F.struct(F.concat(s["out"], y).alias("out"), (s["l"] + letter.cast("int")).alias("l"), (s["d"] + digit.cast("int")).alias("d"))

    return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def keyed(kind: Column, of: Column, attempt: Column, key: str) -> Column:
    """The hash that a surrogate is made of; a value of its own, as many parts of it are used."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, of, attempt.cast("string")), 256)


def surrogate(kind: Column, of: Column, attempt: Column, code: Column) -> Column:
    """The canonical surrogate of a canonical form, from keyed()."""

    def number(i: int) -> Column:
        return F.conv(F.substring(code, 1 + 15 * i, 15), 16, 10).cast("long")

    def run(i: int) -> Column:
        return F.lpad((number(i) % 10**15).cast("string"), 15, "0")

    numbers = F.concat(run(0), run(1))
    letters = F.translate(F.substring(code, 31, 24), HEX, LETTERS)
    area = F.concat((number(2) % 8 + 2).cast("string"), numbers)
    n = F.length(of)
    card = F.concat(F.substring(of, 1, 1), F.substring(numbers, F.lit(1), n - 2))
    check = F.pmod(10 - F.pmod(luhn_sum(card, 1), F.lit(10)), F.lit(10)).cast("string")
    country = F.when(of.startswith("+1"), "+1").otherwise(F.when(of.startswith("+"), F.substring(of, 1, 3)).otherwise(""))
    octets = [number(i) for i in range(4)]
    cyrillic = of.rlike(r"\p{IsCyrillic}")

    def word(at: int, n: int, other: bool) -> Column:
        consonants, vowels = (CYRILLIC, CYRILLIC_VOWELS) if other else (LETTERS, VOWELS)
        return F.concat(*(F.translate(F.substring(code, at + i, 1), HEX, vowels if i % 2 else consonants) for i in range(n)))

    def name(other: bool) -> Column:
        first = F.when(of.startswith("m:"), F.element_at(F.array(*map(F.lit, NAMES[other, "m"])), (number(0) % 16 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, NAMES[other, "f"])), (number(0) % 16 + 1).cast("int")))
        last = F.when(attempt == 0, word(20, 8, other)).otherwise(word(20, 12, other))
        return F.concat(F.substring(of, 1, 2), F.lower(F.when(of.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)))

    return (
        F.when(kind == "email", F.concat(shaped(F.substring_index(of, "@", 1), letters, numbers), F.lit("@"), F.substring(letters, 13, 8), F.lit(".example.org")))
        .when(kind == "ip", F.concat_ws(".", (octets[0] % 223 + 1).cast("string"), *((x % 256).cast("string") for x in octets[1:])))
        .when(kind == "card", F.concat(card, check))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(numbers, 1, 8)))
        .when(kind == "phone", F.concat(country, F.substring(area, F.lit(1), n - F.length(country))))
        .otherwise(F.when(cyrillic, name(True)).otherwise(name(False)))
    )


def formatted(kind: Column, m: Column, to: Column) -> Column:
    """A canonical surrogate in the format of the match."""
    title = F.substring(m, F.lit(1), F.length(m) - F.length(bare_name(m)))
    bare = F.substring(to, F.lit(3), F.length(to))
    bare = F.when(bare_name(m).contains(" "), bare).otherwise(F.substring_index(bare, " ", -1))
    bare = F.when(bare_name(m) == F.upper(bare_name(m)), F.upper(bare)).otherwise(F.initcap(bare))
    return (
        F.when(kind == "email", F.when(m == F.upper(m), F.upper(to)).otherwise(to))
        .when(kind == "ip", to)
        .when(kind == "name", F.concat(title, bare))
        .otherwise(shaped(m, F.lit("x"), digits(to)))
    )


def with_entities(rows: DataFrame, to: str) -> DataFrame:
    """rows with an array `to` of (kind, of, m) of all matches in text, in order; kind and of are null for those that are no entities."""
    found, whose = unused(rows, "_found"), unused(rows, "_whose")
    text = F.col("text")
    matches = F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(found, F.transform(matches, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m"))))
    rows = with_persons(rows, found, whose)
    named = F.when(F.col(whose).isNull(), F.array_repeat(F.lit(None).cast("string"), F.size(found))).otherwise(F.col(whose))
    return rows.withColumn(to, F.zip_with(found, named, lambda e, p: F.struct(e["kind"].alias("kind"), canonical(e["kind"], e["m"], p).alias("of"), e["m"].alias("m")))).drop(found, whose)


def apart(kind: Column, to: Column) -> Column:
    """What must differ between surrogates: of names the surname."""
    return F.when(kind == "name", F.regexp_replace(to, r"^..(?:.* )?", "")).otherwise(to)


def attempts(corpus: DataFrame, key: str) -> DataFrame:
    """(kind, of, attempt) of the entities whose first surrogate met another; corpus: kind, of, distinct."""
    spark = corpus.sparkSession
    done = taken = corpus.select("kind", apart(F.col("kind"), F.col("of")).alias("to"))
    pending, late = corpus, None
    for k in range(MAX_ATTEMPTS):
        each = F.struct(F.col("kind"), F.col("of"), keyed(F.col("kind"), F.col("of"), F.lit(k), key).alias("code"))
        new = F.transform(F.array(each), lambda e: surrogate(e["kind"], e["of"], F.lit(k), e["code"]))  # noqa: B023  called at once
        tried = stored(pending.select("kind", "of", apart(F.col("kind"), new[0]).alias("to")), "pii-tried")
        won = stored(tried.join(taken, ["kind", "to"], "left_anti").groupBy("kind", "to").agg(F.min("of").alias("of")), "pii-won")
        pending = stored(tried.join(won, ["kind", "of"], "left_anti").select("kind", "of"), "pii-pending")
        done = done.unionByName(won.select("kind", "to"))
        taken = done
        if k:
            got = won.select("kind", "of", F.lit(k).alias("attempt"))
            late = got if late is None else late.unionByName(got)
        if not pending.limit(1).count():
            return late if late is not None else spark.createDataFrame([], "kind string, of string, attempt int")
    raise RuntimeError(f"surrogates still meet after {MAX_ATTEMPTS} attempts")


def special(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, of, e: to whom of belongs, attempt) of the entities that can't be computed in place; None if there are none."""
    corpus = stored(found.select("kind", "of").distinct(), "pii-corpus")
    bare, unknown = F.substring(F.col("of"), F.lit(3), F.length("of")), F.col("of").startswith("?:")
    names = corpus.where("kind = 'name'")
    if names.where(unknown).limit(1).count():
        known = names.where(~unknown).groupBy(bare.alias("bare")).agg(F.min(F.substring("of", 1, 1)).alias("g"))
        asked = names.where(unknown).select("kind", "of", bare.alias("bare")).join(known, "bare")
        asked = asked.select("kind", "of", F.concat("g", F.lit(":"), "bare").alias("_person"))
        corpus = stored(corpus.join(asked, ["kind", "of"], "left").select("kind", "of", F.coalesce("_person", guessed(F.col("of"))).alias("whose")), "pii-persons")
    else:
        corpus = corpus.withColumn("whose", F.col("of"))
    late = attempts(corpus.select("kind", F.col("whose").alias("of")).distinct(), key)
    late = late.select("kind", F.col("of").alias("whose"), "attempt")
    rows = corpus.join(late, ["kind", "whose"], "left").where(F.col("attempt").isNotNull() | (F.col("whose") != guessed(F.col("of"))))
    rows = stored(rows.select("kind", "of", F.struct("whose", F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("e")), "pii-special")
    return rows if rows.limit(1).count() else None


def replaced(docs: DataFrame, key: str | None = None, counts: bool = False) -> DataFrame:
    """docs with surrogates in text, and with counts n_<kind> if asked for; key: that of the session if None."""
    key = key or secret(docs.sparkSession)
    columns = docs.columns
    own, found_in, special_in = (unused(docs, c) for c in ("_id", "_e", "_special"))
    rows = docs.withColumn(own, F.struct(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.xxhash64(F.lit(own), F.col("text"))))
    # Of explode() Spark would infer a filter on the array, and push it, with all that makes the array, below the steps.
    found = with_entities(rows.where(F.col("text").rlike(QUICK)), found_in).select(F.col(own).alias("id"), F.explode_outer(found_in).alias("e"))
    found = stored(found.select("id", "e.kind", "e.of").where("kind is not null"), "pii-entities")
    more = special(found, key)
    if more is not None:
        named = found.distinct().join(more, ["kind", "of"]).groupBy(F.col("id").alias(own)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "of"), "e"))).alias(special_in))
        rows = rows.join(named, own, "left")
    else:
        rows = rows.withColumn(special_in, F.lit(None).cast("map<string,struct<whose:string,attempt:int>>"))
    rows = with_entities(rows, found_in)

    # Step by step over the array: what a step makes of an entity is computed once, however often the next uses it.
    def resolved(e: Column) -> Column:
        known = F.element_at(F.col(special_in), F.concat_ws("|", e["kind"], e["of"]))
        return F.struct(e["kind"].alias("kind"), e["m"].alias("m"), F.when(e["kind"] == "name", guessed(e["of"])).otherwise(e["of"]).alias("of"), known.alias("known"))

    def tried(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), e["m"].alias("m"), F.coalesce(e["known"]["whose"], e["of"]).alias("of"), F.coalesce(e["known"]["attempt"], F.lit(0)).alias("attempt"))

    def coded(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), e["m"].alias("m"), e["of"].alias("of"), e["attempt"].alias("attempt"), keyed(e["kind"], e["of"], e["attempt"], key).alias("code"))

    def new(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), e["m"].alias("m"), surrogate(e["kind"], e["of"], e["attempt"], e["code"]).alias("to"))

    made = F.col(found_in)
    for step in (resolved, tried, coded, new):
        made = F.transform(made, step)
    made = F.transform(made, lambda e: F.when(e["kind"].isNull(), e["m"]).otherwise(formatted(e["kind"], e["m"], e["to"])))
    between = F.split(F.col("text"), PATTERN, -1)
    put = F.zip_with(between, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    rows = rows.withColumn("text", F.when(F.size(found_in) > 0, F.array_join(put, "")).otherwise(F.col("text")))
    tally = [F.size(F.filter(found_in, lambda e: e["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS] if counts else []  # noqa: B023  called at once
    return rows.select(*(F.col(f"`{c}`") for c in columns), *tally)


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: every document's text with surrogates, and the number of entities by kind."""
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def replacing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with surrogates; all documents stay."""
    return replaced(docs)
