import re
from collections import Counter
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from notequarry.llm import quality

from .helpers import documents, odd_rows, prose, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_measures_of_difficult_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows())] + [(100, "a b c a b c a b\nx y #*\nx y #*\n\n"), (101, "a a a a a a"), (102, "a b c d")]
    out = quality.judged(documents(spark, rows), labels, ["doc_id"]).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out}
    assert got == {i: brute(t) for i, t in rows}
    assert all(r["kept"] != r["base_failed"] for r in out)


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 60, 900) for k in (0, 1, 5, 8) for p in (0.003, 0.02, 0.3) if k <= n]
    for p in {c[2] for c in cases}:
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in rows.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            exact = sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert r["t"] == pytest.approx(exact, rel=1e-9) or r["t"] == 1.0 and r["k"] >= r["n"] * p
    big = spark.range(1).select(quality.binomial_tail(F.lit(9_800), F.lit(1_000_000), 0.01)).first()[0]
    assert 0.02 < big < 0.025  # about two standard deviations below the mean


def test_thresholds_are_certified_and_keep_good_documents(spark, tmp_path):
    good = [(i, prose(i, 90)) for i in range(700)]
    bad = [(1000 + i, " | ".join(prose(i, 90).split())) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    risk = quality.Risk()
    out = {r["doc_id"]: r for r in quality.judged(docs, labels, ["doc_id"], risk=risk).collect()}
    assert all(out[i]["kept"] for i, _ in good) and not any(out[i]["kept"] for i, _ in bad) and out[1000]["rejected_by"] == "symbols"
    at = saved(spark, tmp_path, documents=docs.unionByName(docs.where("doc_id < 5")), labels=labels)
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.execute(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
        cursor = db.execute(quality.oracle(risk))
        columns, expected = [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))
    again = quality.judged(spark.read.parquet(f"{at}/documents.parquet"), labels, ["doc_id"], risk=risk).collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in again) == expected
    few = {r["doc_id"]: r for r in quality.judged(docs, labels.where("doc_id < 20 or doc_id >= 1000"), ["doc_id"], risk=risk).collect()}
    assert all(r["kept"] for r in few.values()), "too few good labels certify nothing"
    assert quality.judged(docs.limit(0), labels.limit(0), ["doc_id"]).count() == 0


def test_policies_by_brute_force_and_in_proportion_to_labels(spark):
    """Two strata: the larger one's policy is certified, the smaller one's labels can't do it; a policy that rejects too many good is not used."""
    good = [(i, prose(i, 60) + ("!" * 10 if i % 20 == 0 else ""), "en") for i in range(400)] + [(1000 + i, prose(i, 60), "fr") for i in range(40)]
    bad = [(2000 + i, " & ".join(prose(i, 60).split()), ("en", "fr")[i % 2]) for i in range(40)] + [(3000 + i, prose(i, 60) + "!" * 7, "en") for i in range(9)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    out = {r["doc_id"]: r["rejected_by"] for r in quality.judged(docs, labels, ["doc_id"]).collect()}
    # Of the good, 20 of 400 have 10 marks for 60 words: the policy that rejects them at 0.15 would take 5 % of them.
    def tail(k, n):
        return sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))

    assert tail(0, 400) <= 0.05 * 400 / 440 < tail(20, 400) and tail(0, 40) > 0.05 * 40 / 440
    assert all(out[i] is None for i, *_ in good) and all(out[3000 + i] is None for i in range(9))
    assert {out[2000 + i] for i in range(0, 40, 2)} == {"symbols"} and {out[2000 + i] for i in range(1, 40, 2)} == {None}


def test_stage_keeps_rows_as_they_are(spark, tmp_path):
    docs = documents(spark)
    at = saved(spark, tmp_path, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = quality.rejecting(spark, docs, at)
    assert out.columns == docs.columns
    expected = docs.where(F.col("_id").isin([k for k, (_, t) in enumerate(odd_rows()) if not brute(t)[-1]]))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, expected.collect()))
