"""The pipeline against the same stages done plainly."""

from collections import Counter

import pytest

import corpus_pipeline
from notequarry.llm import decontaminate, pii, tokens
from notequarry.llm.common import table

from .helpers import documents, odd_rows, prose, saved
from .test_decontaminate import ITEMS, edit_distance
from .test_pii import plainly as with_surrogates
from .test_quality import brute as measures
from .test_simhash import grouped
from .test_tokens import checked


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


KEY = "of the pipeline's test"


def plainly(rows):
    rows = [(i, t) for i, t in rows if not measures(t)[-1]]
    _, of = grouped(rows)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(of[k], []).append((i is None, i or 0, t, k))
    rows = [rows[min(own)[-1]] for own in groups.values()]

    def holds(text):
        w = decontaminate.words(text or "")
        for _, item in ITEMS:
            x = decontaminate.words(item)
            k = decontaminate.edits_allowed(len(x))
            for a in range(len(w)):  # at most k of the item's words are missing from a run that holds it
                if sum((Counter(w[a : a + len(x) + k]) & Counter(x)).values()) >= len(x) - k and any(edit_distance(x, w[a : a + n]) <= k for n in range(len(x) - k, len(x) + k + 1)):
                    return True
        return False

    rows = [r for r in rows if not holds(r[1])]
    return list(zip((i for i, _ in rows), with_surrogates([t for _, t in rows], KEY)))


def test_pipeline(spark, tmp_path, library, monkeypatch):
    monkeypatch.setenv(pii.SECRET_VARIABLE, KEY)
    spark.conf.unset(pii.SECRET)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "surrogates", "packing"]
    rows = [r for r in odd_rows() if r[0] != 8] + [(200, prose(900, 60) + " " + ITEMS[6][1] + " " + prose(901, 30)), (201, prose(902, 80) + " mail bob.42@mail7.example.com now"), (202, "a b c " * 40)]
    at = saved(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    expected = plainly(rows)
    ids = {i for i, _ in expected}
    assert 200 not in ids and 202 not in ids and 201 in ids and len(expected) < len(rows)
    checked(expected, corpus_pipeline.run(spark, at).collect(), library)
    docs = table(spark, at, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).schema == docs.schema, name
        assert stage(spark, docs.limit(0), at).count() == 0
