"""Ranked lexical search against a plain scoring of all documents."""

import math
import re
from collections import Counter

import pytest

from labelweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1]]
    return [
        (1, texts[10][:200]), (2, texts[20][:90].upper()), (3, "ba do ba do ké"), (4, None), (5, "?!"),
        (6, "absent words only"), (7, texts[12]), (7, "BA ba one 日本"), (8, " ".join(texts[5:30])),
    ]


@pytest.mark.parametrize("limit", [300, 20_000, 16 << 20])
def test_ranks(spark, docs, rows, items, limit, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", limit)
    monkeypatch.setattr(lexical.indexed, "__defaults__", (limit,))
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for k in (1, 10):
        found = [tuple(r) for r in lexical.search(docs, frame, k).collect()]
        assert sorted(found) == sorted(plain_search([r[:2] for r in rows], items, k))


def test_ties_and_null_ids(spark):
    texts = [(None, "same text"), *((i, "same text") for i in range(300, 0, -1)), (None, None), (301, "other words here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "text"), (2, "HERE")], "item_id long, text string")
    found = sorted(tuple(r)[:3] for r in lexical.search(docs, items, 10).collect())
    assert found == [*((1, k, k) for k in range(1, 11)), (2, 1, 301)]
    few = spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "a b c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    # a term of every document weighs little, but more than nothing
    assert [r.doc_id for r in lexical.search(few, one).orderBy("rank").collect()] == [5, None, None]


def test_blocks_of_items(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(lexical.blocks, "__defaults__", (100,))
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in lexical.search(docs, frame).collect()]
    assert sorted(found) == sorted(plain_search([r[:2] for r in rows], items, 10))


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "ba")], "item_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    for d in (none, empty, blank):
        assert lexical.search(d, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
