"""Periodic runs against a plain search of all periods."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm import periodic, queries


def plain_runs(w, least):
    """All runs by trying every period, the smallest first."""
    w, found = np.array(w), {}
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-p] == w[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if z + p - a >= max(least, 2 * p):
                found.setdefault((a, z + p - a), p)
    return sorted((a, length, p) for (a, length), p in found.items())


def plain_kept(w, runs):
    gone = set()
    for a, length, p in runs:
        gone.update(range(a + p, a + length))
    return [x for i, x in enumerate(w) if i not in gone]


sequence = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.lists(st.integers(0, 9), min_size=1, max_size=9).flatmap(
        lambda x: st.integers(0, 90).map(lambda n: ([11, 12] + x * 90)[: n + 2])
    ),
)


@settings(max_examples=120, deadline=None)
@given(st.lists(sequence, max_size=5), st.sampled_from([2, 4, 12]))
def test_runs_of_sequences(sequences, least):
    first = np.cumsum([0, *map(len, sequences)])
    ids = np.array([x for s in sequences for x in s], np.int64)
    found = list(zip(*(x.tolist() for x in periodic.maximal_runs(ids, first, least))))
    expected = [(a + int(first[k]), n, p) for k, s in enumerate(sequences) for a, n, p in plain_runs(s, least)]
    assert sorted(found) == sorted(expected)


def test_reported_runs(docs, rows, none):
    found = periodic.periodic_runs(docs, least=4).collect()
    expected = []
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        runs = plain_runs(w, 4) if w else []
        expected.append((i, len(w), runs, b" ".join(plain_kept(w, runs)).decode()))
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found) == sorted(expected)
    assert sum(len(e[2]) for e in expected) >= 2
    assert periodic.periodic_runs(none).count() == 0


def test_a_null_id_and_a_long_text(spark):
    text = "a b c " * 40_000 + "d"
    frame = spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")
    found = periodic.periodic_runs(frame).collect()
    assert sorted(r.n_words for r in found) == [0, 120_001, 120_001]
    for r in found:
        assert [tuple(x) for x in r.runs] == ([(0, 120_000, 3)] if r.n_words else [])
        assert r.collapsed == ("a b c d" if r.n_words else "") and (r.doc_id == 1) == (r.n_words == 0)


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert len(found) == len(docs)
    digest, changed = (lambda s: hashlib.sha256(s).hexdigest()), 0
    for d in docs:
        w, r = (d.text or "").encode().split(), found[d.doc_id]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(w, 12) if w else []
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode())
        assert r.collapsed_sha256 == digest(b" ".join(plain_kept(w, runs)))
    assert changed > 10
