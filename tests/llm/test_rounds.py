"""Packed arrays, kernels and the pipeline."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from labelweave.llm import kernels, rounds


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60))
def test_sorted_keys_round_trip(values):
    keys = np.sort(np.array(values, np.uint64))
    assert np.array_equal(rounds.load_sorted(rounds.dump_sorted(keys)), keys)


@given(st.lists(st.integers(-(1 << 62), 1 << 62), max_size=30), st.lists(st.integers(0, 255), max_size=9))
def test_arrays_round_trip(numbers, small):
    arrays = [np.array(numbers, np.int64), np.array(small, np.uint8), np.array([1 << 63], np.uint64)]
    for a, b in zip(arrays, rounds.load(rounds.dump(*arrays))):
        assert np.array_equal(a, b)


@settings(max_examples=60)
@given(st.lists(st.sampled_from(["a", "bb", " ", "\n", "\t", "longer-than-eight", "x" * 300]), max_size=40))
def test_words_and_their_names(parts):
    text = "".join(parts).encode() + b"\n"
    raw = np.frombuffer(text, np.uint8)
    starts, ends = kernels.words(raw)
    found = [text[a:z] for a, z in zip(starts, ends)]
    assert found == text.split()
    names = kernels.word_names(raw, starts, ends)
    assert len(set(names.tolist())) == len(set(found))


def test_names_of_equal_stretches():
    text = np.frombuffer(b"abcdefgh-xyz-" * 12, np.uint8)
    first = kernels.byte_names(text)
    for length in (16, 32, 50, 100):
        named = kernels.names(first, 8, length)
        assert len(named) == len(text) - length + 1
        assert len(set(named.tolist())) == 13


def test_window_min():
    h = np.random.default_rng(1).integers(0, 99, 50, np.uint64)
    assert kernels.window_min(h, 7).tolist() == [min(h[i : i + 7]) for i in range(44)]


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = rounds.stored(stage(spark, docs, folder))
        assert out.schema == docs.schema, name
        sizes.append(out.count())
        docs = out
    assert sizes[0] > 0.8 * 200 and sizes[1] == sizes[0] and sizes[2] <= sizes[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.filter("not round_trip").count() == 0 and last.count() >= 2 * sizes[3] - 5


def test_pipeline_of_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = rounds.stored(stage(spark, docs, folder))
    assert docs.count() == 0
