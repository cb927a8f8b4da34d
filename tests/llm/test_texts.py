"""Fingerprints, segmentations, token files, mixing and the classifier."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from labelweave.llm import (
    cotraining,
    linededup,
    mixing,
    rounds,
    simhash,
    suffixes,
    superkmer,
    token_files,
    winnowing,
)
from labelweave.llm import segmentations as seg
from labelweave.llm.queries import vocabulary


def plain_winnowing(text):
    raw, k, w = text.encode("utf-32-be"), winnowing.K, winnowing.W
    h = [(xxhash.xxh64_intdigest(raw[4 * i : 4 * (i + k)], 42) & (1 << 35) - 1, -i) for i in range(max(1, len(text) - k + 1))]
    return list(dict.fromkeys(min(h[i : i + w]) for i in range(max(1, len(h) - w + 1))))


def test_fingerprints(docs, rows):
    rows = sorted(((r[0], r[1] or "") for r in rows))
    found = winnowing.report(docs).collect()
    assert len(found) == len(rows)

    def digest(kept):
        values = ((h << 28) + (1 << 28) - 1 + p for h, p in kept)
        return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()

    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b)

    expected = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, new = plain_winnowing(text), plain_winnowing(edited)
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(new),
                         near(own, new), near(own, plain_winnowing(after)), len(own)))
    assert sorted(map(tuple, found)) == sorted(expected)


def test_fingerprint_positions(docs):
    row = next(r for r in winnowing.fingerprints(docs.select("doc_id", "text")).collect() if r.doc_id == 24)
    assert [(k.hash, -k.position) for k in row.kept] == plain_winnowing(row.text)


def test_no_python_on_the_native_path(docs):
    plan = winnowing.report(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


TOY = [(c, i, -2.0 - 0.3 * i) for i, c in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba", "bab", "▁ab"])]


def toy_segmentations(text):
    def of(word):
        if not word:
            return [((), 0.0)]
        return [((i, *rest), w + x) for p, i, w in TOY if word.startswith(p) for rest, x in of(word[len(p) :])]

    every = [((), 0.0)]
    for word in seg.words_of(text):
        every = [(a + b, x + y) for a, x in every for b, y in of(word)]
    total = np.logaddexp.reduce([x for _, x in every])
    return {a: float(np.exp(x - total)) for a, x in every}


def test_samples_without_replacement():
    lattice = seg.Lattice(TOY, [100 + i for i in range(256)], -9.0)
    n, text = 20_000, "aba ab"
    p = toy_segmentations(text)
    out = seg.Sampler(lattice, [text] * n, seg.row_keys(list(range(n)), 5), 3).run()
    drawn = []
    for o in out:
        path = o["path"]
        drawn.append([tuple(lattice.piece_ids(path.edges[a:z]).tolist()) for a, z in zip(path.bounds[:-1], path.bounds[1:])])
        assert np.allclose(o["log_prob"], [np.log(p[s]) for s in drawn[-1]], atol=1e-4)
    assert all(len(set(x)) == 3 for x in zip(*drawn))
    assert (out[0]["value"] > out[1]["value"]).all() and (out[1]["value"] > out[2]["value"]).all()
    first, second = Counter(drawn[0]), Counter(drawn[1])
    twice = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    assert max(abs(first[s] / n - p[s]) for s in p) < 0.015
    assert max(abs(second[s] / n - twice[s]) for s in p) < 0.015
    # inclusion scores count the segmentations without bias
    assert sum((1 / o["inclusion"]).sum() for o in out) / n == pytest.approx(len(p), rel=0.05)


def test_all_segmentations_of_a_short_text():
    lattice = seg.Lattice(TOY, [100 + i for i in range(256)], -9.0)
    p = toy_segmentations("a")
    out = seg.Sampler(lattice, ["a"], seg.row_keys([7], 5), 5).run()
    found = [o for o in out if len(o["rows"])]
    assert len(found) == len(p) and all(o["inclusion"][0] == pytest.approx(1) for o in found)


def test_segmentations_decode(docs, rows):
    model = vocabulary("piece_bpe_32k.model")
    out = seg.segmentations(docs, model).cache()
    back = {(r.doc_id, r.sample): r.text for r in seg.decoded(out, model).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    got = out.collect()
    assert all(r.round_trip and back[r.doc_id, r.sample] == texts[r.doc_id] for r in got)
    assert Counter(r.doc_id for r in got)[0] == 1  # an empty text has one
    ids = {(r.doc_id, r.sample): bytes(r.ids) for r in got}
    assert all(ids[i, 1] != ids[i, 2] for i, s in ids if s == 2)
    again = seg.segmentations(docs.repartition(2), model).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(9001, "a <|endoftext|> b don't STOP"), (9002, "x" * 5000)]
    every = sorted([*((r[0], r[1]) for r in rows[:-1]), *extra])
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    at, expected = 0, []
    for i, text in every:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_table(frame, path).collect())) == expected


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 1 << b, 200, np.uint32) for b in (8, 16, 24, 32)])
    counts = np.array([0, 1, 3, 4, 5, 787])
    control, data, quads, data_of = token_files.code(values, counts)
    back = token_files.decode(control, data)
    starts = np.cumsum(quads * 4) - quads * 4
    found = np.concatenate([back[s : s + n] for s, n in zip(starts, counts)])
    assert np.array_equal(found, values) and data_of.sum() == len(data)


def test_mix(docs, rows):
    out = mixing.mix_plan(mixing.sized(docs)).toPandas()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    level, total = 0.0, sum(sizes.values())
    for _ in range(50):
        full = [s for s in names if 3 * sizes[s] < weight[s] * level]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
    for source in names:
        mine = out[out.source.isna()] if source is None else out[out.source == source]
        target = min(3 * sizes[source], weight[source] * level)
        assert (mine.source_size == sizes[source]).all() and np.allclose(mine.target, target)
        assert abs(mine.taken.sum() - target) <= max(2, 0.01 * target)
    assert (out.taken <= 3 * out["size"]).all()


def test_small_sources_of_a_large_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEATS", 2048)
    monkeypatch.setattr(mixing, "LISTED", 16)
    texts = [(f"s{k}", 20 + 37 * k) for k in range(6)] + [("t", 900), ("u", 1000), ("v", 20000), ("w", 30000)]
    rows = [(i, name, "w " * (n // 4 + 1)) for name, n in texts for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.targets(mixing.sized(frame))
    b, n = mixing.block_words(plan)
    assert b > 20 and mixing.seats(plan, b, n).count() == n
    out = mixing.mix_plan(mixing.sized(frame)).toPandas()
    assert list(out.columns) == ["row", "doc_id", "source", "size", "source_size", "target", "taken", "spans"]
    for source, mine in out.groupby("source"):
        target = mine.target.iloc[0]
        assert abs(mine.taken.sum() - target) <= max(3, 0.01 * target), source


def test_mixed_documents(docs):
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    taken = sum(len(r.text.encode().split()) for r in out.collect())
    assert taken == mixing.mix_plan(mixing.sized(docs)).groupBy().sum("taken").first()[0]


def test_quotas_are_whole(docs):
    plan = mixing.targets(mixing.sized(docs))
    b, n = mixing.block_words(plan)
    found = mixing.quotas(mixing.seats(plan, b, n)).toPandas()
    assert found.blocks.sum() == n
    assert (found.groupby("shard").blocks.sum()[:-1] == mixing.SHARD_SEATS).all()


def test_shards_get_their_quotas(docs):
    plan = mixing.targets(mixing.sized(docs))
    b, n = mixing.block_words(plan)
    seats = mixing.seats(plan, b, n)
    quotas = {(r.shard, r.source_no): r.blocks for r in mixing.quotas(seats).collect()}
    given, times = Counter(), Counter()
    for r in mixing.chosen_blocks(plan, seats, b, 42).collect():
        given.update((shard, r.source_no) for shard in r.shards)
        times[r.source_no, r.block] = r.times
        assert r.times == len(r.shards)
    assert given == quotas and len({s for s, _ in quotas}) > 1
    for source in {s for s, _ in times}:  # no block is taken again before all others are
        own = [t for (s, _), t in times.items() if s == source]
        assert max(own) - min(own) <= 1 or min(own) == 0


def test_rows_of_very_many_partitions():
    at = np.arange(3)
    found = [rounds.row_numbers((part << 32) + number, at) for part in (0, 1, 2_100, 4_000_000) for number in (0, 1, 900_000)]
    numbers = np.concatenate(found)
    assert len(set(numbers.tolist())) == len(numbers) and numbers.min() >= 0 and (np.diff(numbers) > 0).all()


def test_fit_of_a_hot_id_takes_one_row(spark, monkeypatch):
    rows = [(1, f"word {k}", "en", "s") for k in range(300)] + [(k, "good text here", "en", "t") for k in range(2, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 11)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(cotraining, "co_train", lambda text, page, y, pool: seen.append((len(y), len(pool[0]))))
    cotraining.fit(frame, labels, labelled=4, pool=6)
    assert seen == [(4, 6)]


def test_good_documents_keep_their_own_columns(spark, docs):
    labels = spark.createDataFrame([(3 * i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = cotraining.good_documents(docs, labels)
    assert out.schema == docs.schema and 0 < out.count() < docs.count()
    assert out.filter("keep = 2").count() == out.count()
    assert cotraining.good_documents(docs, labels.limit(0)).count() == docs.count()


def test_null_ids(spark):
    text = "some words that come again and again and again in a text of words " * 4
    rows = [(None, text, "en", "a"), (None, text, "en", None), (None, None, None, "a"), (5, text, "de", "a"), (5, "", "en", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(5, 1), (None, 0)], "doc_id long, quality int")
    for out in (
        mixing.mix_plan(mixing.sized(frame)), winnowing.report(frame), superkmer.without_repeats(frame),
        suffixes.without_repeats(frame), simhash.near_duplicates(frame), linededup.line_dedup(frame),
        cotraining.quality_scores(frame, labels), token_files.token_table(frame, vocabulary("word_bpe_49k.json")),
    ):
        found = [r.doc_id for r in out.collect()]
        assert sorted(map(str, found)) == sorted(str(r[0]) for r in rows)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    fit, judge = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    out = cotraining.quality_scores(documents, fit).join(judge, "doc_id").toPandas()
    assert ((out.p_quality >= 0.5) == (out.quality == 1)).mean() > 0.97
    assert out[out.quality == 1].keep.mean() > 0.98


def test_a_view_holds_few_rows_at_once():
    rng = np.random.default_rng(3)
    y = np.arange(20_000) % 2
    x = (rng.standard_normal((len(y), 64)) + y[:, None] * 0.2).astype(np.float32)
    tracemalloc.start()
    view = cotraining.View.fit([x[:7000], x[7000:]], y)
    said = view.logits(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes, "a copy in double precision takes twice as much"
    # at the optimum the slope of the penalised loss is zero
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0, dtype=float)) / x.std(0, dtype=float)])
    assert np.allclose(z @ view.weights, said)
    slope = z.T @ (1 / (1 + np.exp(-said)) - y) + np.r_[1e-6, np.ones(64)] * view.weights
    assert np.abs(slope).max() < 1e-3


def test_classifier_without_two_classes(spark, docs):
    labels = spark.createDataFrame([(3, 1), (6, 1), (9, None)], "doc_id long, quality int")
    out = cotraining.quality_scores(docs, labels)
    assert out.filter("keep").count() == docs.count() and out.filter("p_quality is null").count() == docs.count()


def test_classifier_scores_every_row(spark, docs):
    labels = spark.createDataFrame([(3 * i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = cotraining.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.filter("p_quality between 0 and 1").count() == docs.count()


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert winnowing.report(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert seg.segmentations(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert token_files.token_table(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert cotraining.quality_scores(none, labels).count() == 0
