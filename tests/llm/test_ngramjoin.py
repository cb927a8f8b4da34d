"""Groups of similar n-gram sets against all pairs."""

import random

import numpy as np
import pytest

from labelweave.llm import ngramjoin, rounds

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_groups(rows, size, least):
    sets = []
    for _, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0:
                label[root(a)] = root(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(k)] = min(i, lowest.get(root(k), i))
    return [(i, len(s), lowest.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def ordered(rows):
    return sorted(rows, key=str)


def copies():
    """Groups around a text whose copies differ in a few words, a passage that many share."""
    rng = random.Random(11)
    rows = []
    for group, size in enumerate((70, 30, 8, 2)):
        base = [f"w{rng.randrange(900)}" for _ in range(90)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 9])):
                text[rng.randrange(len(text))] = rng.choice([f"x{rng.randrange(9999)}", "same", "word"])
            rows.append((10 * len(rows) + group, " ".join(text)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(5000 + k, f"{passage} a{k} b{k}") for k in range(25)]
    rows += [(6000 + k, f"a{k} {passage} b{k} c{k} d{k} e{k}") for k in range(25)]
    rows += [(None, rows[0][1]), (None, None), (None, "alone here"), (7000, ""), (7001, "One"), (7002, "one"), (7003, "one one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "many"), [(90, 128), (90, 2), (80, 8)])
def test_groups(spark, least, many, monkeypatch):
    monkeypatch.setattr(ngramjoin, "MANY", many)
    rows = copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = [tuple(r) for r in ngramjoin.similar_groups(frame, least=least).collect()]
    expected = plain_groups(rows, 3, least)
    assert ordered(found) == ordered(expected)
    assert len({e[2] for e in expected}) < 0.8 * len(rows)


def test_groups_of_the_corpus(docs, rows, none):
    found = [tuple(r) for r in ngramjoin.similar_groups(docs, size=2, least=70).collect()]
    assert ordered(found) == ordered(plain_groups([r[:2] for r in rows], 2, 70))
    assert ngramjoin.similar_groups(none).count() == 0
    assert ngramjoin.similar_groups(docs.filter("text = '' or text is null")).count() == 2


def test_longer_prefixes_ask_for_more_matches(spark):
    """A document whose prefix meets many takes a longer one; one that meets none the shortest."""
    base = [f"w{k}" for k in range(200)]
    frame = spark.createDataFrame([(k, " ".join([*base, f"x{k}"])) for k in range(60)], "doc_id long, text string")
    plan, found = ngramjoin._Plan(60 * 199, 90), {0: set(), 6: set()}
    for row in ngramjoin.set_batches(frame).collect():
        t = rounds.opened(row.payload)
        x = ngramjoin._Classes(t, dict.fromkeys(range(t.num_rows)))
        cuts = plan.cuts(plan.cells(x.keys)[0])
        for code, matches in found.items():  # every shingle is in about 2 ** code sets
            said = {k: rounds.dump(np.packbits([code > 0] * (z - a)), np.full((z - a) * (code > 0), code, np.uint8)) for k, a, z in cuts}
            matches.update(ngramjoin._Prefixes(x, plan, said).matches.tolist())
    assert found[0] == {1} and min(found[6]) > 1
