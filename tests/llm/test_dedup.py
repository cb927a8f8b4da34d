"""Lines, word windows, byte strings and near-duplicates against plain loops."""

import random

import pytest
import xxhash

from labelweave.llm import linededup, simhash, suffixes, superkmer


def by_id(rows):
    return sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: r[0])


def test_word_windows(docs, rows):
    window = 20
    first, split = {}, [(i, t.encode().split()) for i, t in by_id(rows)]
    for i, w in split:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    expected = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        expected.append((i, len(w), sum(gone), kept))
    for many in (1, 512):  # 1: every open window travels on its own
        found = superkmer.without_repeats(docs, window=window, gram=8, many=many)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert sum(e[2] for e in expected) > 200


def test_byte_strings(docs, rows):
    length = 100
    # a repeated row: which of the two is earlier is not told apart by its values
    seen, expected = set(), []
    for i, text in by_id(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    found = [(*r[:4], bytes(r[4])) for r in suffixes.without_repeats(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert sum(e[2] for e in expected) > 1000


def plain_lines(rows):
    seen, wholes, places, left = set(), set(), set(), set()
    out = []
    for i, text in by_id(rows):
        keep, equal, near = [], 0, 0
        for line in text.split("\n"):
            w = tuple(line.encode().split())
            if len(w) < linededup.LEAST_WORDS:
                keep.append(line)
                continue
            if w in seen:
                equal += 1
                continue
            cut = [(w[:k] + w[k + 1 :], k) for k in range(len(w))] if len(w) >= linededup.LEAST_NEAR else []
            if w in left or any(c in places or c[0] in wholes for c in cut):
                near += 1
            else:
                keep.append(line)
            seen.add(w)
            if len(w) >= linededup.LEAST_NEAR - 1:
                wholes.add(w)
            places.update(cut)
            left.update(c[0] for c in cut)
        out.append((i, len(text.split("\n")), equal, near, "\n".join(keep)))
    return out


def test_lines(spark, docs, rows):
    base = "the quick brown fox jumps over a lazy dog today"
    more = [
        (1000, base), (1001, base.replace("quick", "slow")), (1002, base + " again"),
        (1003, base.replace("a lazy ", "")), (1004, "x " + base), (1005, base.replace("fox jumps", "jumps fox")),
    ]
    every = [*((r[0], r[1]) for r in rows[:-1]), *more]
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(4)
    found = linededup.line_report(frame).collect()
    expected = {r[0]: r for r in plain_lines(every)}
    assert len(found) == len(every)
    for r in found:
        want = expected[r.doc_id]
        assert (r.n_lines, r.n_equal, r.n_near) == want[1:4]
        assert (r.kept_text or "") == want[4]
    assert [expected[i][3] for i, _ in more] == [0, 1, 1, 0, 1, 0]


def test_short_lines(spark):
    url, chinese = "https://example.org/a/long/path?id=1", "今天天气很好我们去公园散步吧"
    lines = [
        "Les.", "All rights reserved.", url, chinese, "日", "seven", "one two", "a b c d e f g",
        "Les.", "All  rights reserved. ", url, chinese, "日",
        "All rights reserved!", url[:-1], url + "2", chinese.replace("很", "真"), chinese[:-1],
        "Le.", "sevens", "one  tow", "one two.", "a b c d e f gg", "a b c d e f x g", "", "  ",
    ]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_equal, r.n_near) for r in linededup.line_report(frame).collect()}
    # too short for an edit: "Le.", "sevens"; two edits: "one  tow"
    near = {13, 14, 15, 16, 17, 21, 22, 23}
    assert found == {i: (int(8 <= i < 13), int(i in near)) for i in range(len(lines))}


def test_lines_keep_columns(docs):
    out = linededup.line_dedup(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    row = next(r for r in out.collect() if r.text)
    assert row.n_chars == len(row.text) and row.batch == "b" and row["a.b"] == 3
    assert out.filter("text is null").count() == 1


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x.decode() for x in low.encode().split()]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [2, 4])
def test_simhash_groups(docs, rows, radius):
    fps = [(i, plain_fingerprint(t)) for i, t in by_id(rows)]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    lowest = {}
    for (i, _), x in zip(fps, label):
        lowest[x] = min(i, lowest.get(x, i))
    expected = sorted((i, fp, lowest[x]) for (i, fp), x in zip(fps, label))
    found = simhash.near_duplicates(docs, radius).collect()
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == expected


def test_first_of_groups(docs, rows):
    out = simhash.first_of_groups(docs)
    assert out.schema == docs.schema
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in out.collect()} == groups


def test_odd_radius_is_refused(docs):
    with pytest.raises(ValueError, match="even"):
        simhash.near_duplicates(docs, radius=3)


def test_empty_tables(none):
    assert superkmer.without_repeats(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    assert linededup.line_dedup(none).count() == 0
    assert simhash.first_of_groups(none).count() == 0
