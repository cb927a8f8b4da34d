"""Components of links against a plain search."""

import random

import pytest

from labelweave.llm import components as module
from labelweave.llm.components import components


def plain_components(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [] if start in found else [start]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo.extend(near[node])
    return found


def check(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    assert got == plain_components(links)


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_hubs_and_rare_nodes(spark, few, monkeypatch):
    """A hub of a third of the links, among a path and pairs, with neither the smallest nor the largest id."""
    monkeypatch.setattr(module, "FEW", few)
    links = [(5000, i) for i in range(4000, 7000) if i != 5000]
    links += [(i, i + 1) for i in range(100, 160)] + [(160, 6999)]
    links += [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(3000)]
    random.Random(3).shuffle(links)
    check(spark, [(b, a) if a % 3 else (a, b) for a, b in links])


def test_random_links(spark, monkeypatch):
    monkeypatch.setattr(module, "FEW", 0)
    draw = random.Random(5)
    check(spark, [(draw.randrange(1500), int(draw.paretovariate(0.5)) % 1500) for _ in range(1400)])


def test_repeats_loops_and_none(spark):
    check(spark, [(1, 1), (2, 3), (3, 2), (2, 3), (4, 3)])
    check(spark, [])
