"""Components of graphs against a union of sets, and the edges that each round still holds."""

import random

import pytest

from gyre.llm import components as module


def union(edges):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(up)}


def shuffled(n):
    names = list(range(-n, n, 2))
    random.Random(n).shuffle(names)
    return names


PATH, TREES = shuffled(90), shuffled(400)
GRAPHS = {
    "path": list(zip(PATH, PATH[1:])),
    "path by order": [(i, i + 1) for i in range(60)],
    "star": [(70, i) for i in range(70)],
    "trees": [(TREES[i], TREES[random.Random(i).randrange(i // 40 * 40, i)]) for i in range(400) if i % 40],
    "sparse": [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(1, 240)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_against_union(spark, name):
    edges = [(a, b) for a, b in GRAPHS[name] if a != b]
    out = module.components(spark.createDataFrame(edges + edges[:5] + [(b, a) for a, b in edges[:5]], "_x long, _y long"))
    assert {r._node: r._comp for r in out.collect()} == union(edges)
    assert out.count() == len({n for e in edges for n in e})


def test_no_edges(spark):
    assert module.components(spark.createDataFrame([(3, 3)], "_x long, _y long")).collect() == []


def test_edges_are_joined_once(spark, monkeypatch):
    """A group of near copies: every node has an edge to most of its leads. Only the first round holds them all."""
    edges = [(lead, node) for node in range(20, 620) for lead in range(20) if (node * 31 + lead) % 3]
    held, written = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: held.append((name, written(df, name))) or held[-1][1])
    out = module.components(spark.createDataFrame(edges, "_x long, _y long")).collect()
    assert {r._comp for r in out} == {0} and len(out) == 620
    rows = [df.count() for name, df in held if name == "components-edges"]
    assert rows[0] == len(edges) and sum(rows[1:]) <= 310
