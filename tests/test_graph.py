"""Reachability by doubled strides against a search by breadth."""

import numpy as np
import pytest

from redraft.operators import graph


def brute(edges, targets):
    out = set()
    for file, target in set(targets):
        after = {}
        for f, c, p in edges:
            if f == file and c != p:
                after.setdefault(c, set()).add(p)
        depth, seen, now = 0, {target}, {target}
        while now:
            depth += 1
            now = {y for x in now for y in after.get(x, ())} - seen
            seen |= now
            out |= {(file, target, n, depth) for n in now}
    return sorted(out)


def frames(spark, edges, targets):
    return spark.createDataFrame(edges, "file string, child string, parent string"), spark.createDataFrame(targets, "file string, target string")


@pytest.mark.parametrize("seed, nodes, degree, growth", [(1, 40, 1.2, 8), (2, 60, 2.0, 8), (3, 25, 6.0, 8), (4, 50, 1.1, 0), (5, 40, 3.0, 1)])
def test_random_graphs(spark, seed, nodes, degree, growth):
    """Cycles, repeated edges, loops, several files and targets; growth 0 never doubles."""
    rng = np.random.default_rng(seed)
    edges = [(f"f{rng.integers(3)}", f"n{rng.integers(nodes)}", f"n{rng.integers(nodes)}") for _ in range(int(3 * nodes * degree))]
    targets = [("f0", "n1"), ("f0", "n2"), ("f0", "n2"), ("f1", "n3"), ("f9", "n1"), ("f2", "unknown")]
    e, t = frames(spark, edges, targets)
    assert sorted(tuple(r) for r in graph.ancestors_of(e, t, growth).collect()) == brute(edges, targets)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    chain = [("f", f"n{i}", f"n{i + 1}") for i in range(2000)] + [("f", "n1999", "n0"), ("f", "n10", "n40")]
    e, t = frames(spark, chain, [("f", "n0")])
    monkeypatch.setattr(graph, "MOST_ROUNDS", 12)
    assert sorted(tuple(r) for r in graph.ancestors_of(e, t).collect()) == brute(chain, [("f", "n0")])


def test_tables_go(spark):
    import os

    e, t = frames(spark, [("f", "a", "b"), ("f", "b", "c")], [("f", "a")])
    assert graph.ancestors_of(e, t).count() == 2
    folder = graph.checkpoint_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("run-")]


def test_a_long_chain_of_many_ways_takes_few_rounds(spark, monkeypatch):
    """Edges ahead give a node many ends of walks in a row; several files, a cycle and two targets of one file."""
    chain = [(f, f"n{i}", f"n{i + 1}") for f in "fg" for i in range(1500)] + [(f, f"n{i}", f"n{i + 4}") for f in "fg" for i in range(0, 1500, 5)] + [("f", "n1500", "n0"), ("h", "a", "b")]
    asked = [("f", "n0"), ("f", "n700"), ("g", "n3"), ("h", "a")]
    e, t = frames(spark, chain, asked)
    monkeypatch.setattr(graph, "MOST_ROUNDS", 35)
    assert sorted(tuple(r) for r in graph.ancestors_of(e, t).collect()) == brute(chain, asked)


def blocks_of(monkeypatch, least, most, entries):
    for name, value in {"BLOCKS_FROM": 1, "LEAST_BLOCK": least, "MOST_BLOCK": most, "MOST_ENTRIES": entries}.items():
        monkeypatch.setattr(graph, name, value, raising=False)


def test_a_long_row_of_dense_parts_takes_few_rounds(spark, monkeypatch):
    """Every node has too many edges to leave the graph; parts of two files, dead ends, and a target within."""
    rng = np.random.default_rng(7)
    edges = []
    for f, parts in ("f", 40), ("g", 25):
        for k in range(parts):
            for i in range(12):
                edges += [(f, f"p{12 * k + i}", f"s{k}-{j}") for j in rng.choice(12, 6, replace=False)]
                edges += [(f, f"s{k}-{j}", f"p{12 * k + i}") for j in rng.choice(12, 6, replace=False)]
            edges += [(f, f"s{k}-{j}", f"p{12 * k + 12}") for j in rng.choice(12, 2, replace=False)] + [(f, f"s{k}-0", f"end{k}-{j}") for j in range(20)]
    asked = [("f", "p0"), ("g", "p0"), ("g", "p100")]
    blocks_of(monkeypatch, 80, 400, 8)
    monkeypatch.setattr(graph, "MOST_ROUNDS", 20)
    e, t = frames(spark, edges, asked)
    want = brute(edges, asked)
    assert max(r[3] for r in want) > 60
    assert sorted(tuple(r) for r in graph.ancestors_of(e, t).collect()) == want


@pytest.mark.parametrize("seed, nodes, degree, least, most, entries", [(1, 60, 3.0, 4, 60, 3), (2, 90, 1.5, 2, 20, 64)])
def test_random_graphs_in_blocks(spark, monkeypatch, seed, nodes, degree, least, most, entries):
    """Any cut into blocks gives the same depths, also where edges have lengths."""
    rng = np.random.default_rng(seed)
    edges = [(f"f{rng.integers(2)}", f"n{rng.integers(nodes)}", f"n{rng.integers(nodes)}") for _ in range(int(2 * nodes * degree))] + [("f0", f"n{i}", f"m{i}") for i in range(9)]
    targets = [("f0", "n1"), ("f0", "n2"), ("f1", "n3"), ("f9", "n1"), ("f1", "unknown")]
    blocks_of(monkeypatch, least, most, entries)
    monkeypatch.setattr(graph, "NEAR_ROUNDS", 1)
    e, t = frames(spark, edges, targets)
    assert sorted(tuple(r) for r in graph.ancestors_of(e, t).collect()) == brute(edges, targets)
