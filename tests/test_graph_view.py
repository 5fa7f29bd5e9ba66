"""Neighbourhoods as pictures, against plain Python."""

import random

import numpy as np
import pytest

from notelake.operators import graph, vector

LINK = "source_path string, target_path string, link_type string, link_ordinal int"


def plain_view(links, live, start, depth, most):
    both = {(s, t) for s, t, _, _ in links if s in live and t in live and s != t}
    level, seen = {start}, {start: 0}
    for step in range(1, depth + 1):
        level = {t for s, t in both | {(t, s) for s, t in both} if s in level} - set(seen)
        seen |= dict.fromkeys(level, step)
    kept = sorted(seen.items(), key=lambda x: (x[1], x[0]))
    cut, kept = len(kept) > most, kept[:most]
    inner = {p for p, d in kept if d < depth}
    count = {p: sum(s in live for s, t, _, _ in links if t == p) for p in inner}
    names = {p for p, _ in kept}
    edges = {}
    for s, t, kind, k in sorted(links, key=lambda x: x[3]):
        if {s, t} <= names and {s, t} & inner:
            edges.setdefault((s, t), kind)
    nodes = {p: (d, "orphan" if p in inner and not count[p] and not any(s == p for s, *_ in links) else "note", count.get(p, 0)) for p, d in kept}
    return nodes, edges, cut


@pytest.mark.parametrize(("depth", "most"), [(0, 10), (1, 200), (2, 200), (2, 6), (3, 9)])
def test_views_equal_plain_python(spark, depth, most):
    rng = random.Random(depth * 10 + most)
    live = {f"{'ab'[k % 2]}/n{k}.md" for k in range(14)}
    every = sorted(live) + ["a/gone.md"]
    links = [(s, rng.choice(every), rng.choice(["markdown", "wikilink"]), k) for s in every[:10] for k in range(rng.randint(0, 3))]
    documents = spark.createDataFrame([(p, p.rpartition("/")[0]) for p in live], "path string, folder string")
    for start in every[:3] + every[-3:-1]:
        nodes, edges, cut = graph.graph_view(spark.createDataFrame(links, LINK), documents, start, depth, most)
        expected = plain_view(links, live, start, depth, most)
        assert {r.path: (r.distance, r.group, r.n_backlinks) for r in nodes.collect()} == expected[0]
        assert {(r.source_path, r.target_path): r.link_type for r in edges.collect()} == expected[1] and cut == expected[2]


def test_semantic_edges(spark):
    documents = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    links = spark.createDataFrame([("a", "b", "markdown", 0)], LINK)
    near = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "d", 2), ("b", "gone", 3), ("e", "a", 1)], "path string, other string, rank int")
    nodes, edges, cut = graph.graph_view(links, documents, "a", 1, 200, near)
    assert {r.path: r.distance for r in nodes.collect()} == {"a": 0, "b": 1, "c": None, "d": None} and not cut
    assert sorted((r.source_path, r.target_path, r.link_type) for r in edges.collect()) == [("a", "b", "markdown"), ("a", "b", "semantic"), ("a", "c", "semantic"), ("b", "d", "semantic")]
    nodes, edges, cut = graph.graph_view(links, documents, "a", 1, 3, near)
    assert {r.path for r in nodes.collect()} == {"a", "b", "c"} and cut


def test_near_notes_by_plain_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{k // 3}", k % 3, "", v.tolist()) for k, v in enumerate(rng.normal(size=(60, 4)))]
    units = {(p, o): np.array(v) / np.linalg.norm(v) for p, o, _, v in rows}
    vectors = spark.createDataFrame([(p, o, f, units[p, o].tolist()) for p, o, f, _ in rows], "path string, ordinal int, folder string, embedding array<double>")
    found = vector.near_notes(vectors, spark.createDataFrame([("n1",), ("n7",), ("none",)], "path string"), 4, 1000).collect()
    for name in ("n1", "n7"):
        mean = np.mean([v for (p, _), v in units.items() if p == name], axis=0)
        best = {q: max(float(v @ mean) for (p, _), v in units.items() if p == q) for q in {p for p, _ in units} - {name}}
        assert [r.other for r in sorted(found, key=lambda r: r["rank"]) if r.path == name] == sorted(best, key=lambda q: -best[q])[:4]
    assert {r.path for r in found} == {"n1", "n7"}
