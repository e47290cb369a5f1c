"""Closures against a plain walk: long chains, diamonds, cycles, missing parents; clearances against the walk's maximum."""

import random

import pytest

from quarryline.operators import lineage
from quarryline.operators.search import CLEARANCES

EDGES, ASSETS = "asset_id string, parent_asset_id string", "asset_id string, asset_type string, classification_clearance string"


def walked(edges):
    up = {}
    for a, p in edges:
        if a is not None and p is not None:
            up.setdefault(a, set()).add(p)
    out = {}
    for start in up:
        level, steps, seen = {start}, 0, {}
        while level:
            steps += 1
            level = {p for x in level for p in up.get(x, ())} - seen.keys()
            seen |= dict.fromkeys(level, steps)
        out |= {(start, p): n for p, n in seen.items()}
    return out


def told(ways):
    return {(r["asset_id"], r["ancestor_id"]): r["steps"] for r in ways.collect()}


def tangled(seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)]
    return edges + [("a", "b1"), ("a", "b2"), ("b1", "c"), ("b2", "c"), ("c", "root"), ("x", "y"), ("y", "z"), ("z", "x"), ("under", "x"), ("self", "self"), ("a", "b1"), (None, "c"), ("c", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_diamonds_and_cycles(spark, seed):
    edges = tangled(seed)
    assert told(lineage.closure(spark.createDataFrame(edges, EDGES))) == walked(edges)


def test_a_chain_of_a_thousand(spark):
    edges = [(f"{i}", f"{i + 1}") for i in range(1000)]
    ways = lineage.closure(spark.createDataFrame(edges, EDGES).repartition(4))
    assert ways.count() == 1000 * 1001 // 2
    assert sorted((r["ancestor_id"], r["steps"]) for r in ways.where("asset_id = '990'").collect()) == sorted((str(i), i - 990) for i in range(991, 1001))


def test_no_edges(spark):
    assert lineage.closure(spark.createDataFrame([], EDGES)).count() == 0


def test_findings(spark):
    edges = [("chunk", "md"), ("md", "src"), ("vec", "chunk"), ("far", "vec2"), ("vec2", "gone"), ("x", "y"), ("y", "x"), ("u", "x")]
    assets = [(a, "source" if a == "src" else "derived", "public") for a in ("chunk", "md", "src", "vec", "far", "vec2", "x", "y", "u", "alone")]
    got = {(r["check"], r["subject"], r["severity"]) for r in lineage.findings(spark.createDataFrame(assets, ASSETS), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {
        ("missing_parent", "far", "error"), ("missing_parent", "vec2", "error"), ("cyclic_lineage", "x", "error"), ("cyclic_lineage", "y", "error"), ("below_cycle", "u", "warning"),
        *(("unrooted", x, "error") for x in ("far", "vec2", "x", "y", "u", "alone")),
    }


def test_clearances_of_all_ancestors(spark):
    rng = random.Random(5)
    edges = tangled(3)
    nodes = sorted({x for e in edges for x in e if x} - {"root"})
    levels = {n: rng.choice([*CLEARANCES, None, "odd"]) for n in nodes}
    ways = lineage.closure(spark.createDataFrame(edges, EDGES))
    assets = spark.createDataFrame([(n, "derived", levels[n]) for n in nodes], ASSETS)
    rank = lambda n: CLEARANCES.index(levels[n]) if levels.get(n) in CLEARANCES else 4
    above = walked(edges)
    want = {n: CLEARANCES[max([rank(n)] + [rank(p) for a, p in above if a == n])] for n in nodes}
    assert {r["asset_id"]: r["least_clearance"] for r in lineage.least_clearances(assets, ways).collect()} == want
    assert {r["subject"] for r in lineage.downgrades(assets, ways).collect()} == {n for n in nodes if CLEARANCES.index(want[n]) > rank(n)}


def test_a_round_keeps_only_new_pairs(spark, monkeypatch):
    """Pairs meet others only at their full length, and none is written twice."""
    written = []
    monkeypatch.setattr(lineage, "kept", lambda df, whole=lineage.kept: written.append(out := whole(df)) or out)
    edges = [(str(i), str(i // 2)) for i in range(1, 300)] + [(str(i), str(i // 3)) for i in range(1, 300, 2)]
    ways = lineage.closure(spark.createDataFrame(edges, EDGES))
    assert told(ways) == walked(edges)
    assert sum(w.count() for w in written) == ways.count()
