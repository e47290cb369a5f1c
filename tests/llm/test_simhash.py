import random
import re

import numpy as np
import pytest
import xxhash

from quarryline.llm import simhash


def fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 30, 200]))) for _ in range(60)]
    long = " ".join(rng.choices(words, k=3000))
    near = [long, long + " end", "start " + long, long.upper(), long.replace("zeta", "zeta", 1)]
    return base + base[:10] + near + [None, "", " \n\t", "one", "ONE", "a\u00a0b"]


def test_fingerprints_and_components(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()}
    prints = [fingerprint(t) for _, t, _ in rows]
    label = groups(prints)
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in range(len(rows))}


@pytest.mark.parametrize("n", [50, 1500])
def test_links_of_clustered_fingerprints(spark, n):
    """Chains and clusters of one and two bits, dense enough that shards are split again."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64) if n > 100 else rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    nodes = sorted(set((centres[rng.integers(0, len(centres), n)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]).tolist()))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in nodes], "node long")
    member = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(df)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in nodes]
    mine = [member.get(s, s) for s in signed]
    want = groups(nodes)
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(want)) == len(set(mine))


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i % 97}" for i in range(4000))
    rows = [(3, long, "x"), (1, long, "y"), (2, long + " tail", "z"), (4, "something else here", None), (4, "something else here", None), (None, "lonely words are these", "q"), (9, None, None), (8, "", None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 1, 4, 8]


def test_nulls_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(rows).collect()] == [7, 7, 7]


def test_bk_tree_search_is_exact():
    rng = np.random.default_rng(1)
    node = np.unique(rng.integers(0, 1 << 10, 300, dtype=np.uint64))
    forest = simhash.Forest(np.zeros(len(node), np.int64), node)
    found = {(int(a), int(b)) for x, y in forest.search(np.arange(len(node)), 2) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(node)) for j in range(len(node)) if (int(node[i]) ^ int(node[j])).bit_count() <= 2}
    assert found == want
