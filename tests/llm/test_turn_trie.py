"""The trie against a plain dictionary of prefixes; runs and merges against sorted lists."""

import hashlib
import random
import re
import zlib

import pytest

from quarryline.llm import turn_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}\n{role or ''}\n{text or ''}".encode()).hexdigest()[:32], text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(source, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p] + [x for c in children.get(p, []) for x in below(c)]

    for p, m in members.items():
        sub = below(p)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in sub if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), sum(x not in children for x in sub), saved, sha))
    return sorted(map(str, out))


def chats(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = rng.random() < 0.4  # one first turn that many share
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            text = "the same greeting" if hot and t == 0 else f"{rng.choice('abcd')} {rng.choice(['', 'x y', ' z' * 3])}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", text))
    rows += [(500, None, "user", "null turn first"), (500, 1, None, None), (500, 1, None, None), (None, 0, "user", "no id"), (501, 0, "a", "bc"), (502, 0, "ab", "c")]
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(60) for t in range(6)]  # copies
    rows += [(2000, t, "user", f"turn {t}") for t in range(90)] + [(2001, t, "user", f"turn {t}") for t in range(70)]
    rows += [(-5, 0, "user", "negative"), (-5, 1, "user", "b"), (3000, 0, "user", "word " * 50_000)]
    return rows


@pytest.mark.parametrize(("range_rows", "run_rows"), [(5_000, 5_000), (3, 4), (12, 1)])
def test_nodes_against_a_dictionary(spark, monkeypatch, range_rows, run_rows):
    monkeypatch.setattr(turn_trie, "RUN_ROWS", run_rows)
    rows = chats(150, 3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in turn_trie.trie(df, range_rows).collect()]
    assert sorted(map(str, got)) == plain(rows)


def test_turnless_and_empty(spark):
    assert turn_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    # conversation 1 keeps none of its own turns: its group's first one is absent
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    got = [tuple(r[x] for x in COLUMNS) for r in turn_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] and sorted(map(str, got)) == plain(rows)


def as_run(paths):
    out, before = [], ()
    for p in sorted(paths):
        n = turn_trie.lcp(before, p)
        out.append({"lcp": n, "behind": p[n:]})
        before = p
    return out


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_and_shares(seed):
    rng = random.Random(seed)
    paths = list({tuple(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(200)})
    runs = [[] for _ in range(rng.randrange(1, 9))]
    for p in paths:
        rng.choice(runs).append(p)
    got = list(turn_trie.merged([iter(as_run(r)) for r in runs]))
    want = sorted(paths)
    assert [p for _, p, _ in got] == want
    assert [n for n, _, _ in got] == [turn_trie.lcp(a, b) for a, b in zip([(), *want], want, strict=False)]


class Turn(str):
    compared = 0

    def __eq__(self, other):
        Turn.compared += 1
        return str.__eq__(self, other)

    __hash__ = str.__hash__


def test_shared_turns_are_compared_once():
    """200 sequences that share 50 turns, in 8 runs: a merge that compared from the start would look at 50 turns each time."""
    paths = [(*(Turn("s") for _ in range(50)), Turn(f"{i:03}")) for i in range(200)]
    runs = [as_run(paths[i::8]) for i in range(8)]
    Turn.compared = 0
    assert len(list(turn_trie.merged([iter(r) for r in runs]))) == 200
    assert Turn.compared < 8 * 51 + 200 * 3 * 3
