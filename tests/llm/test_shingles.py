import random
import re

import pytest

from quarryline.llm import shingles, simhash
from tests.llm.test_simhash import fingerprint, groups


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(rows):
    """Least id of every component of similarity 0.8, by brute force."""
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(least.values())


def changed(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    """Texts, near copies of 0.8 to 0.95 and of less, a common passage, short texts and a chain."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=rng.randrange(100, 400))) for _ in range(60)]
    texts += [changed(rng, t, rng.randrange(1, 9)) for t in texts for _ in range(2)]
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randrange(20, 200))) for _ in range(30)]
    texts += ["a b c d e f g h i", "a b c d e f g h i j", "a b c", "A  b c", "a b", "", None, " \n"]
    chain = " ".join(rng.choices(words, k=300))
    for _ in range(6):
        texts.append(chain)
        chain = changed(rng, chain, 5)
    return list(enumerate(texts))


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.keep_one(df).collect())


def test_planted_copies_of_080_to_095_are_joined(spark):
    rng = random.Random(8)
    rows, copies = [], 0
    for i in range(40):
        text = " ".join(rng.choices([f"w{k}" for k in range(5000)], k=300))
        copy = changed(rng, text, 1 + i % 6)
        rows += [(2 * i, text), (2 * i + 1, copy)]
        if 0.8 <= similarity(grams(text), grams(copy)) <= 0.95:
            copies += (fingerprint(text) ^ fingerprint(copy)).bit_count() > 2
    assert copies > 20  # that two bits of the fingerprint don't reach
    assert kept(spark, rows) == kept_ids(rows) == [2 * i for i in range(40)]


@pytest.mark.parametrize("long_posting", [64, 3])
def test_groups_are_those_of_brute_force(spark, monkeypatch, long_posting):
    """With short limits every group goes through leaders and the round across components."""
    monkeypatch.setattr(shingles, "LONG_POSTING", long_posting)
    monkeypatch.setattr(shingles, "LEADERS", 2)
    rows = planted()
    want = kept_ids(rows)
    assert 60 < len(want) < len(rows) - 60
    assert kept(spark, rows) == want


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_repeated_rows_leave_one(spark, monkeypatch, most):
    """With names broadcast, and with texts shuffled to them."""
    monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
    rows = [(1, "a b c")] * 4 + [(None, "a b c")] * 3 + [(2, "d e f")] * 2 + [(3, "g"), (None, "h i")] + [(5, None)] * 2 + [(4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == sorted([(1, "a b c"), (2, "d e f"), (3, "g"), (None, "h i"), (4, "")], key=str)


def test_large_group_of_near_copies(spark):
    """Pairs of one base on both sides of 0.8, more than a posting lists."""
    rng = random.Random(4)
    base = " ".join(rng.choices([f"w{k}" for k in range(3000)], k=150))
    rows = [(i, changed(rng, base, rng.randrange(1, 7))) for i in range(150)]
    want = kept_ids(rows)
    assert 1 < len(want) < 140
    assert kept(spark, rows) == want


def test_sets_are_those_of_the_words(monkeypatch):
    """As many hashes as different shingles, the same for the same words, however a text is cut into segments."""
    rng = random.Random(2)
    words = ["a", "b", "ab", "ba", "été", "A\u00a0b", "x" * 90, "\x00", "\x1f"]
    texts = ["", " \t", "a", " a  b ", "x" * 500] + ["".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for w in rng.choices(words, k=rng.randrange(1, 120))) for _ in range(200)]
    whole = [shingles.shingle_set(t).tolist() for t in texts]
    assert [len(h) for h in whole] == [len(grams(t)) for t in texts]
    named = {}
    for t, h in zip(texts, whole):
        assert named.setdefault(frozenset(grams(t)), h) == h
    assert shingles.shingle_set("A b C d e F").tolist() == shingles.shingle_set("a  b c\nd e f ").tolist()
    monkeypatch.setattr(shingles, "SEGMENT", 40)
    assert [shingles.shingle_set(t).tolist() for t in texts] == whole


def test_first_shingles_of_similar_sets_meet():
    rng = random.Random(6)
    for _ in range(2000):
        n = rng.randrange(1, 120)
        pool = list(range(n))
        one, two = (set(rng.sample(pool, rng.randrange(max(1, n * 4 // 5), n + 1))) for _ in range(2))
        if similarity(one, two) >= 0.8:
            first = [set(sorted(s)[: shingles.firsts_of(len(s))]) for s in (one, two)]
            assert len(first[0] & first[1]) >= shingles.shared(min(len(one), len(two)))


def close_copies():
    """Long texts with copies that end otherwise, of which fingerprints say it, and others that don't resemble them."""
    rng = random.Random(9)
    bases = [" ".join(rng.choices([f"w{k}" for k in range(5000)], k=3000)) for _ in range(6)]
    texts = [f"{base} end{k}" if k else base for base in bases for k in range(4)]
    texts += [" ".join(rng.choices(["a", "b", "c"], k=rng.randrange(1, 9))) for _ in range(30)] + ["", None, bases[0].upper()]
    return list(enumerate(texts))


def pair_prints(texts):
    """SimHashes of the sets, bit by bit."""
    hashes = [shingles.shingle_set(t).tolist() for t in texts]
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in hashes]


def test_fingerprints_and_bk_trees_link_copies_without_the_join(spark, monkeypatch):
    """What the first search of near-dedup links by itself, the join finding nothing."""

    def nothing(long_posting):
        def run(batches):
            for _ in batches:
                pass
            return iter(())

        return run

    monkeypatch.setattr(shingles, "meet", nothing)
    rows = close_copies()
    prints, sets = pair_prints([t for _, t in rows]), [grams(t) for _, t in rows]
    near = {(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert sum(similarity(sets[i], sets[j]) >= 0.8 for i, j in near if sets[i] != sets[j]) >= 12
    found = kept(spark, rows)
    assert found == [min(c) for c in components_of(len(rows), [(i, j) for i, j in near if similarity(sets[i], sets[j]) >= 0.8])]


def components_of(n, links):
    label = list(range(n))
    for i, j in links:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return [[i for i in range(n) if label[i] == x] for x in sorted(set(label))]


def test_the_join_is_offered_no_pair_that_fingerprints_settled(spark, monkeypatch):
    rows, offered = close_copies(), []

    def apart(pairs, links):
        left = original(pairs, links)
        offered.append((links.count(), pairs.count(), left.count()))
        return left

    original = shingles.apart
    monkeypatch.setattr(shingles, "apart", apart)
    assert kept(spark, rows) == kept_ids(rows)
    (links, pairs, left), = offered
    assert links >= 12 and left < pairs


def test_candidates_join_all_texts_within_two_bits(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = [rng.choice(centres) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)] + centres
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, print long")
    links = [tuple(r) for r in simhash.candidates(nodes).collect()]
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links)
    label = groups(prints)
    assert components_of(len(prints), links) == [[i for i in range(len(prints)) if label[i] == x] for x in sorted(set(label))]
