"""The mirror's stream against the batch difference, in any order, over restarts, and as a watch without listings."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from quarryline.operators import changes
from quarryline.streaming import mirror

START = datetime(2024, 5, 1)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, folder, rows, files=1):
    df = spark.createDataFrame(rows, mirror.OBSERVATION)
    df.repartition(files).write.mode("append").parquet(f"{folder}/observations")


def at(seconds):
    return START + timedelta(seconds=seconds)


def ms(when):
    return int(when.replace(tzinfo=UTC).timestamp() * 1000)


def told(df):
    return sorted(tuple(str(x) for x in r) for r in df.select("change_type", "source_path", "content_hash", "document_id", "previous_path").collect())


def snapshots(seed):
    """Few contents for many files, so that most are shared by several that vanish and several that appear."""
    rng = random.Random(seed)
    paths = [f"{rng.choice('abc')}/{i}.md" for i in range(60)]
    known = [(p, f"d{i}", rng.choice([f"h{rng.randrange(12)}", f"u{i}", None]), i) for i, p in enumerate(paths[:40])]
    old = {k[0]: k[2] for k in known}
    listing = [(p, old[p] if p in old and rng.random() < 0.5 else f"h{rng.randrange(12)}", 7, False, i, at(rng.randrange(50))) for i, p in enumerate(rng.sample(paths[15:], 40))]
    return known, listing


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_a_restart_give_the_batch_difference(spark, tmp_path, seed):
    known, listing = snapshots(seed)
    twins = spark.createDataFrame(known, mirror.KNOWN)
    inventory = spark.createDataFrame(listing, mirror.OBSERVATION)
    want = told(changes.snapshot_diff(inventory, twins))
    random.Random(seed).shuffle(listing)
    folder, ended = str(tmp_path), ms(at(60))
    options = {"complete_ms": ended, "files_per_batch": 2}
    put(spark, folder, listing[:25] + listing[:5], 3)  # some twice
    assert mirror.replay(twins, folder, **options).count() == 0
    put(spark, folder, listing[25:], 2)
    mirror.tick(spark, at(86_400)).coalesce(1).write.mode("append").parquet(f"{folder}/observations")
    assert told(mirror.replay(twins, folder, **options)) == want  # a new query over the first one's checkpoint


def test_watch_without_listings(spark, tmp_path):
    known = [("a/kept", "d1", "k", 1), ("a/edited", "d2", "e0", 2), ("a/moved", "d3", "m", 3), ("a/late", "d4", "l", 4), ("a/replaced", "d5", "r", 5), ("a/renamed", "d6", "n", 6)]
    seen = [
        ("a/edited", "e3", 1, False, 0, at(9)), ("a/edited", "e1", 1, False, 0, at(3)), ("a/edited", "e2", 1, False, 0, at(6)),
        ("b/moved", "m", 1, False, 0, at(30)), ("a/moved", None, None, True, 0, at(20)),
        ("a/renamed", None, None, True, 0, at(21)), ("a/new-name", "n", 1, False, 0, at(22)),
        ("a/late", None, None, True, 0, at(10)), ("b/late", "l", 1, False, 0, at(5_000)),
        ("a/replaced", None, None, True, 0, at(40)), ("a/replaced", "r2", 1, False, 0, at(42)),
        ("a/never-known", None, None, True, 0, at(50)), ("a/brief", "x", 1, False, 0, at(60)), ("a/brief", None, None, True, 0, at(61)),
    ]
    folder = str(tmp_path)
    put(spark, folder, seen, 4)
    mirror.tick(spark, at(86_400)).coalesce(1).write.mode("append").parquet(f"{folder}/observations")
    got = told(mirror.replay(spark.createDataFrame(known, mirror.KNOWN), folder, late="2 hours"))
    assert got == sorted([
        ("modified", "a/edited", "e3", "d2", "None"), ("moved", "b/moved", "m", "d3", "a/moved"), ("renamed", "a/new-name", "n", "d6", "a/renamed"),
        ("deleted", "a/late", "None", "d4", "None"), ("created", "b/late", "l", "None", "None"), ("modified", "a/replaced", "r2", "d5", "None"),
    ])


def test_folders_left_empty(spark):
    diff = spark.createDataFrame(
        [("deleted", "a/b/c/x", None), ("moved", "z/y", "a/d/y"), ("renamed", "e/new", "e/old"), ("deleted", "top", None), ("unchanged", "a/kept", None)], "change_type string, source_path string, previous_path string"
    )
    live = spark.createDataFrame([("z/y", "active"), ("e/new", "active"), ("a/kept", "active"), ("a/b/old", "deleted")], "source_path string, status string")
    assert sorted(r[0] for r in mirror.pruned_folders(diff, live).collect()) == ["a/b", "a/b/c", "a/d"]


def test_the_sessions_state_store_is_put_back(spark):
    before = spark.conf.get(mirror.STORE[0], None)
    with mirror.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(mirror.STORE[0])
    assert spark.conf.get(mirror.STORE[0], None) == before
