"""The sweep against a loop over all moments."""

import random
from datetime import datetime, timedelta

import pytest

from quarryline.operators import concurrency

START = datetime(2024, 3, 1)
REQUESTS = "tenant_id string, begun timestamp, ended timestamp"


def plain(rows, limit):
    out = {}
    for tenant in {r[0] for r in rows if r[0] is not None}:
        own = [(b, e) for t, b, e in rows if t == tenant and b is not None and (e is None or e >= b)]
        moments = sorted({x for b, e in own for x in (b, e) if x is not None and b != e})
        active = [(m, sum(b <= m and (e is None or m < e) for b, e in own)) for m in moments]
        steps = [x for i, x in enumerate(active) if i == 0 and x[1] or i and x[1] != active[i - 1][1]]  # moments that change nothing don't count
        if steps:
            peak = max(n for _, n in steps)
            over = sum(int((b[0] - a[0]) / timedelta(microseconds=1)) for a, b in zip(steps, steps[1:], strict=False) if a[1] > limit > 0)
            out[tenant] = (peak, next(m for m, n in steps if n == peak), over, sum(n > limit > 0 for _, n in steps))
    return out


@pytest.mark.parametrize(("limit", "stretch"), [(3, 3600), (2, 7), (0, 100)])
def test_against_a_loop(spark, limit, stretch):
    rng = random.Random(limit)
    at = lambda s: START + timedelta(seconds=s, microseconds=s % 5)
    rows = []
    for _ in range(300):
        b = rng.randrange(900)
        rows.append((rng.choice(["hot", "hot", "b", "c"]), at(b), rng.choice([at(b + rng.randrange(60)), at(b + 5000), None, at(b)])))
    rows += [(None, at(1), at(2)), ("b", None, at(3)), ("c", at(9), at(4)), ("alone", at(7), at(7))]
    df = spark.createDataFrame(rows, REQUESTS).repartition(3)
    got = {r["tenant"]: (r["peak"], START + timedelta(microseconds=r["peak_at"] - int(START.timestamp()) * 1_000_000), r["over_micros"], r["over_spells"]) for r in concurrency.pressure(df, limit, stretch_seconds=stretch).collect()}
    assert got == plain(rows, limit)


def test_no_requests(spark):
    assert concurrency.pressure(spark.createDataFrame([], REQUESTS), 3).count() == 0
