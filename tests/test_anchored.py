"""Anchored timers against a plain loop over each key's events in order."""

import random
from collections import Counter

import pytest

from veilspark.functions.holdback import Cooldown
from veilspark.operators import anchored


def events(rng):
    rows = []
    for key in ("a", "b", None, "dense", "single"):
        at, n = rng.randrange(5000), {"dense": 900, "single": 1}.get(key, 150)
        for _ in range(n):
            rows.append((key, at, rng.choice([1, 1, 1, 4])))
            at += rng.choice([0, 1, 7, 40]) if key == "dense" else rng.choice([0, 1, 5, 60, 99, 100, 101, 350, 2000])
    return rows


@pytest.mark.parametrize("period", [100, 64, 1])
def test_notices(spark, period):
    rows = events(random.Random(period))
    want = []
    for key in {r[0] for r in rows}:
        timer, per = Cooldown(period), Counter()
        for k, at, n in rows:
            if k == key:
                per[at] += n
        for at in sorted(per):
            want += [(str(key), c, int(f), int(t)) for c, f, t in timer.use(at, per[at])]
    got = anchored.notices(spark.createDataFrame(rows, "key string, us bigint, n bigint").repartition(5), ["key"], period).collect()
    assert sorted((str(r.key), r["count"], r.first_us, r.notice_us) for r in got) == sorted(want)


def test_counted_without_a_key(spark):
    times = sorted({random.Random(2).randrange(20_000) for _ in range(1500)})
    want, last = [], None
    for t in times:
        if last is None or t - last >= 130:
            want.append(t)
            last = t
    got = anchored.counted(spark.createDataFrame([(t,) for t in times], "us bigint"), [], 130)
    assert sorted(r.us for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert anchored.counted(spark.createDataFrame([], "us bigint"), [], 130).count() == 0
