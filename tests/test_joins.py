from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.operators import temporal
from threadloom.operators.grams import contained, similar_tags
from threadloom.operators.intervals import in_intervals


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    needles = [word(rng.randint(1, 6)) for _ in range(120)] + ["", None, "a", "zz", "zzz", "%", "_"]
    strings = [word(rng.randint(0, 12)) for _ in range(200)] + ["", None, "a", "100%_"] + ["abcabc"] * 5
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    s = spark.createDataFrame([(x,) for x in strings], "string string")
    got = [tuple(r) for r in contained(n, s).collect()]
    assert sorted(got) == sorted({(a, b) for a in needles for b in strings if a and b is not None and a in b})
    assert contained(n.limit(0), s).count() == 0 and contained(n, s.limit(0)).count() == 0


def test_similar_tags_equal_all_pairs(spark):
    rng = random.Random(3)
    tags = sorted({rng.choice(["cache", "caches", "cachet", "", "se"]) + "".join(rng.choice("ab-") for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"a", "ab", "segment", "aa-se"})
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = sorted(tuple(r) for r in similar_tags(df, df.withColumnRenamed("tag", "known")).collect())
    alike = lambda t, k: k.startswith(t[:5]) or t.startswith(k[:5]) or t[:6] in k or k[:6] in t
    expected = [(t, k, n + 1) for t in tags if t for n, k in enumerate([k for k in tags if k and k != t and alike(t, k)][:2])]
    assert [r for r in got if r[0]] == sorted(expected)


@pytest.mark.parametrize("hot", [50_000, 7])
def test_interval_join_equals_all_pairs(spark, hot):
    rng = random.Random(4)
    points = [(rng.choice(["a", "a", "a", "b", None]), n, rng.randint(-40, 400)) for n in range(150)] + [("a", 900, None), ("a", 901, 10**15), ("c", 902, 0)]
    spans = []
    for n in range(80):
        low = rng.randint(-60, 380)
        spans.append((rng.choice(["a", "b", None]), n, low, low + rng.choice([-5, 0, 1, 2, 3, 4, 7, 8, 9, 100, 10**6])))
    spans += [("a", 900, None, 5), ("a", 901, 0, None), ("a", 902, -(10**17), 10**17), ("d", 903, 0, 9)]
    p = spark.createDataFrame(points, "key string, p int, at bigint")
    s = spark.createDataFrame(spans, "key string, s int, low bigint, high bigint")
    got = sorted((r.p, r.s) for r in in_intervals(p, s, "key", hot=hot).collect())
    assert got == sorted((b, e) for a, b, at in points for d, e, lo, hi in spans if a is not None and a == d and None not in (at, lo, hi) and lo <= at <= hi)
    assert in_intervals(p, s.limit(0), "key").count() == 0


def test_cooldown_with_a_hot_key(spark):
    """One key holds half the rows; gaps that fit exactly, ties, long pauses; no key in one task."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(3000):
        key = 0 if n % 2 else rng.randint(1, 40)
        rows.append((key, n, start + timedelta(seconds=rng.choice([rng.randint(0, 20_000), 10 * rng.randint(0, 3000), 900_000 + rng.randint(0, 500)]))))
    rows += [(None, 5000, start), (3, 5001, None), (77, 5002, start), (78, 5003, start), (78, 5004, start)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp_ntz")
    expected, last = [], {}
    for key, n, ts in sorted((r for r in rows if None not in r), key=lambda r: (r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() >= 10:
            last[key] = ts
            expected.append(n)
    found = temporal.cooled(df, "user_id", "event_id", 10)
    assert sorted(r.event_id for r in found.collect()) == sorted(expected) and found.columns == ["user_id", "event_id", "ts"]
    assert temporal.cooled(df.limit(0), "user_id", "event_id", 10).count() == 0
    assert temporal.cooled(df.filter(F.col("user_id").isNull()), "user_id", "event_id", 10).count() == 0
