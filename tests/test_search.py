from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.catalog import queries
from threadloom.operators import cells
from threadloom.operators.search import comparable, semantic_search

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def some_vectors(n=300, dims=6):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, dims))
    rows = [(k, [float(x) for x in centres[k % 9] * 3 + rng.normal(size=dims)], k % 3) for k in range(n)]
    return [*rows, (900, rows[0][1], 0), (901, None, 0), (902, [0.0] * dims, 0), (903, [1.0], 0), (904, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (905, rows[0][1], None)]


def brute(rows, least, group):
    good = [r for r in rows if r[1] and len(r[1]) == 6 and None not in r[1] and any(r[1])]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    return {(q[0], r[0]): c for q in good if q[0] % 50 == 0 for r in good if (not group or (q[2] is not None and q[2] == r[2])) and (c := cos(q[1], r[1])) >= least}


@pytest.mark.parametrize("group", [None, "label"])
def test_cells_find_what_all_pairs_find(spark, monkeypatch, group):
    monkeypatch.setattr(cells, "BLOCK", 20)
    rows = some_vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.filter("vec_id % 50 = 0")
    index = cells.indexed(df, 8, group=group)
    for least in (0.9, 0.5, -1.0):
        got = {(r.query_id, r.id): r.similarity for r in cells.within(index, queries, least, group=group).collect()}
        expected = brute(rows, least, group)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    for limit, least in ((5, -1.0), (3, 0.97), (200, 0.2)):
        got = {}
        for r in cells.nearest(index, queries, limit, least, group=group).orderBy("place").collect():
            got.setdefault(r.query_id, []).append(r.id)
        expected = {}
        for (q, i), c in sorted(brute(rows, least, group).items(), key=lambda x: (x[0][0], -round(x[1], 9), x[0][1])):
            expected.setdefault(q, []).append(i)
        assert got == {q: v[:limit] for q, v in expected.items()}
    assert cells.looked_at(index, queries, 0.95, group=group) < 0.7 * cells.looked_at(index, queries, -1.0, group=group) and cells.looked_at(index, queries, -1.0, group=group) == 1.0


def test_cells_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cells.within(cells.indexed(df, 4), df, 0.5).count() == 0 and cells.nearest(cells.indexed(df, 4), df, 3).count() == 0


def test_semantic_search_takes_odd_vectors(spark):
    rows = some_vectors(60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.id) for r in semantic_search(df, df.filter(F.col("vec_id") % 50 == 0), floor=0.5).filter("query_id <> 903 and id <> 903").collect()}
    assert got == {k for k, c in brute(rows, 0.5, None).items()}


def test_pairs_carry_columns_and_floors_of_their_own(spark):
    df = spark.createDataFrame(some_vectors(60), SCHEMA)
    queries = df.filter(F.col("vec_id") % 50 == 0)
    own = df.withColumn("least", F.when(F.col("label") == 0, 0.8).otherwise(-2.0))
    got = {(r.query_id, r.id): r.label for r in semantic_search(own, queries, floor="least", carried=("label",)).collect()}
    every = {(r.query_id, r.id): r.similarity for r in semantic_search(df, queries, floor=-2.0).collect()}
    label = {r.vec_id: r.label for r in df.collect()}
    assert got == {k: label[k[1]] for k, c in every.items() if c > (0.8 if label[k[1]] == 0 else -2.0)}
    assert {r.vec_id for r in comparable(df, queries).collect()} == {k[1] for k in every}


def test_closest_takes_the_smallest_id_of_what_rounds_alike(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = [(k + 300 * n, [float(x) for x in np.array(v) * (1 + n / 7) + 1e-8 * rng.normal(size=6)] if k < 300 and v else v, label) for k, v, label in some_vectors(300) if k < 300 for n in range(5)]
    rows += [(2000, None, 0), (2050, [0.0] * 6, 0), (2100, rows[0][1], None), (2150, [1.0] * 6, 7), (2200, [0.6] * 6, 8), (2201, [-0.7] * 6, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {}
    for (q, r), c in brute(rows, -2.0, "label").items():
        if q != r:
            pairs.setdefault(q, []).append((c, r))
    expected = {q: min((-round(c, 6), r) for c, r in found)[1] for q, found in pairs.items()}
    raw = {q: max((c, -r) for c, r in found) for q, found in pairs.items()}
    got = {r.query_id: r for r in cells.closest(cells.indexed(df, 8, group="label"), df.filter("vec_id % 50 = 0"), 6, group="label").collect()}
    assert {q: r.id for q, r in got.items()} == expected and all(abs(got[q].similarity - c) < 1e-9 for q, (c, _) in raw.items())
    assert 2200 in got and 2150 not in got and any(-raw[q][1] != r for q, r in expected.items())
    assert cells.closest(cells.indexed(df.limit(0), 4), df.limit(0), 6).count() == 0


def test_duplicate_alerts_round_before_they_choose(spark, tmp_path):
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(0, [1.0, 0.0], 1), (7, at(0.8799998), 1), (9, at(0.8800002), 1), (50, [1.0, 0.0], 2), (53, at(0.5), 2), (51, at(0.5000001), 2), (52, at(0.5000002), 2), (100, [1.0, 0.0], 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries()["d16_duplicate_alerts"](spark, str(tmp_path)).collect())
    assert got == [(0, 7, "strong"), (50, 51, "none")]


def test_cosines_of_all_pairs_are_not_shuffled(spark, tmp_path):
    rows = [r for r in some_vectors(120) if r[0] not in (901, 902, 903, 904)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries()["c03_cosine"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    pairs = next(n for n, line in enumerate(plan) if "MapInArrow" in line)
    assert not any("Exchange" in line or "Join" in line for line in plan[:pairs])
    label = {r[0]: r[2] for r in rows}
    got = {(r.query_id, r.vec_id): (r.label, r.similarity) for r in found.collect()}
    expected = brute(rows, -2.0, None)
    assert got.keys() == expected.keys() and all(got[k] == (label[k[1]], round(c, 5)) for k, c in expected.items())
    assert found.dtypes == [("query_id", "bigint"), ("vec_id", "bigint"), ("label", "int"), ("similarity", "double")]
