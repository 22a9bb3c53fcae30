from __future__ import annotations

from threadloom.operators import cells
from threadloom.operators.nearby import meaning
from threadloom.sources.checkpoints import settled


def test_what_surrounds_anchors_is_not_broadcast(spark):
    table = lambda rows, schema: settled(spark.createDataFrame(rows, schema))
    vectors = table([(k, f"p{k}", [1.0, k / 10]) for k in range(4)], "vec_id bigint, id string, v array<double>")
    ids = table([(f"p{k}",) for k in range(4)], "id string")
    surfaced = table([("p0", "p1"), ("o7", "p2"), ("o8", "p2")], "anchor string, id string")
    index = cells.indexed(vectors.withColumnRenamed("v", "embedding"), 2)
    found = meaning(ids.filter("id = 'p0'"), ids, vectors, index, surfaced, 5, 0.5)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert [(r.id, r.place) for r in found.orderBy("place").collect()] == [("p2", 1), ("p3", 2)]
