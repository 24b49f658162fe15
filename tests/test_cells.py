"""Search over stored cells: the result of reading all vectors, from fewer cells where vectors have clusters."""

import numpy as np
import pytest

from quarry.operators import cells, retrieval


def frames(spark, seed, clusters):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(20, 8))
    x = at[rng.integers(0, 20, 900)] + (0.05 if clusters else 5) * rng.normal(size=(900, 8))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, x[3].tolist()), (903, (2 * x[3]).tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(0, x[3].tolist()), (1, x[40].tolist()), (2, (-x[3]).tolist()), (4, None)], "query_id long, query_vector array<double>")
    return v, q


@pytest.mark.parametrize("clusters", [True, False])
@pytest.mark.parametrize("k", [5, 1000])
def test_cells(spark, tmp_path, clusters, k):
    v, q = frames(spark, k, clusters)
    index = cells.write_cells(v, f"{tmp_path}/cells", cells=20)
    out, read = cells.cells_topk(index, q, k=k)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieval.dense_topk(v, q, k=k).collect()))
    print(f"clusters {clusters}, k = {k}: {len(read)} of {len(index.cells)} cells read")
    if clusters and k == 5:
        assert len(read) < len(index.cells) / 2
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan


def test_zero_queries_few_vectors_and_none(spark, tmp_path):
    v, q = frames(spark, 1, True)
    zero = spark.createDataFrame([(9, [0.0] * 8)], q.schema)
    for name, rows in (("few", v.where("vec_id in (1, 2, 900)")), ("none", v.limit(0)), ("zeros", v.where("vec_id = 900")), ("all", v)):
        index = cells.write_cells(rows, f"{tmp_path}/{name}", cells=4)
        for asked in (zero, q, q.limit(0)):
            out, _ = cells.cells_topk(index, asked, k=3)
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieval.dense_topk(rows, asked, k=3).collect())), name
