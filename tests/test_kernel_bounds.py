"""Bounds of the retrieval kernel: the distance block, and the rows that leave a task."""

import numpy as np

from leadlens.operators import retrieve as R


def test_distance_block_stays_within_cell_budget():
    for nq in [1, 5, 2048, 4096, 40960]:
        rows = R._sub_rows(nq)
        assert 1 <= rows <= R._SUB_ROWS
        assert rows * nq <= max(R._SUB_CELLS, nq)


def test_smallest_keeps_k_per_question_with_ties_to_the_earlier_row():
    d = np.array([[1.0, 0.5], [1.0, 0.5], [0.2, 0.5], [1.0, 0.1]])
    i, j = R._smallest(d, 2)
    assert sorted(i[j == 0].tolist()) == [0, 2] and sorted(i[j == 1].tolist()) == [0, 3]
    assert len(R._smallest(d, 9)[0]) == 8


def test_running_best_over_many_blocks_is_k_per_question():
    rng = np.random.default_rng(1)
    best, all_ = R._Best(3), []
    for block in range(40):
        d = np.round(rng.random((50, 20)), 1)                 # many ties
        i, j = R._smallest(d, 3)
        ids = [f"c{block:02d}_{x:02d}" for x in range(50)]
        best.add(j, d[i, j], [ids[x] for x in i.tolist()])
        all_ += [(q, d[x, q], ids[x]) for x in range(50) for q in range(20)]
        assert len(best.q) <= 60
    got = sorted(zip(best.q.tolist(), best.d.tolist(), best.ids))
    assert got == sorted(t for q in range(20) for t in sorted(x for x in all_ if x[0] == q)[:3])


def test_rows_that_leave_a_task(spark):
    """One task with many item blocks and several question blocks: k rows per question leave it,
    and the number of jobs does not depend on the number of questions."""
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], "vec_id long, embedding array<double>").coalesce(1)
    out = {}
    jobs = spark.sparkContext.statusTracker()
    for n in (10, 90):
        qs = spark.createDataFrame([(j, rng.normal(size=4).tolist()) for j in range(n)], "qid long, qvec array<double>").coalesce(1)
        spark.sparkContext.setJobGroup(f"near-{n}", "near")
        rows = R.nearest_dense(items, qs, ["qid"], k=5, shard_bytes=2000).collect()
        out[n] = len(jobs.getJobIdsForGroup(f"near-{n}"))
        assert len(rows) == 5 * n
    spark.sparkContext.setJobGroup("rest", "rest")
    assert out[90] <= out[10] + 1
