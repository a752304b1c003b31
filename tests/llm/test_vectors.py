import numpy as np
import pytest
from conftest_llm import plain
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup as dedup
from millrace.llm import topk
from millrace.llm.vectors import Forest
from millrace.session import table

SCHEMA = "vec_id long, embedding array<float>, label int, x string, least string, score string"


def brute(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append({"vec_id": i, "n_links": len(links[i]), "component_id": min(seen), "kept": min(seen) == i})
    return sorted(out, key=lambda r: r["vec_id"])


def sample(seed, n=120, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = [(int(i), np.float32(base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3])).tolist()) for i in rng.permutation(n)]
    nan = float("nan")
    odd = [None, [], [0.0] * dim, [None, *[1.0] * (dim - 1)], [nan, *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)], [1.0, 2.0], [2.0, 4.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "c", "c") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rows = sample(seed)
    got = plain(dedup.near_duplicates(frame(spark, rows), block=32, tile=16), "vec_id")
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0])]
    got = dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2] and {r.component_id for r in got if r.vec_id} == {1}
    assert dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_close_pairs_in_dense_and_sparse_tiles():
    rng = np.random.default_rng(3)
    for spread in (0.01, 0.4, 3.0):
        x = rng.normal(size=16) + spread * rng.normal(size=(60, 16))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        rotated = unit @ dedup.principal_axes(unit)
        i, j = dedup.close_pairs(x, x, rotated, rotated, 0.9)
        assert set(zip(i, j)) == set(zip(*np.nonzero(unit @ unit.T >= 0.9)))


def test_vectors_of_extreme_norms(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.1e200]), (3, [1.0, 1.0]), (4, [1e-200, 1e-200]), (5, [1.0, -1.0]), (6, [5e-324, 5e-324])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = plain(dedup.near_duplicates(table), "vec_id")
    assert [(r["n_links"], r["component_id"]) for r in got] == [(4, 1), (4, 1), (4, 1), (4, 1), (0, 5), (4, 1)]


def test_distant_blocks_are_not_dealt(spark):
    """Vectors around two far points: no block of one meets a block of the other, and no link is lost."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal([3, 1, 0, 0], 0.4, (150, 4)), rng.normal([-3, 0, 1, 0], 0.4, (150, 4))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert plain(dedup.near_duplicates(frame(spark, rows), block=30, tile=10), "vec_id") == brute([(i, np.float32(v).tolist()) for i, v in rows])
    compared = []
    original, dedup.close_pairs = dedup.close_pairs, lambda a, b, *more: (compared.append(len(a) * len(b)), original(a, b, *more))[1]
    try:
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        every = np.arange(300)
        dedup.compare_blocks(x, every, every, dedup.principal_axes(unit), np.ones(300, np.int64), 0.9, 30)
    finally:
        dedup.close_pairs = original
    assert sum(compared) < 0.6 * 300 * 330 / 2


def test_top_k_of_large_components(spark):
    def table(v):
        return spark.createDataFrame([(0, [v, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")

    large = float(np.float32(5_000_000.3))
    got = topk.top_k(table(large)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, int(np.floor(256 * large)) * 256 + 256 * 512)]
    with pytest.raises(Exception, match="too large"):
        topk.top_k(table(1e30)).collect()


def test_top_k_of_null_ids(spark):
    rows = [(None, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0])]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()] == [(50, 1, 3, 256 * 512)]


def test_forest():
    f = Forest(8)
    f.link(np.array([5, 2]), np.array([6, 5]))
    f.link(np.array([7, 6]), np.array([1, 7]))
    assert f.label.tolist() == [0, 1, 1, 3, 4, 1, 1, 1]


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed):
    rows = sample(seed) + [(2000 + i, [0.5] * 8) for i in range(12)] + [(2050, [0.0] * 8)]
    got = [tuple(r) for r in topk.top_k(frame(spark, rows), every=10, block=16, queries=4).orderBy("query_id", "rank").collect()]
    good = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q, a in sorted(good.items()):
        if q % 10 == 0:
            scored = sorted((-int(a @ b), i) for i, b in good.items() if i != q and len(a) == len(b))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == want


def test_top_k_of_repeated_ids(spark):
    """A query's own repeated rows take no places of other rows with an equal vector."""
    same, other = [1.0, 0.5], [0.5, 0.25]
    rows = [(50, same)] * 6 + [(i, same) for i in range(51, 61)] + [(100, other)] + [(7, other)] * 9
    got = [tuple(r) for r in topk.top_k(frame(spark, rows)).orderBy("query_id", "rank").collect()]
    score = {(50, r): 256 * 256 + 128 * 128 for r in range(1, 6)} | {(100, r): 256 * 128 + 128 * 64 for r in range(1, 6)}
    want = [(50, r, 50 + r) for r in range(1, 6)] + [(100, r, 50) for r in range(1, 6)]
    assert got == [(q, r, i, score[q, r]) for q, r, i in want]


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(4000, 3)) * 100).astype(np.int64)
    lists = topk.SortedLists(np.arange(4000), x)
    q = np.array([5, 1, 0])
    ids, scores, depth = lists.top(None, q, 5)
    order = np.lexsort((np.arange(4000), -(x @ q)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist() and depth < 4000


def test_tables(spark, sf001):
    vectors = table(spark, sf001, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert plain(dedup.near_duplicates(vectors), "vec_id") == brute(rows)
    assert topk.top_k(vectors.where(F.lit(False))).count() == 0
