from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.operators import similarity as K

T0 = datetime(2024, 1, 1)


def brute_top_k(queries, patterns, k, skip_same=False):
    out = {}
    for qid, q in queries:
        ranked = []
        for pid, p in patterns:
            if len(p) != len(q) or (skip_same and pid == qid):
                continue
            norm = np.linalg.norm(p) * np.linalg.norm(q)
            sim = float(np.dot(p, q) / norm) if norm else 0.0
            ranked.append((-round(sim, 9) + 0.0, pid))
        out[qid] = [pid for _, pid in sorted(ranked)[:k]]
    return out


def data(n, seed, clusters=5, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    rows = []
    for i in range(n):
        size = width if i % 5 else 3
        if i % 3 == 0:
            vector = centres[0, :size]  # a third of the rows are copies of each other
        elif i % 50 == 1:
            vector = np.zeros(size)
        else:
            vector = centres[i % clusters, :size] + rng.normal(size=size) * 0.3
        rows.append((i, vector.tolist()))
    return rows


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("k", [1, 5])
def test_any_slices_match_brute_force(spark, k, skip):
    queries, patterns = data(150, 1), data(200, 2)
    q = spark.createDataFrame(queries, "query_id bigint, vector array<double>")
    p = spark.createDataFrame(patterns, "pattern_id bigint, pattern array<double>")
    expected = brute_top_k(queries, patterns, k, skip)
    whole = K.knn_topk(q, p, k, exclude_self=skip)
    sliced = K.knn_topk(q, p, k, exclude_self=skip, slice_bytes=5_000)
    for result in (whole, sliced):
        got = {}
        for r in result.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.pattern_id)
        assert got == {q: ids for q, ids in expected.items() if ids}


def test_failure_similarity_paths_agree(spark):
    queries, patterns = data(60, 3), data(80, 4)
    q = spark.createDataFrame(queries + [(999, [1.0])], "query_id bigint, pattern array<double>")
    p = spark.createDataFrame(patterns, "pattern_id bigint, pattern array<double>")
    results = [{r.query_id: (r.pattern_id, round(r.similarity, 9), r.is_risk) for r in
                K.failure_similarity(q, p, slice_bytes=b).collect()}
               for b in (1 << 20, 3_000)]
    assert results[0] == results[1] and len(results[0]) == 61
    assert results[0][999] == (None, 0.0, False)
    empty = K.failure_similarity(q, p.limit(0)).collect()
    assert len(empty) == 61 and not any(r.is_risk or r.similarity for r in empty)


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_repeated_queries_are_each_answered(spark, size):
    q = spark.createDataFrame([(1, [1.0, 0.0])] * 2, "query_id bigint, vector array<double>")
    p = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)],
                              "pattern_id bigint, pattern array<double>")
    got = K.knn_topk(q, p, 2, slice_bytes=size).collect()
    assert sorted((r.pattern_id, r["rank"]) for r in got) == [(0, 1), (0, 1), (1, 2), (1, 2)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, timestamp timestamp, vec array<double>")


def test_historical_patterns(spark):
    rows = [("a", T0 + timedelta(minutes=i), [float(i), 1.0]) for i in range(30)]
    rows += [("b", T0 + timedelta(minutes=i), [float(-i), 1.0]) for i in range(30)]
    failures = spark.createDataFrame(
        [("a", T0 + timedelta(minutes=12, seconds=30)), ("b", T0 + timedelta(minutes=3)),
         ("a", T0), ("c", T0)] + [("b", T0 + timedelta(minutes=3))] * 20, "source string, failure_time timestamp")
    got = {(r.source, r.failure_time): r for r in K.historical_failure_patterns(
        frame(spark, rows), failures, 10, vector_col="vec").collect()}
    assert set(got) == {("a", T0 + timedelta(minutes=12, seconds=30)),
                        ("b", T0 + timedelta(minutes=3))}
    first = got["a", T0 + timedelta(minutes=12, seconds=30)]
    assert first.pattern == [x for i in range(3, 13) for x in (float(i), 1.0)]
    assert first.minutes_before == 10 and first.pattern_id
    assert got["b", T0 + timedelta(minutes=3)].pattern == [0.0, 1.0, -1.0, 1.0, -2.0, 1.0]


def test_rolling_pattern(spark):
    rng = np.random.default_rng(0)
    times = sorted({int(t) for t in rng.integers(0, 60 * 512 * 3, 400)})
    rows = [("a", T0 + timedelta(seconds=t), [float(t)]) for t in times]
    got = {r.timestamp: r for r in K.rolling_pattern(
        frame(spark, rows), 60, vector_col="vec").collect()}
    assert len(got) == len(rows)
    for t in times:
        before = [float(x) for x in times if t - 60 <= x <= t - 1]
        row = got[T0 + timedelta(seconds=t)]
        assert row.pattern == before and row.window_count == len(before)


def test_add_pattern(spark):
    one = spark.createDataFrame([([1.0, 2.0],)], "pattern array<double>")
    table = K.add_failure_pattern(one)
    both = K.add_failure_pattern(one, 5, existing=table)
    assert [r.minutes_before for r in both.orderBy("minutes_before").collect()] == [5, 10]
    assert K.pattern_bytes(both) == 2 * (16 + 64) and K.pattern_bytes(both.limit(0)) == 0


def test_vector_order_is_fixed(spark, features):
    a = K.with_vector(features).select("source", "window_id", "features")
    b = K.with_vector(features.select(*reversed(features.columns))).select(
        "source", "window_id", "features")
    assert a.exceptAll(b).count() == 0
    assert a.filter(F.exists("features", lambda x: x.isNull())).count() == 0


def test_tiles_are_skipped_exactly(spark, monkeypatch):
    """Bundles of directions: most tiles are out of reach, and the answer is that of all pairs."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 6))
    rows = [(i, (middle[i % 12] + 0.02 * rng.normal(size=6)).tolist()) for i in range(600)]
    rows += [(600 + i, [0.0] * 6) for i in range(4)] + [(700, [1.0, 2.0]), (701, [2.0, 1.0]), (702, []), (703, None)]
    p = spark.createDataFrame(rows, "pattern_id bigint, pattern array<double>")
    usable = {i: np.array(v) for i, v in rows if v}
    asked = [(i, v) for i, v in rows if i % 7 == 0 or i >= 600]
    q = spark.createDataFrame(asked, "query_id bigint, vector array<double>")

    def unit(v):
        return v / np.linalg.norm(v) if v.any() else v

    expected = []
    for i, v in asked:
        found = sorted((-round(float(unit(np.array(v)) @ unit(x)), 9) + 0.0, j) for j, x in usable.items()
                       if v and len(x) == len(v) and j != i)[:5]
        expected += [(i, n + 1, j) for n, (_, j) in enumerate(found)]
    for size in (1 << 20, 4_000):
        got = K.knn_topk(q, p, 5, exclude_self=True, slice_bytes=size)
        assert sorted((r.query_id, r["rank"], r.pattern_id) for r in got.collect()) == sorted(expected)
    held = p.filter("size(pattern) > 0")
    clusters = K._clusters(held, 4_000)
    tiles = sum(clusters.parts(*key) for key in clusters.found if key[0] == 6)
    near = q.select(F.col("query_id").alias("_row"), F.lit(None).cast("bigint").alias("_own"),
                    F.col("vector").alias("_vec"), F.lit(0.9).alias("_least")).filter("_row < 600")
    met = K._asked(near, clusters, 1, "bigint", False).count()
    assert tiles >= 10 and met < 0.7 * near.count() * tiles


def test_nothing_is_taken_to_the_driver_whole():
    import inspect
    source = inspect.getsource(K)
    assert source.count("toPandas") == 1 and "limit(most)" in source and "broadcast" not in source.split("_nearest")[1]


def test_copies_sent_do_not_grow_with_the_rows(spark):
    """Blocks and parts go by the cores; only beyond what a task may hold are there more blocks."""
    assert K._grid(12, 100_000, 100_000 * 576, 100_000) == K._grid(12, 1_600_000, 100_000 * 576, 1_600_000)
    blocks, parts = K._grid(12, 10_000_000, 10_000_000 * 576, 10_000_000)
    assert blocks * K._BLOCK_BYTES >= 10_000_000 * 576 and parts == K._grid(12, 100_000, 1, 100_000)[1]


def test_a_task_streams_patterns(spark):
    """A part of several batches, with ids that repeat and are null, in small slices and one."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 400 == 3 else i // 2, rng.normal(size=4).round(1).tolist()) for i in range(25_000)]
    p = spark.createDataFrame(rows, "pattern_id bigint, pattern array<double>").repartition(3).cache()
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 25_000, 500)],
                              "query_id bigint, vector array<double>")
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    expected = []
    for i, v in q.collect():
        sims = np.round(units @ (np.array(v) / np.linalg.norm(v)), 9) + 0.0
        best = sorted((-s, j is not None, j or 0) for (j, _), s in zip(rows, sims) if j is None or j != i)[:4]
        expected += [(i, n + 1, j if named else None, -s) for n, (s, named, j) in enumerate(best)]
    for size in (1 << 26, 20_000):
        got = K.knn_topk(q, p, 4, exclude_self=True, slice_bytes=size).collect()
        got = [(r.query_id, r["rank"], r.pattern_id, round(r.similarity, 9)) for r in got]
        assert [x[:3] for x in sorted(got, key=lambda x: x[:2])] == [x[:3] for x in sorted(expected, key=lambda x: x[:2])]


def test_floats_are_sent_as_floats(spark, monkeypatch):
    """Half the bytes of doubles in tables and shuffles, the same answer; mixed kinds become doubles."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(900)]
    single = spark.createDataFrame(rows, "pattern_id bigint, pattern array<float>").cache()
    double = single.select("pattern_id", F.col("pattern").cast("array<double>").alias("pattern"))
    kinds, sent = [], K._streamed
    monkeypatch.setattr(K, "_streamed", lambda cells, *a: kinds.append(dict(cells.dtypes)["_vec"]) or sent(cells, *a))
    for size in (1 << 26, 5_000):
        found = []
        for q, p in ((single, single), (double, double), (single, double)):
            got = K.knn_topk(q, p, 3, "pattern_id", "pattern", exclude_self=True, slice_bytes=size)
            found.append(sorted(map(tuple, got.collect())))
        assert len(found[0]) == 2_700 and found[0] == found[1] == found[2]
    assert kinds == ["array<float>", "array<double>", "array<double>"] * 2


def test_home_tiles_are_not_shuffled_to_leave_some_out(spark):
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)]
    p = spark.createDataFrame(rows, "pattern_id bigint, pattern array<double>")
    q = p.select(F.col("pattern_id").alias("_row"), F.lit(None).cast("bigint").alias("_own"),
                 F.col("pattern").alias("_vec"))
    clusters = K._clusters(p, 2_000)
    plan = K._bounded(q, K._dealt(p, clusters, "bigint"), clusters, 2, 3, "bigint")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and "strategy=broadcast" in text.split("LeftSemi")[1].splitlines()[0]
