import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.operators import autoencoder as AE, isolation_forest as IF, models as M
from logtide.operators.scaling import ae_scale, vector_bounds
from logtide.plans.training import detect, retrain, train


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1500)]
    rows += [(i, (rng.normal(size=6) + 12).tolist()) for i in range(1500, 1515)]
    return spark.createDataFrame(rows, "id bigint, features array<double>").cache()


@pytest.fixture(scope="module")
def forest(table):
    return IF.iforest_fit(table, ["id"])


def test_tree_samples_are_exact_and_stable(table):
    for n, size in ((1515, 256), (10 ** 9, 256)):
        got = IF.tree_samples(table, ["id"], 1515, 20, 256, 7)
        assert {r["count"] for r in got.groupBy("tree").count().collect()} == {256}
    again = IF.tree_samples(table.repartition(13), ["id"], 1515, 20, 256, 7)
    assert got.select("tree", "rank", "id").exceptAll(again.select("tree", "rank", "id")).count() == 0


@pytest.mark.parametrize("n", [10_239, 10_240, 60_000])
def test_trees_draw_for_themselves_at_every_size(spark, n):
    got = IF.tree_samples(spark.range(n), ["id"], n, 20, 256, 7).cache()
    assert {r["count"] for r in got.groupBy("tree").count().collect()} == {256}
    expected = n * (1 - (1 - 256 / n) ** 20)
    assert got.select("id").distinct().count() == pytest.approx(expected, rel=0.03)


def test_planted_outliers_rank_first(table, forest):
    scored = IF.iforest_score(table, forest)
    worst = [r.id for r in scored.orderBy("anomaly_score").limit(15).collect()]
    assert sorted(worst) == list(range(1500, 1515))
    share = scored.filter("is_anomaly").count() / 1515
    assert share == pytest.approx(0.1, abs=0.01)
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 <= low < 0 < high <= 1


def test_forest_does_not_depend_on_partitioning(table, forest):
    other = IF.iforest_fit(table.repartition(11), ["id"])
    assert other.nodes.equals(forest.nodes) and other.offset == pytest.approx(forest.offset)


def test_tree_structure(forest):
    nodes = forest.nodes
    assert nodes["tree"].nunique() == 100
    leaves = nodes["feature"] < 0
    assert (leaves.groupby(nodes["tree"]).sum() == (~leaves).groupby(nodes["tree"]).sum() + 1).all()
    assert nodes.loc[leaves, "path_length"].max() <= 8 + float(IF.average_path(256))


def test_average_path():
    assert IF.average_path(1) == 0 and IF.average_path(2) == 1
    assert float(IF.average_path(256)) == pytest.approx(
        2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_few_and_constant_rows(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)],
                                  "id int, features array<double>")
    scored = IF.iforest_score(frame, IF.iforest_fit(frame, ["id"]))
    assert scored.filter("is_anomaly").count() == 0
    with pytest.raises(ValueError):
        IF.iforest_fit(frame.limit(0), ["id"])


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradient(activation):
    rng = np.random.default_rng(0)
    sizes = AE.layer_sizes(4, (5, 3), 2)
    weights = AE.initial_weights(sizes, 1)
    x = rng.random((7, 4))
    _, gradient = AE.loss_and_gradient(weights, sizes, activation, x)
    for i in rng.choice(len(weights), 25, replace=False):
        up, down = weights.copy(), weights.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        numeric = (AE.loss_and_gradient(up, sizes, activation, x)[0]
                   - AE.loss_and_gradient(down, sizes, activation, x)[0]) / 2e-6
        assert gradient[i] == pytest.approx(numeric, abs=1e-6)


def test_one_shard_is_sequential_training(spark):
    rng = np.random.default_rng(2)
    data = rng.random((100, 4))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)],
                                  "id int, features array<double>")
    model = AE.ae_fit(frame, ["id"], hidden=(5,), code=2, epochs=3)
    low, high = data.min(axis=0), data.max(axis=0)
    x = (data - low) / (high - low + 1e-8)
    weights = AE.initial_weights(model.sizes, 42)
    m, v, t = np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(3):
        for i in range(0, 100, 32):
            t += 1
            _, g = AE.loss_and_gradient(weights, model.sizes, "relu", x[i:i + 32])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights - 1e-3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(model.weights, weights)
    errors = np.mean((x - AE.reconstruct(weights, model.sizes, "relu", x)[-1]) ** 2, axis=1)
    assert model.threshold == pytest.approx(np.percentile(errors, 95))


def test_autoencoder_learns_and_flags(table):
    normal = table.filter("id < 1500")
    model = AE.ae_fit(normal, ["id"], epochs=8, shard_rows=400)
    again = AE.ae_fit(normal.repartition(7), ["id"], epochs=8, shard_rows=400)
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold
    assert model.losses[-1] < model.losses[0]
    scored = AE.ae_score(table, model)
    share = scored.filter("id < 1500 and is_anomaly").count() / 1500
    assert share == pytest.approx(0.05, abs=0.01)
    worst = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(15).collect()]
    assert sorted(worst) == list(range(1500, 1515))


def test_scale(spark, table):
    low, high, n = vector_bounds(table, "features")
    assert n == 1515 and len(low) == 6
    scaled = table.select(F.explode(ae_scale(F.col("features"), low, high)).alias("v"))
    assert scaled.filter("v < 0 or v > 1").count() == 0
    assert vector_bounds(table.limit(0), "features") == ([], [], 0)


@pytest.mark.parametrize("kind", ["isolation_forest", "autoencoder"])
def test_save_and_load(spark, table, forest, kind, tmp_path):
    model = forest if kind == "isolation_forest" else AE.ae_fit(table, ["id"], epochs=1)
    M.model_save(spark, model, str(tmp_path / "m"))
    M.model_save(spark, model, str(tmp_path / "m"))
    loaded = M.model_load(spark, str(tmp_path / "m"))
    assert loaded.kind == kind and loaded.params == model.params
    a, b = (M.score_batch(table, x).orderBy("id").select("anomaly_score", "is_anomaly").collect()
            for x in (model, loaded))
    assert a == b
    with pytest.raises(FileNotFoundError):
        M.model_load(spark, str(tmp_path / "none"))


def test_unknown_kind(table):
    with pytest.raises(ValueError):
        M.fit("lstm", table, ["id"])


def test_retrain_and_detect(spark, logs, tmp_path):
    assert not retrain(logs, "2020-01-01 00:00:00", str(tmp_path / "m"))
    assert retrain(logs, "2024-02-01 00:00:00", str(tmp_path / "m"), days_back=31,
                   n_estimators=20)
    model = M.model_load(spark, str(tmp_path / "m"))
    found = detect(logs, model, 60)
    assert found.filter("anomaly_score is null or model_type <> 'isolation_forest'").count() == 0
    few = logs.orderBy("log_id").limit(3)
    assert train(few, "autoencoder") is None


def test_summaries(spark):
    frame = spark.createDataFrame(
        [("a", 1, 0.5, False), ("a", 2, -0.1, True)],
        "source string, timestamp int, anomaly_score double, is_anomaly boolean")
    assert tuple(M.anomaly_summary(frame).first()) == (1, 2, 50.0, True)
    assert tuple(M.anomaly_summary(frame.limit(0)).first()) == (0, 0, 0.0, False)
    assert tuple(M.anomaly_recent(frame).first()) == (-0.1, True, 0.2)
    assert tuple(M.anomaly_recent(frame.limit(0)).first()) == (0.0, False, 0.0)


@pytest.mark.parametrize("kind", ["isolation_forest", "autoencoder"])
def test_vectors_of_another_width_are_refused(table, kind):
    model = M.fit(kind, table, ["id"], **({"epochs": 1} if kind == "autoencoder" else {}))
    short = table.withColumn("features", F.slice("features", 1, 3))
    with pytest.raises(Exception, match="takes vectors of 6"):
        M.score_batch(short, model).collect()


def test_a_broken_save_leaves_no_mixture(spark, forest, tmp_path):
    path = str(tmp_path / "m")
    M.model_save(spark, forest, path)
    # the next save got as far as its parameters
    spark.createDataFrame(forest.nodes.head(1), IF.NODE_SCHEMA).write.parquet(f"{path}/parameters-x")
    assert M.model_load(spark, path).nodes.equals(forest.nodes)


def test_trees_split_their_own_samples(spark, table, forest):
    """Every split and leaf of the trained forest, walked again from the sample of its tree."""
    samples = {}
    for r in IF.tree_samples(table, ["id"], 1515, 100, 256, 42).collect():
        samples.setdefault(r.tree, []).append((r["rank"], r.features))
    for tree, nodes in forest.nodes.groupby("tree"):
        rows = np.array([v for _, v in sorted(samples[tree])])
        held, depth = {0: np.arange(256)}, {0: 0}
        for node in nodes.sort_values("node").itertuples():
            part = rows[held[node.node]]
            spread = part.max(axis=0) > part.min(axis=0)
            if node.feature < 0:
                assert node.size == len(part) and (len(part) <= 1 or depth[node.node] == 8 or not spread.any())
                assert node.path_length == pytest.approx(depth[node.node] + float(IF.average_path(len(part))))
                continue
            values = part[:, node.feature]
            assert values.min() <= node.threshold < values.max() and spread[node.feature]
            for child, goes in ((node.left, values <= node.threshold), (node.right, values > node.threshold)):
                held[child], depth[child] = held[node.node][goes], depth[node.node] + 1


def test_trained_models_score_as_plain_code_does(spark, table, forest):
    network = AE.ae_fit(table, ["id"], epochs=2)
    rows = table.filter("id % 50 = 0 or id > 1500").collect()
    frame = table.filter("id % 50 = 0 or id > 1500")
    by_forest = {r.id: (r.anomaly_score, r.is_anomaly) for r in M.score_batch(frame, forest).collect()}
    by_network = {r.id: (r.anomaly_score, r.is_anomaly) for r in M.score_batch(frame, network).collect()}
    trees = [{n.node: n for n in nodes.itertuples()} for _, nodes in forest.nodes.groupby("tree")]
    for r in rows:
        paths = []
        for nodes in trees:
            node = nodes[0]
            while node.feature >= 0:
                node = nodes[node.left if r.features[node.feature] <= node.threshold else node.right]
            paths.append(node.path_length)
        score = -2 ** (-np.mean(paths) / (2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)) - forest.offset
        assert by_forest[r.id] == (pytest.approx(score), bool(score < 0))
        x = (np.array(r.features) - network.low) / (np.array(network.high) - network.low + 1e-8)
        y, at = x, 0
        for i, (a, b) in enumerate(zip(network.sizes, network.sizes[1:])):
            y = y @ network.weights[at:at + a * b].reshape(a, b) + network.weights[at + a * b:at + a * b + b]
            at += a * b + b
            y = 1 / (1 + np.exp(-y)) if i == len(network.sizes) - 2 else np.maximum(y, 0)
        error = float(np.mean((x - y) ** 2))
        assert by_network[r.id] == (pytest.approx(error), error > network.threshold)


def test_one_row_more_than_a_shard_changes_little(spark, table):
    """At the border between one shard and two, losses and thresholds agree within a tenth."""
    fits = [AE.ae_fit(table.filter(f"id < {n}"), ["id"], epochs=12, shard_rows=600) for n in (600, 601)]
    assert len(fits[0].losses) == len(fits[1].losses) == 12
    assert fits[1].losses[-1] == pytest.approx(fits[0].losses[-1], rel=0.1)
    assert fits[1].threshold == pytest.approx(fits[0].threshold, rel=0.1)


def test_neighbouring_values_are_split():
    """Means of repeated rows differ in their last bit; a threshold drawn between is one of them."""
    rows = np.array([[1.0], [np.nextafter(1.0, 2.0)], [1.0]])
    for seed in range(40):
        nodes = IF.grow_tree(rows, np.random.default_rng(seed), 8)
        assert sorted(n[-1] for n in nodes if n[1] < 0) == [1, 2]
