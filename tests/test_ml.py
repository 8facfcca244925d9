import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.ml import metrics
from flowsentry.ml.autoencoder import _forward, _gradients, fit_autoencoder, init_weights
from flowsentry.ml.ensemble import ensemble_vote, ml_to_alert
from flowsentry.ml.isolation_forest import fit_isolation_forest
from flowsentry.ml.random_forest import feature_importance, fit_random_forest, score_random_forest, weighted_rows
from flowsentry.ml.split import stratified_split
from flowsentry.ml.training import Models, evaluate, score_flows, train
from flowsentry.operators import flows as fl, labelled as lb
from flowsentry.plans.ordered import quantiles_of, ranked, value_spans
from flowsentry.plans.storage import materialize
from flowsentry.queries import packets
from flowsentry.sources import labelled as src


@pytest.fixture(scope="module")
def planted(spark):
    """Benign rows near the origin, attacks far out."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        attack = i % 10 == 0
        x = rng.normal(8 if attack else 0, 1, len(dims.FEATURES))
        rows.append((i, int(attack), *[float(v) for v in x]))
    schema = "row_id bigint, binary_label int, " + ", ".join(f"{c} double" for c in dims.FEATURES)
    return materialize(spark.createDataFrame(rows, schema))


def auc(df, score):
    return metrics.roc_auc(df, [score], "binary_label").first().auc


def test_isolation_forest_separates_and_reloads(spark, planted, tmp_path):
    benign = planted.where("binary_label = 0")
    model = fit_isolation_forest(benign, "row_id", trees=40)
    scored = model.score(planted)
    assert auc(scored, "if_score") > 0.97
    assert scored.agg(F.min("if_score"), F.max("if_score")).first()[0] >= 0
    over = model.score(benign).where("if_score > 0.5").count() / benign.count()
    assert 0.03 < over < 0.07  # the contamination share
    model.save(spark, str(tmp_path / "if"))
    again = type(model).load(spark, str(tmp_path / "if"))
    key = lambda df: [tuple(r) for r in df.select("row_id", "if_score").orderBy("row_id").collect()]
    assert key(again.score(planted)) == key(scored)


def test_isolation_forest_with_few_rows(spark, planted):
    few = planted.where("binary_label = 0 and row_id < 60")
    model = fit_isolation_forest(few, "row_id", trees=10)
    assert model.sample_size == few.count() and model.nodes["tree"].nunique() == 10


def test_random_forest_is_seeded_and_explains(spark, planted):
    one, two = (fit_random_forest(planted, trees=10, max_depth=5, seed=7) for _ in range(2))
    a, b = (score_random_forest(m, planted).select("row_id", "rf_score").orderBy("row_id").collect() for m in (one, two))
    assert a == b
    assert auc(score_random_forest(one, planted), "rf_score") > 0.99
    weights = {r.feature: r.importance for r in feature_importance(one, spark).collect()}
    assert list(weights) == dims.FEATURES and abs(sum(weights.values()) - 1) < 1e-6


def test_random_forest_reads_equal_rows_together(spark, planted):
    copies = materialize(planted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("row_id") < 700, 30).otherwise(2)))))
    made = weighted_rows(copies, "binary_label", dims.FEATURES, 8)
    assert made.count() == 700 * 8 + 800 * 2
    for sums in made.groupBy("binary_label").agg(F.sum("weight").alias("w")).collect():
        assert sums.w == pytest.approx(copies.count() / 2)  # both classes weigh the same, and no row is lost
    one = made.where(F.col(dims.FEATURES[0]) == planted.where("row_id = 11").first()[dims.FEATURES[0]])
    weight = copies.count() / (2 * copies.where("binary_label = 0").count())
    assert one.count() == 8 and one.agg(F.sum("weight")).first()[0] == pytest.approx(30 * weight)
    assert auc(score_random_forest(fit_random_forest(copies, trees=10, max_depth=5), planted), "rf_score") > 0.99


def test_random_forest_scores_equal_rows_once(spark, planted):
    model = fit_random_forest(planted, trees=5, max_depth=4)
    read = []

    class Counting:
        stages = model.stages

        def transform(self, rows):
            read.append(rows.count())
            return model.transform(rows)

    copies = planted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn(dims.FEATURES[0], F.col(dims.FEATURES[0]) + F.col("row_id") % 2)
    got = score_random_forest(Counting(), copies)
    assert read == [planted.count()] and got.columns == [*copies.columns, "rf_score"]
    plain = model.transform(copies).select("row_id", "copy", vector_to_array("rf_probability")[1].alias("rf_score"))
    key = lambda df: sorted(tuple(r) for r in df.select("row_id", "copy", "rf_score").collect())
    assert key(got) == key(plain)


def test_autoencoder_gradients():
    w, x = init_weights(6, 1), np.random.default_rng(0).normal(size=(12, 6))
    found = _gradients([a.copy() for a in w], x)

    def loss(weights):
        return ((_forward([a.copy() for a in weights], x, True)[0] - x) ** 2).mean()

    for i in (0, 2, 3, 7, len(w) - 1):
        at = tuple(0 for _ in w[i].shape)
        up, down = [a.copy() for a in w], [a.copy() for a in w]
        up[i][at] += 1e-5
        down[i][at] -= 1e-5
        assert found[i][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_autoencoder_separates_and_reloads(spark, planted, tmp_path):
    model = fit_autoencoder(planted.where("binary_label = 0").repartition(2), epochs=4, batch=64)
    scored = model.score(planted)
    assert auc(scored, "ae_score") > 0.95
    assert model.threshold == pytest.approx(model.error_mean + 3 * model.error_std)
    model.save(spark, str(tmp_path / "ae"))
    again = type(model).load(spark, str(tmp_path / "ae"))
    key = lambda df: [tuple(r) for r in df.select("row_id", "ae_score").orderBy("row_id").collect()]
    assert key(again.score(planted)) == key(scored)


@pytest.mark.parametrize("shard_rows", [100, 16_384])
def test_autoencoder_does_not_depend_on_partitions(planted, shard_rows):
    benign = planted.where("binary_label = 0")
    models = [fit_autoencoder(benign.repartition(n), epochs=3, batch=32, shard_rows=shard_rows) for n in (1, 4, 7)]
    for other in models[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(models[0].weights, other.weights))
        assert other.threshold == pytest.approx(models[0].threshold)


def test_training_run(spark, planted, sf, tmp_path):
    models, scored = train(planted, "row_id", trees=20, rf_trees=10, rf_depth=5, epochs=2)
    report = {(r.model, r.name): r for r in evaluate(materialize(scored)).collect()}
    assert len(report) == 20
    assert report["rf", "ATTACK"].f1 > 0.9 and report["rf", "accuracy"].support == 300
    models.save(spark, str(tmp_path / "m"))
    found, missing = Models.load(spark, str(tmp_path / "m"))
    assert missing == []
    flows = fl.build_flows(packets(spark, sf))
    done = score_flows(flows, found)
    assert done.count() == flows.count() and "byte_rate" in done.columns
    alerts = ml_to_alert(done.withColumn("predicted", F.lit(1)))
    assert '"log_byte_rate":' in alerts.first().raw_features and alerts.first().description.startswith("ML anomaly detected: confidence=")


def test_missing_models_do_not_vote(spark, planted, tmp_path):
    found, missing = Models.load(spark, str(tmp_path / "nothing"))
    assert missing == ["isolation_forest", "random_forest", "autoencoder"]
    row = ensemble_vote(found.score(planted)).first()
    assert (row.votes, row.predicted, row.confidence, row.rf_score) == (0, 0, 0.0, None)


@pytest.mark.parametrize(
    "scores,votes,confidence",
    [((0.7, 0.8, 0.85), 3, 0.7875), ((0.69999, 0.79999, 0.84999), 0, 0.7875), ((1.0, 1.0, None), 2, 0.75), ((None, 0.9, None), 1, 0.45)],
)
def test_votes(spark, scores, votes, confidence):
    row = ensemble_vote(spark.createDataFrame([scores], "if_score double, rf_score double, ae_score double")).first()
    assert (row.votes, row.predicted, row.confidence) == (votes, int(votes >= 2), confidence)


@pytest.mark.parametrize("confidence,severity", [(0.9, "CRITICAL"), (0.8999, "HIGH"), (0.75, "HIGH"), (0.55, "MEDIUM"), (0.5499, "LOW")])
def test_severity_bands(spark, confidence, severity):
    from flowsentry.functions.alerting import severity_from_confidence

    assert spark.range(1).select(severity_from_confidence(F.lit(confidence))).first()[0] == severity


@pytest.mark.parametrize("chunks", [1, 4])
def test_stratified_split_sizes(spark, chunks):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "row_id bigint, y int")
    first, test = stratified_split(rows, "y", "row_id", chunks=chunks)
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 80, 1: 40}
    assert first.count() == 480 and first.join(test, "row_id").count() == 0


@pytest.mark.parametrize("chunks", [1, 5])
def test_auc_equals_pair_count(spark, chunks):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(spark.createDataFrame(rows, "label int, s double"), ["s"], chunks=chunks).first().auc
    assert got == pytest.approx(want)


@pytest.mark.parametrize("chunks", [1, 3])
def test_quantiles_equal_numpy(spark, chunks):
    rng = random.Random(2)
    data = [(float(rng.choice([rng.randint(0, 5), rng.random() * 10])), float(i)) for i in range(401)]
    df = spark.createDataFrame(data, "a double, b double")
    got = {(r.feature, r.p): r.value for r in quantiles_of(value_spans(df, ["a", "b"], chunks), [0, 0.25, 0.5, 0.99, 1]).collect()}
    for c, values in zip("ab", zip(*data)):
        for p in (0, 0.25, 0.5, 0.99, 1):
            assert got[c, p] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("chunks", [1, 6])
def test_ranks_of_a_hot_key(spark, chunks):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], chunks=chunks).collect()
    seen = {}
    for k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        seen[k] = seen.get(k, 0) + 1
        assert next(r.rank for r in got if r.k == k and r.v == v) == seen[k]


def test_clean_labelled(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [("BENIGN", inf, 1), ("DDoS", nan, -5), (None, 1.0, 1), ("DDoS", 2e9, None), ("BENIGN", -inf, 3)], "label string, x double, n int"
    )
    assert sorted(tuple(r) for r in lb.clean_labelled_flows(df).collect()) == [
        ("BENIGN", 0.0, 1.0, 0), ("BENIGN", 0.0, 3.0, 0), ("DDoS", 0.0, 0.0, 1), ("DDoS", 1e9, 0.0, 1)
    ]


def test_read_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration, Label,Src IP\n5,BENIGN,1.1.1.1\n")
    (tmp_path / "b.csv").write_text("Label, Destination Port\nDDoS,80\n")
    (tmp_path / "c.txt").write_text("not,this\n1,2\n")
    df = src.read_labelled_flows(spark, str(tmp_path))
    assert set(df.columns) == {"Flow Duration", "Label", "Src IP", "Destination Port"} and df.count() == 2
    named = src.with_flow_names(df)
    assert {"label", "src_ip", "dst_port", "flow_duration_us"} <= set(named.columns)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        src.read_labelled_flows(spark, str(tmp_path / "none"))


def test_column_discovery(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], ["Flow ID", "SRC_IP", "dst ip", "Dst Port", "Protocol", "LABEL"])
    assert src.discover_flow_columns(df) == {
        "label": "LABEL", "src_ip": "SRC_IP", "dst_ip": "dst ip", "dst_port": "Dst Port", "protocol": "Protocol"
    }


def test_figures_equal_plain_counts(spark, sf):
    """The queries that no SQL can tell: report and scores of the trained models against counts over the scored rows."""
    from flowsentry import dims, queries as q

    rows = ensemble_vote(q.trained(spark, sf)[1]).collect()
    figures = {(r.model, r.name): r for r in q.QUERIES["model_figures"](spark, sf).collect()}
    y = np.array([r.binary_label for r in rows])
    for model in ("if", "rf", "ae", "ensemble"):
        score = np.array([r.confidence if model == "ensemble" else r[f"{model}_score"] for r in rows], float)
        hit = np.array([r.predicted for r in rows]) == 1 if model == "ensemble" else score >= dims.VOTE_THRESHOLDS[model]
        both, found, real = (hit & (y == 1)).sum(), hit.sum(), (y == 1).sum()
        attack = figures[model, "ATTACK"]
        assert attack.support == real and attack.recall == pytest.approx(both / real)
        assert attack.precision == pytest.approx(both / found if found else 0.0)
        pairs = (score[y == 1][:, None] > score[y == 0][None, :]) + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :])
        assert attack.auc == pytest.approx(pairs.mean())
    scored = q.QUERIES["flow_scores"](spark, sf).collect()
    assert len({r.flow_id for r in scored}) == len(scored) == q.flow_table(spark, sf).count()
    for r in scored:
        votes = sum(r[f"{m}_score"] >= dims.VOTE_THRESHOLDS[m] for m in ("if", "rf", "ae"))
        assert (r.votes, r.predicted) == (votes, int(votes >= dims.VOTES_NEEDED))
    weights = [r.importance for r in q.QUERIES["importance_figures"](spark, sf).collect()]
    assert len(weights) == 24 and sum(weights) == pytest.approx(1) and max(weights) > 0.05


def test_all_models_score_equal_rows_once(spark, planted):
    models, _ = train(planted, "row_id", trees=5, rf_trees=5, rf_depth=4, epochs=1)
    read, score = [], models.isolation_forest.score
    models.isolation_forest.score = lambda rows: read.append(rows.count()) or score(rows)
    copies = planted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    got = models.score(copies)
    assert read == [planted.count()] and got.columns == [*copies.columns, "if_score", "rf_score", "ae_score"]
    plain = models.autoencoder.score(score_random_forest(models.random_forest, score(copies)))
    key = lambda df: sorted(tuple(r) for r in df.select("row_id", "copy", "if_score", "rf_score", "ae_score").collect())
    for a, b in zip(key(got), key(plain), strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_stream_walks_the_forest_as_mllib(spark, planted):
    from flowsentry.streaming.replay import replay, run_to_table

    flipped = planted.withColumn("binary_label", F.when(F.col("row_id") % 7 == 0, 1 - F.col("binary_label")).otherwise(F.col("binary_label")))
    model = fit_random_forest(materialize(flipped), trees=15, max_depth=30)
    assert max(t.depth for t in model.stages[-1].trees) > 8

    class NoTransform:
        stages = model.stages  # MLlib takes 200 µs a row of a stream

    copies = materialize(planted.unionByName(planted.where("row_id < 50").withColumn("row_id", F.col("row_id") + 10_000)))
    got = run_to_table(score_random_forest(NoTransform(), replay(copies, "row_id")))
    assert got.columns == [*copies.columns, "rf_score"]
    key = lambda df: sorted(tuple(r) for r in df.select("row_id", "rf_score").collect())
    assert key(got) == key(score_random_forest(model, copies))


def test_stream_refuses_features_without_value(spark, planted):
    from pyspark.errors import StreamingQueryException
    from flowsentry.streaming.replay import replay, run_to_table

    model = fit_random_forest(planted, trees=2, max_depth=2)
    holes = materialize(planted.withColumn(dims.FEATURES[3], F.when(F.col("row_id") != 5, F.col(dims.FEATURES[3]))))
    with pytest.raises(StreamingQueryException):
        run_to_table(score_random_forest(model, replay(holes, "row_id")))


def test_equal_rows_of_a_batch_are_scored_once():
    from flowsentry.ml.batches import once

    x = np.random.default_rng(5).normal(size=(40, 6))[np.random.default_rng(6).integers(0, 40, 500)]
    x[::9, 2] = np.nan
    seen = []

    def scored(rows):
        seen.append(len(rows))
        return np.nansum(rows, axis=1)

    assert np.array_equal(once(x, scored), np.nansum(x, axis=1)) and seen[0] == len(np.unique(x.view("i8"), axis=0)) < 100
    assert np.array_equal(once(x[:1], scored), np.nansum(x[:1], axis=1)) and len(once(x[:0], scored)) == 0


def test_isolation_forest_walks_uneven_trees(spark):
    """Children in any places, leaves at any level: against a walk row by row."""
    import pandas as pd

    from flowsentry.ml.isolation_forest import IsolationForest

    cells = [(0, 0, 0, 0.0, 5, 2, 0.0), (0, 5, -1, 0.0, 5, 5, 4.0), (0, 2, 1, 0.5, 7, 3, 0.0), (0, 7, 0, 1.0, 1, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 2.5), (0, 1, -1, 0.0, 1, 1, 1.5), (0, 4, -1, 0.0, 4, 4, 3.5), (4, 0, -1, 0.0, 0, 0, 6.0)]
    nodes = pd.DataFrame(cells, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])
    forest = IsolationForest(["a", "b"], [0.0, 0.0], [1.0, 1.0], nodes, 16)
    rows = [(float(a), float(b)) for a in (-1, 0, 0.5, 1, 2) for b in (0, 0.5, 1)]

    def length(tree, x):
        at = {c[1]: c for c in cells if c[0] == tree}
        node = 0
        while at[node][2] >= 0:
            node = at[node][5] if x[at[node][2]] > at[node][3] else at[node][4]
        return at[node][6]

    norm = 2 * (np.log(15) + np.euler_gamma) - 2 * 15 / 16
    got = forest.raw(spark.createDataFrame(rows * 3, "a double, b double"), "raw").collect()
    assert len(got) == 45
    for r in got:
        assert r.raw == pytest.approx(-(2 ** (-(length(0, (r.a, r.b)) + length(4, (r.a, r.b))) / 2 / norm)), rel=1e-12)


def test_autoencoder_steps_ask_for_no_memory():
    """A second step of a shard works in the arrays of the first one."""
    import tracemalloc

    from flowsentry.ml.autoencoder import _Room

    w, x, room = init_weights(24, 1), np.random.default_rng(0).normal(size=(256, 24)), _Room()
    found = [np.zeros_like(a) for a in w]
    first = [a.copy() for a in _gradients(w, x, room, found)]
    tracemalloc.start()
    _gradients(w, x, room, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 * 64 * 8 and all(np.array_equal(a, b) for a, b in zip(first, found))


@pytest.mark.parametrize("name", ["score_flows", "flow_scores", "stream_scoring"])
def test_scoring_queries_build_flows_once(spark, sf, name, monkeypatch):
    """Training and scoring read the same stored flows; a batch of the stream is read by all cores."""
    from flowsentry import queries as q

    built, files = [], []
    build, again = q.fl.build_flows, q.replay
    monkeypatch.setattr(q.fl, "build_flows", lambda *a, **k: built.append(1) or build(*a, **k))
    monkeypatch.setattr(q, "replay", lambda df, time, slices, files_each: files.append(files_each) or again(df, time, slices, files_each))
    monkeypatch.setattr(q, "train", lambda rows, row_id: train(rows, row_id, trees=5, rf_trees=5, rf_depth=4, epochs=1))
    kept = q.trained, q.stored_flows
    monkeypatch.setattr(q, "trained", kept[0].__wrapped__)
    q.stored_flows.cache_clear()
    rows = q.QUERIES[name](spark, sf).count()
    assert len(built) == 1 and rows == q.stored_flows(spark, sf).count()
    assert all(n % spark.sparkContext.defaultParallelism == 0 for n in files)
