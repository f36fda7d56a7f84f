"""Networks: gradients, independence of the layout, what they can do that simpler detectors cannot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.operators.detectors.bottleneck import fit_bottleneck
from millwatch.operators.detectors.gradient import gradient_sums, minimise, pack_blocks
from millwatch.operators.detectors.networks import (
    bottleneck_kernel, bottleneck_shapes, draw, failure_probabilities, recurrent_kernel, recurrent_shapes,
)
from millwatch.operators.detectors.recon import fit_recon
from millwatch.operators.detectors.sequence import fit_recurrent, score_sequence
from millwatch.plans.prepare import prepare_readings
from millwatch.plans.train import fit_detectors, freeze, load_detectors, save_detectors, score_detectors
from tests.frames import readings, values

FEATURES = ("torque", "vibration")


def differences(kernel, parameters, rows, targets):
    """Central differences of the summed loss."""
    found = np.zeros(len(parameters))
    for i in range(len(parameters)):
        step = np.zeros(len(parameters))
        step[i] = 1e-5
        found[i] = (kernel(parameters + step, rows, targets)[0] - kernel(parameters - step, rows, targets)[0]) / 2e-5
    return found


@pytest.mark.parametrize("size,hidden,neck", [(2, 4, 1), (6, 12, 3)])
def test_bottleneck_gradient(size, hidden, neck):
    rng = np.random.default_rng(1)
    shapes = bottleneck_shapes(size, hidden, neck)
    kernel, rows = bottleneck_kernel(shapes), rng.normal(size=(9, size))
    parameters = draw(shapes, 3) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in shapes))
    assert np.allclose(kernel(parameters, rows, None)[1], differences(kernel, parameters, rows, None), atol=1e-6)


@pytest.mark.parametrize("size,hidden,length", [(1, 2, 1), (3, 5, 8)])
def test_recurrent_gradient_through_all_rows(size, hidden, length):
    rng = np.random.default_rng(2)
    shapes = recurrent_shapes(size, hidden)
    kernel, rows = recurrent_kernel(shapes, length), rng.normal(size=(7, length * size))
    targets = (rng.random(7) < 0.5) * 1.0
    parameters = draw(shapes, 4) + rng.normal(0, 0.3, sum(int(np.prod(s)) for s in shapes))
    assert np.allclose(kernel(parameters, rows, targets)[1], differences(kernel, parameters, rows, targets), atol=1e-6)


def test_quasi_newton_finds_a_curved_minimum():
    def valley(p):
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(minimise(valley, np.array([-1.2, 1.0]), 100, tolerance=1e-12), [1, 1], atol=1e-3)


def curved(spark, n=600):
    """Readings on a bent line, which no straight one follows."""
    rng = np.random.default_rng(6)
    t = rng.uniform(-1.5, 1.5, n)
    return spark.createDataFrame(
        [(i, float(x + rng.normal(0, 0.03)), float(x * x - 0.75 + rng.normal(0, 0.03))) for i, x in enumerate(t)],
        "sample_id bigint, torque double, vibration double",
    )


def test_bottleneck_beats_components_on_a_bent_line_in_every_layout(spark):
    table = curved(spark)
    networks = [fit_bottleneck(table.repartition(n), FEATURES, 600, iterations=60) for n in (1, 7)]
    assert networks[0] == networks[1]
    straight = fit_recon(table, FEATURES)
    errors = table.agg(F.avg(networks[0].raw()), F.avg(straight.raw())).first()
    assert errors[0] < errors[1] / 3
    # a reading off the line stands out
    off = spark.createDataFrame([(1, 0.0, 1.5)], table.schema).select(networks[0].raw()).first()[0]
    assert off > 10 * errors[0]


def test_sums_of_blocks_are_those_of_all_rows(spark):
    table, shapes = curved(spark, 500), bottleneck_shapes(2, 4, 1)
    parameters, kernel = draw(shapes, 9), bottleneck_kernel(shapes)
    blocks = pack_blocks(table, "sample_id", F.array(*FEATURES), F.lit(0.0), 500, 64)
    assert blocks.count() > 4
    loss, gradient = gradient_sums(blocks, kernel, parameters)
    rows = np.array([tuple(r) for r in table.select(*FEATURES).collect()])
    whole = kernel(parameters, rows, None)
    assert np.isclose(loss, whole[0], rtol=1e-5) and np.allclose(gradient, whole[1], atol=1e-4)
    none = gradient_sums(blocks.limit(0), kernel, parameters)
    assert none[0] == 0 and not none[1].any()


def rising(spark, machines=12, length=60):
    """A reading fails when its three last torques rise, whatever their level."""
    rng = np.random.default_rng(7)
    rows = readings(spark, {f"m{i}": length for i in range(machines)}, failures=0.0).toPandas()
    rows["torque"] = rng.normal(0, 1, len(rows))
    grouped = rows.groupby("machine_id")["torque"]
    up = (rows["torque"] > grouped.shift(1)) & (grouped.shift(1) > grouped.shift(2))
    rows["failure_label"] = up.astype(int)
    return spark.createDataFrame(rows, "sample_id bigint, machine_id string, timestamp timestamp_ntz, torque double, vibration double, failure_label int")


def test_recurrent_cell_reads_the_order_of_the_window(spark):
    prepared = prepare_readings(rising(spark), FEATURES)
    scaled = [f"{f}__scaled" for f in FEATURES]
    model = fit_recurrent(prepared.train, scaled, prepared.stats.classes, prepared.stats.rows, hidden=8, iterations=60)
    scored = score_sequence(prepared.test, model, "s").toPandas()
    assert scored["s_raw"].between(0, 1).all() and ((scored["s_raw"] >= 0.5) == (scored["s_prediction"] == 1)).all()

    def loss(p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        y = scored["failure_label"].to_numpy()
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    # the same rows in another order: the cell no longer knows what came last
    from millwatch.operators.detectors.sequence import with_windows

    windows = with_windows(prepared.test, scaled).orderBy("sample_id").toPandas()
    stacked = np.array([[list(r) for r in w] for w in windows["window"]])
    shapes, p = recurrent_shapes(2, 8), np.array(model.parameters)
    straight, mixed = failure_probabilities(p, shapes, stacked), failure_probabilities(p, shapes, stacked[:, ::-1])
    scored = scored.sort_values("sample_id")
    assert np.allclose(straight, scored["s_raw"]) and loss(straight) < 0.45 < loss(mixed)


def test_networks_are_saved_and_score_alike(spark, tmp_path):
    prepared = prepare_readings(readings(spark, {"a": 120, "b": 90}), FEATURES)
    detectors = freeze(fit_detectors(prepared, trees=10, recon_kind="network", sequence_kind="recurrent"), prepared.test)
    save_detectors(spark, detectors, f"{tmp_path}/m")
    again = load_detectors(spark, f"{tmp_path}/m")
    assert again.recon == detectors.recon and again.sequence == detectors.sequence
    names = ("sample_id", "autoencoder_score", "lstm_score", "lstm_prediction", "autoencoder_prediction")
    assert values(score_detectors(prepared.test, again), *names) == values(score_detectors(prepared.test, detectors), *names)
    with pytest.raises(ValueError, match="kind"):
        fit_detectors(prepared, recon_kind="magic")


def test_recurrent_cell_stands_aside_without_failures(spark):
    prepared = prepare_readings(readings(spark, {"a": 40}, failures=0.0), FEATURES)
    model = fit_recurrent(prepared.train, ["torque__scaled"], prepared.stats.classes, prepared.stats.rows)
    assert model.status == "skipped" and model.notes
    assert {r["s_raw"] for r in score_sequence(prepared.test, model, "s").collect()} == {0.0}


def test_kernel_keeps_single_precision_and_agrees_with_double():
    rng = np.random.default_rng(11)
    shapes, length = recurrent_shapes(3, 24), 8
    kernel, parameters = recurrent_kernel(shapes, length), draw(shapes, 5)
    for n in (300, 7):  # memory of the larger block is taken again by the smaller one
        rows, targets = rng.normal(size=(n, length * 3)), (rng.random(n) < 0.2) * 1.0
        double = kernel(parameters, rows, targets)
        single = kernel(parameters, rows.astype(np.float32), targets.astype(np.float32))
        assert np.isclose(single[0], double[0], rtol=1e-5) and np.allclose(single[1], double[1], atol=1e-4)
        assert failure_probabilities(parameters, shapes, rows.reshape(n, length, 3).astype(np.float32)).dtype == np.float32


@pytest.mark.parametrize("kind", ["float64", "float32"])
def test_blocks_are_bytes_of_all_rows(spark, kind):
    table = curved(spark, 300)
    blocks = pack_blocks(table, "sample_id", F.array(*FEATURES), F.col("sample_id"), 300, 64, kind)
    assert dict(blocks.dtypes)["values"] == dict(blocks.dtypes)["targets"] == "binary"
    size, found = np.dtype(kind).itemsize, {}
    for block in blocks.collect():
        assert len(block["values"]) == 2 * len(block["targets"]) == 2 * size * block["rows"]
        found |= dict(zip(np.frombuffer(block["targets"], kind), np.frombuffer(block["values"], kind).reshape(-1, 2).tolist()))
    rows = {r["sample_id"]: [r[f] for f in FEATURES] for r in table.collect()}
    assert len(found) == 300 and all(np.allclose(found[i], rows[i], rtol=1e-6) for i in rows)
