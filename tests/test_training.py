import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpick.functions import kernels as K
from labelpick.operators import batches, heads, mixmatch, nn, project, scale, select, sets
from labelpick.plans.run import PRESETS, preset, run
from labelpick.sources.states import Resume


@pytest.fixture(scope="module")
def labeled(make_points, blobs):
    x, y = blobs
    return make_points(x, y.tolist())


def _numeric(f, arrays, i, at, step=1e-5):
    up, down = ([a.copy() for a in arrays] for _ in range(2))
    up[i][at] += step
    down[i][at] -= step
    return (f(up) - f(down)) / (2 * step)


def _rows(x, layers, y, loss, pos=None, masks=None):
    values = nn.run_layers(x, layers, masks)
    return nn.logit_gradient(values[-1], y, np.full(len(x), 1 / len(x)), loss, pos)


@pytest.mark.parametrize("loss,pos", [("kl", None), ("bce", None), ("bce", np.array([0.2, 3.0, 1.0]))])
@pytest.mark.parametrize("dropout", [False, True])
def test_gradient_equals_finite_differences(loss, pos, dropout):
    rng = np.random.default_rng(0)
    x, layers = rng.normal(size=(12, 4)), nn.init_layers([4, 6, 5, 3], 1)
    y = K.softmax(rng.normal(size=(12, 3))) if loss == "kl" else rng.integers(0, 2, (12, 3)).astype(float)
    masks = nn.dropout_masks(np.arange(12), layers, 0.5, 3, 7) if dropout else None
    values = nn.run_layers(x, layers, masks)
    _, grad = nn.logit_gradient(values[-1], y, np.full(12, 1 / 12), loss, pos)
    acc = {str(i): np.zeros_like(a) for i, a in enumerate(layers)}
    nn.add_gradient(acc, values, layers, grad, masks)
    for i, a in enumerate(layers):
        at = tuple(s // 2 for s in a.shape)
        want = _numeric(lambda ls: _rows(x, ls, y, loss, pos, masks)[0], layers, i, at)
        assert np.isclose(acc[str(i)][at], want, rtol=1e-4, atol=1e-8)


def test_distributed_gradient_equals_one_batch(labeled, blobs):
    x, y = blobs
    layers = nn.init_classifier(4, 3, (8, 5))
    loss, grads = nn.gradient(nn.with_target(labeled, "single", 3), layers)
    values = nn.run_layers(x, layers)
    want, grad = nn.logit_gradient(values[-1], np.eye(3)[y], np.full(len(x), 1 / len(x)), "kl")
    acc = {str(i): np.zeros_like(a) for i, a in enumerate(layers)}
    nn.add_gradient(acc, values, layers, grad)
    assert np.isclose(loss, want) and all(np.allclose(g, acc[str(i)]) for i, g in enumerate(grads))


def test_dropout_keeps_the_mean_and_depends_on_the_step():
    layers = nn.init_layers([4, 500, 3])
    a, b = (nn.dropout_masks(np.arange(50), layers, 0.25, step, 0)[0] for step in (0, 1))
    assert abs(a.mean() - 1) < 0.02 and (a != b).any() and set(np.unique(a)) == {0.0, 1 / 0.75}


def test_adam_first_step_is_the_learning_rate():
    out = nn.Adam(0.1).update([np.zeros(3)], [np.array([5.0, -2.0, 0.0])])[0]
    assert np.allclose(out, [-0.1, 0.1, 0.0])


def test_early_stopping_keeps_last_or_best():
    checks = [3.0, 1.0, 2.0, 2.0, 0.0]

    def go(keep):
        left = iter(checks)
        return nn.train([np.zeros(1)], lambda p, n: (0.0, [np.full(1, n + 1.0)]), 10, lambda p: next(left), 2, keep)

    last, best = go("last"), go("best")
    assert last.stopped_early and len(last.losses) == 4
    assert last.params[0][0] == 4.0 and best.params[0][0] == 2.0
    full = nn.train([np.zeros(1)], lambda p, n: (0.0, p), 3)
    assert not full.stopped_early and len(full.losses) == 3


def test_supervised_training_learns(labeled):
    fit = nn.fit_supervised(labeled, 3, "single", epochs=15, lr=0.05, hidden=(8,), validation=labeled)
    assert fit.losses[-1] < 0.5 * fit.losses[0]
    table = nn.validation_loss_table(labeled, fit.params, "single", 3).first()
    assert np.isclose(fit.validation[-1], table["loss"]) and table["n"] == 100
    scored = nn.predict(labeled, fit.params, "single", keep=("label",))
    assert scored.filter("label = prediction").count() > 85


def test_local_and_global_loss_by_definition(make_points, blobs):
    x, _ = blobs
    p, w = make_points(x), heads.init_heads(4, 3, 2, seed=2)
    w[0] *= 3
    ema = np.array([[0.2, 0.3, 0.5], [0.4, 0.4, 0.2]])
    z = heads.head_outputs(x, *w)
    log_p = K.log_softmax(z)
    aim = K.sharpen(K.softmax(z - 0.1 * np.log(ema)), 0.5)
    local = (aim * (np.log(aim) - log_p)).sum(2).mean(0)
    glob = []
    for h in range(2):
        top, cls = np.exp(log_p[:, h]).max(1), log_p[:, h].argmax(1)
        sure = top > 0.8
        n, weight = sure.sum(), {}
        for c in set(cls[sure]):
            weight[c] = n / (cls[sure] == c).sum()
        total = sum(weight[c] for c in cls[sure])
        glob.append(sum(-log_p[i, h, cls[i]] * weight[cls[i]] for i in np.flatnonzero(sure)) / total if n else 0.0)
    logits = heads.head_logits(p, w)
    assert np.allclose([r["loss"] for r in heads.local_loss(logits, ema).orderBy("head").collect()], local)
    assert np.allclose([r["loss"] for r in heads.global_loss(logits, 2).orderBy("head").collect()], glob)
    assert np.isclose(heads.head_sums(p, w, ema).loss(), local.sum() + sum(glob))


def test_global_loss_is_zero_without_confident_rows(make_points, blobs):
    w = [np.zeros((2, 4, 3)), np.zeros((2, 3))]
    logits = heads.head_logits(make_points(blobs[0]), w)
    assert [r["loss"] for r in heads.global_loss(logits, 2).collect()] == [0.0, 0.0]


def test_head_gradient_equals_finite_differences(make_points, blobs):
    x, _ = blobs
    p, w = make_points(x), heads.init_heads(4, 3, 2, seed=2)
    w[0] *= 2
    ema = np.full((2, 3), 1 / 3)
    grads = heads.head_gradient(p, w, ema, heads.head_sums(p, w, ema))
    z0 = heads.head_outputs(x, *w)
    aim = K.sharpen(K.softmax(z0 - 0.1 * np.log(ema)), 0.5)
    p0 = K.softmax(z0)
    cls, sure = p0.argmax(2), p0.max(2) > 0.8

    def fixed_target_loss(params):
        log_p = K.log_softmax(heads.head_outputs(x, *params))
        total = (aim * (np.log(aim) - log_p)).sum(2).mean(0).sum()
        for h in range(2):
            present = [c for c in range(3) if (sure[:, h] & (cls[:, h] == c)).any()]
            total += sum(-log_p[sure[:, h] & (cls[:, h] == c), h, c].mean() for c in present) / max(len(present), 1)
        return total

    for i, at in ((0, (0, 1, 2)), (0, (1, 3, 0)), (1, (1, 1))):
        assert np.isclose(grads[i][at], _numeric(fixed_target_loss, w, i, at), rtol=1e-4, atol=1e-8)


def test_head_training_and_selection(make_points, blobs):
    p = make_points(blobs[0])
    fit, ema = heads.fit_heads(p, 3, 2, epochs=4, lr=0.05, validation=p, patience=4)
    assert fit.losses[-1] < fit.losses[0] and np.allclose(ema.sum(1), 1)
    assert np.allclose(ema > 0, True)
    rows = select.select_rows(p, "heads", 5, epochs=2).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5] and len({r["row_id"] for r in rows}) == 5


def test_one_cluster_head_selects_the_smallest_ids(make_points, blobs):
    rows = heads.top_scores(make_points(blobs[0]), heads.init_heads(4, 1, 2), 3).orderBy("rank").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2] and all(r["score"] == 1.0 for r in rows)


@pytest.mark.parametrize("buckets", [1, 5, 65_536])
def test_batches_cover_all_rows_once_in_one_order(make_points, buckets):
    p = make_points(np.arange(46).reshape(23, 2))
    rows = batches.batches(p, 5, 3, buckets=buckets).collect()
    assert sorted((r["batch"], r["pos"]) for r in rows) == [(i // 5, i % 5) for i in range(23)]
    first = {r["row_id"]: (r["batch"], r["pos"]) for r in batches.batches(p, 5, 3).collect()}
    assert {r["row_id"]: (r["batch"], r["pos"]) for r in rows} == first
    head = {r["row_id"] for r in batches.batches(p, 5, 3, first=2, buckets=buckets).collect()}
    assert head == {i for i, (b, _) in first.items() if b < 2}


def test_unlabeled_batches_start_again_when_they_run_out(spark):
    rows = batches.pair_batches(spark, 2, 3, epochs=3).orderBy("batch").collect()
    assert [(r["epoch"], r["labeled_batch"], r["unlabeled_batch"]) for r in rows] == [
        (0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 0), (2, 0, 1), (2, 1, 2)]


def test_partners_are_a_permutation_inside_the_batch(spark):
    rows = [(0, b, u, pos, 100 * b + 10 * u + pos, [1.0], [1.0]) for b in range(3) for u in (0, 1) for pos in range(4)]
    df = spark.createDataFrame(rows, "epoch long, batch long, is_unlabeled int, pos int, row_id long, "
                                     "embedding array<double>, target array<double>")
    got = mixmatch.with_partner(df).collect()
    for b in range(3):
        own = [r for r in got if r["batch"] == b]
        assert sorted(r["row_id"] for r in own) == sorted(r["b_row_id"] for r in own) and len(own) == 8
        assert [r["row_id"] for r in sorted(own, key=lambda r: r["slot"])][:4] == [100 * b + i for i in range(4)]
    assert any(r["row_id"] != r["b_row_id"] for r in got)


def test_noise_is_repeatable_and_scaled(make_points):
    p = make_points(np.zeros((400, 3)))
    a, b = (sorted((r["row_id"], *r["embedding"]) for r in mixmatch.augment(df, 0.1, 4, 1).collect())
            for df in (p, p.repartition(5)))
    assert a == b and abs(np.std([v[1:] for v in a]) - 0.1) < 0.01


@pytest.mark.parametrize("task", ["single", "multi", "onehot"])
def test_mixmatch_trains_each_task(make_points, blobs, task):
    x, y = blobs
    p = make_points(x, y.tolist() if task == "single" else np.eye(3, dtype=int)[y].tolist())
    picks = select.select_density(p, 6, init="first", max_iter=2).selected
    fit = mixmatch.fit_mixmatch(p, picks, 3, task, epochs=3, lr=0.02, hidden=(6,), batch_size=4, validation=p, keep="best")
    assert len(fit.losses) == 3 and np.isfinite(fit.losses).all() and np.isfinite(fit.validation).all()


def test_mixmatch_layout_does_not_change_the_result(make_points, blobs, monkeypatch):
    x, y = blobs
    p = make_points(x, y.tolist())
    picks = select.select_density(p, 6, init="first", max_iter=2).selected
    options = dict(epochs=3, hidden=(6,), batch_size=4)
    whole = mixmatch.fit_mixmatch(p, picks, 3, "single", **options)
    monkeypatch.setattr(mixmatch, "PLAN_ROWS", 1)
    split = mixmatch.fit_mixmatch(p.repartition(2), picks, 3, "single", **options)
    assert np.allclose(whole.losses, split.losses)
    steps = mixmatch.fit_mixmatch(p, picks, 3, "single", batches_per_step=1, **options)
    assert len(steps.losses) == 3 and not np.allclose(steps.losses[1:], whole.losses[1:])


def test_mixmatch_with_all_but_one_row_labeled(make_points, blobs):
    x, y = blobs
    p = make_points(x, y.tolist())
    fit = mixmatch.fit_mixmatch(p, sets.all_but_last(p), 3, "single", epochs=2, hidden=(6,), batch_size=32)
    assert np.isfinite(fit.losses).all()
    with pytest.raises(ValueError, match="no unlabeled row"):
        mixmatch.fit_mixmatch(p, p, 3, "single", epochs=1)
    with pytest.raises(ValueError, match="none of the selected"):
        mixmatch.fit_mixmatch(p, p.filter("row_id < 0"), 3, "single", epochs=1)


def test_missing_input_is_a_clear_error(spark, make_points):
    empty = spark.createDataFrame([], "row_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="no rows"):
        nn.fit_supervised(empty, 2, "single", epochs=1)
    with pytest.raises(ValueError, match="embedding is null"):
        heads.fit_heads(spark.createDataFrame([(1, None)], "row_id long, embedding array<double>"), 2, epochs=1)
    with pytest.raises(ValueError, match="unknown task"):
        nn.predict(make_points([[1.0]]), nn.init_classifier(1, 2), "other")


def test_scaling_gives_null_for_constant_dimensions(make_points):
    p = make_points([[1.0, 5.0, 2.0], [3.0, 5.0, 4.0], [5.0, 5.0, 9.0]])
    std = [r["embedding"] for r in scale.standardize(p).orderBy("row_id").collect()]
    assert np.allclose([v[0] for v in std], [-np.sqrt(1.5), 0, np.sqrt(1.5)]) and all(v[1] is None for v in std)
    mm = [r["embedding"] for r in scale.min_max_scale(p).orderBy("row_id").collect()]
    assert [v[0] for v in mm] == [0, 0.5, 1] and all(v[1] is None for v in mm)


def test_moments_far_from_the_origin(make_points):
    x = 1e6 + np.random.default_rng(0).normal(size=(50, 2))
    mean, std = scale.moments(make_points(x))
    assert np.allclose(mean, x.mean(0)) and np.allclose(std, x.std(0), rtol=1e-9)


def test_projection_equals_svd(spark, labeled, blobs):
    x, _ = blobs
    picks = spark.createDataFrame([(4,), (8,)], "row_id long")
    rows = project.project_2d(labeled, picks).orderBy("row_id").collect()
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for axis, name in enumerate("xy"):
        v = vt[axis] * np.sign(vt[axis][np.abs(vt[axis]).argmax()])
        assert np.allclose([r[name] for r in rows], (x - x.mean(0)) @ v)
    assert [r["row_id"] for r in rows if r["selected"]] == [4, 8]


@pytest.mark.parametrize("method,task", [("density", "single"), ("heads", "multi")])
def test_complete_run(spark, blobs, tmp_path, method, task):
    x, y = blobs
    part = ["train"] * 70 + ["val"] * 20 + ["test"] * 10
    hot = np.eye(3, dtype=int)[y].tolist()
    rows = [(i, v.tolist(), (int(c) if task == "single" else h), s, (int(c) if task == "single" else [float(a) for a in h]))
            for i, (v, c, h, s) in enumerate(zip(x, y, hot, part))]
    kind, base = ("int", "int") if task == "single" else ("array<int>", "array<double>")
    data = spark.createDataFrame(rows, f"row_id long, embedding array<double>, label {kind}, dataset string, guess {base}")
    config = preset(method, task, n_classes=3, n_clusters=5, epochs=2, head_epochs=2, n_init=2, hidden=(6,),
                    baseline_col="guess")
    store = str(tmp_path / "store")
    first = [r["row_id"] for r in run(spark, data, store, "r1", config, "train").collect()]
    again = [r["row_id"] for r in run(spark, data, store, "r1", config, "train").collect()]
    assert sorted(first) == sorted(again) and set(first) <= set(range(70))
    for mode in ("eval", "test"):
        table = run(spark, data, store, "r1", config, mode)
        assert table.filter(F.col("percentage").isNotNull()).count() >= 1 and table.count() == 4
    with pytest.raises(ValueError, match="unknown mode"):
        run(spark, data, store, "r1", config, "other")


@pytest.fixture
def run_table(spark, blobs):
    x, y = blobs
    part = ["train"] * 70 + ["val"] * 20 + ["test"] * 10
    hot = np.eye(3, dtype=int)[y].tolist()
    return spark.createDataFrame([(i, v.tolist(), h, s) for i, (v, h, s) in enumerate(zip(x, hot, part))],
                                 "row_id long, embedding array<double>, label array<int>, dataset string")


def test_supervised_run_weights_labels_and_projection_shows_the_picks(spark, run_table, tmp_path):
    config = preset("density", "multi", n_classes=3, n_clusters=25, n_init=1, clustering="lloyd", epochs=2, hidden=(5,),
                    classifier="supervised", batch_size=8)
    store = str(tmp_path / "store")
    picked = {r["row_id"] for r in run(spark, run_table, store, "a", config, "train").collect()}
    assert run(spark, run_table, store, "a", config, "eval").count() > 0
    shown = run(spark, run_table, store, "a", config, "project").collect()
    assert len(shown) == 70 and {r["row_id"] for r in shown if r["selected"]} == picked
    with pytest.raises(ValueError, match="unknown classifier"):
        run(spark, run_table, store, "b", preset("density", "multi", n_classes=3, n_clusters=5, n_init=1, epochs=1,
                                                 classifier="other"), "train")


def test_models_and_selections_belong_to_their_run(spark, run_table, tmp_path):
    store = str(tmp_path / "store")
    config = preset("density", "multi", n_classes=3, n_clusters=6, n_init=1, epochs=1, hidden=(4,))
    run(spark, run_table, store, "a", config, "train")
    with pytest.raises(FileNotFoundError):
        run(spark, run_table, store, "b", config, "eval")
    run(spark, run_table, store, "b", preset("density", "multi", n_classes=3, n_clusters=6, n_init=1, epochs=1, hidden=(4,),
                                             seed=9), "train")
    before = run(spark, run_table, store, "a", config, "eval").collect()
    other = preset("density", "multi", n_classes=3, n_clusters=3, n_init=1, epochs=1, hidden=(4,), recalculate=True)
    assert run(spark, run_table, store, "a", other, "train").count() == 3
    assert run(spark, run_table, store, "a", config, "eval").columns == run(spark, run_table, store, "a", config, "test").columns
    assert len(before) > 0


def test_training_goes_on_from_a_stored_state(spark, make_points, blobs, tmp_path):
    x, y = blobs
    p = make_points(x, labels=list(y))
    options = dict(hidden=(5,), batch_size=16, batches_per_step=2, validation=p, seed=3)
    whole = nn.fit_supervised(p, 3, "single", epochs=4, **options)
    state = Resume(spark, str(tmp_path / "state"))
    for epochs in (1, 3, 3, 4):
        fit = nn.fit_supervised(p, 3, "single", epochs=epochs, resume=state, **options)
        assert len(fit.losses) == epochs
    assert np.allclose(fit.losses, whole.losses) and np.allclose(fit.validation, whole.validation)
    assert all(np.allclose(a, b) for a, b in zip(fit.params, whole.params))
    assert state._epochs() == [3, 4]


def test_a_half_written_state_does_not_count(spark, make_points, tmp_path):
    state = Resume(spark, str(tmp_path / "state"))
    assert state.load() is None
    arrays = {"params": [np.ones((2, 3))], "best": [np.ones((2, 3))], "losses": np.array([0.5]), "checks": np.zeros(0),
              "counters": np.array([0.0, 1.0]), "mean": [], "square": [], "extra": {"ema": np.eye(2)}}
    state.save(arrays)
    (tmp_path / "state" / "epoch-2").mkdir()
    got = state.load()
    assert got["losses"].tolist() == [0.5] and got["checks"].size == 0 and got["params"][0].shape == (2, 3)
    assert got["extra"]["ema"].tolist() == [[1, 0], [0, 1]]


def test_head_training_resumes_with_its_average(spark, make_points, blobs, tmp_path):
    p = make_points(blobs[0])
    state = Resume(spark, str(tmp_path / "state"))
    whole, ema = heads.fit_heads(p, 4, 2, epochs=3, batch_size=30, validation=p)
    heads.fit_heads(p, 4, 2, epochs=1, batch_size=30, validation=p, resume=state)
    fit, again = heads.fit_heads(p, 4, 2, epochs=3, batch_size=30, validation=p, resume=state)
    assert np.allclose(ema, again) and np.allclose(fit.losses, whole.losses)
    assert all(np.allclose(a, b) for a, b in zip(fit.params, whole.params))


def test_early_stop_is_remembered(spark, make_points, blobs, tmp_path):
    x, y = blobs
    p = make_points(x, labels=list(y))
    state = Resume(spark, str(tmp_path / "state"))
    options = dict(hidden=(4,), validation=p, patience=2, lr=-0.05, resume=state)  # a step the wrong way: gets worse
    first = nn.fit_supervised(p, 3, "single", epochs=10, **options)
    again = nn.fit_supervised(p, 3, "single", epochs=10, **options)
    assert first.stopped_early and again.stopped_early and again.losses == first.losses and len(first.losses) < 10


def test_labeled_batches_are_dealt_anew_every_epoch(spark, make_points):
    from labelpick.operators.batches import batches

    rows = batches(make_points(np.arange(20).reshape(10, 2)), 4, 0)
    got = mixmatch.redealt(rows, range(0, 4), 4, 10).collect()
    dealt = {(r["row_id"]): (r["batch"], r["pos"]) for r in rows.collect()}
    orders = {}
    for epoch in range(4):
        mine = {r["row_id"]: (r["batch"], r["pos"]) for r in got if r["epoch"] == epoch}
        assert len(mine) == 10 and sorted(mine.values()) == sorted(dealt.values())
        orders[epoch] = mine
    assert orders[0] == dealt and len({tuple(sorted(o.items())) for o in orders.values()}) > 1


def test_presets_cover_all_tasks():
    assert {(m, t) for m, t in PRESETS} == {(m, t) for m in ("density", "heads") for t in ("single", "multi", "onehot")}
    assert all(c.method == m and c.task == t for (m, t), c in PRESETS.items())


def _jobs(spark, work):
    """What ``work`` gives, and how many Spark jobs it has run."""
    context, group = spark.sparkContext, f"count-{id(work)}"
    context.setJobGroup(group, "counted")
    try:
        return work(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_small_steps_share_jobs_and_equal_steps_of_their_own(spark, labeled, monkeypatch):
    """300 steps of one row each; a job for each would be 300 jobs and more."""
    many = lambda: heads.fit_heads(labeled, 3, 2, epochs=3, lr=0.05, seed=4, batch_size=1)
    (fit, ema), jobs = _jobs(spark, many)
    assert jobs < 60 and len(fit.losses) == 3
    layers = lambda: nn.fit_supervised(labeled, 3, "single", epochs=2, hidden=(5,), dropout=0.4, seed=2, batch_size=9)
    deep = layers()
    for module in (heads, nn):
        monkeypatch.setattr(module, "most_rows_of_run", lambda layout, values: 0)
    few = lambda **more: heads.fit_heads(labeled, 3, 2, epochs=2, lr=0.05, seed=4, batch_size=20, **more)
    slow, slow_ema = few()
    alone = layers()
    monkeypatch.undo()
    fast, fast_ema = few()
    assert np.allclose(slow.losses, fast.losses) and np.allclose(slow_ema, fast_ema)
    assert all(np.allclose(a, b) for a, b in zip(slow.params, fast.params))
    assert np.allclose(alone.losses, deep.losses) and all(np.allclose(a, b) for a, b in zip(alone.params, deep.params))
