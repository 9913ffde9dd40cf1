import math

import numpy as np
import pytest

from labelpick.functions.random import uniform_array
from labelpick.operators import steps
from labelpick.operators.batches import SHUFFLE_DRAW


def plain(ids, size, per_step, epoch, seed):
    """Row ids of every step, batch by batch."""
    u = uniform_array(ids, [0], SHUFFLE_DRAW, seed)[:, 0]
    order = ids[np.lexsort((ids, u))]
    width = size * per_step * -(-steps.BLOCK_BATCHES // per_step)
    n_blocks = -(-len(ids) // width)
    a, c = steps.turn(n_blocks, epoch, steps.BLOCKS, seed)
    out = []
    for number in range(n_blocks):
        block = order[(a * number + c) % n_blocks * width:][:width]
        b, d = steps.turn(len(block), epoch, steps.PLACES, seed)
        moved = np.empty_like(block)
        moved[(b * np.arange(len(block)) + d) % len(block)] = block
        out += [moved[i:i + size * per_step].tolist() for i in range(0, len(moved), size * per_step)]
    return out


@pytest.mark.parametrize("n, size, per_step, block", [(100, 7, 1, 3), (100, 7, 2, 3), (90, 9, 10, 1), (5, 64, 1, 64), (64, 8, 3, 2)])
def test_steps_cover_every_row_once_per_epoch(make_points, monkeypatch, n, size, per_step, block):
    monkeypatch.setattr(steps, "BLOCK_BATCHES", block)
    ids = np.arange(n) * 5 + 2
    layout = steps.lay_out(make_points(np.arange(2 * n).reshape(n, 2), ids=ids), size, per_step, seed=3)
    seen = []
    for epoch in (0, 1, 2):
        got = [[(r.batch, r.pos, r.row_id) for r in step.collect()] for step in layout.steps(epoch)]
        assert [[i for *_, i in sorted(step)] for step in got] == plain(ids, size, per_step, epoch, 3)
        assert all(b * size + p == at for step in got for at, (b, p, _) in enumerate(sorted(step)))
        flat = [i for step in got for *_, i in sorted(step)]
        assert sorted(flat) == ids.tolist()
        seen.append(flat)
    assert n < 6 or seen[0] != seen[1] != seen[2]


def test_turns_are_permutations():
    for size in (1, 2, 7, 64, 4096, 30_030):
        for epoch in range(6):
            a, c = steps.turn(size, epoch, steps.PLACES)
            assert math.gcd(a, size) == 1 and len({(a * x + c) % size for x in range(size)}) == size


def test_a_step_reads_only_its_own_rows(make_points, monkeypatch):
    monkeypatch.setattr(steps, "BLOCK_BATCHES", 1)
    layout = steps.lay_out(make_points(np.arange(400).reshape(200, 2)), 10)
    step = next(iter(layout.steps(1)))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [" in plan and "_part" in plan.split("PushedFilters")[1]


def test_wrong_input(spark, make_points):
    with pytest.raises(ValueError):
        steps.lay_out(make_points([[1.0]]), 0)
    with pytest.raises(ValueError, match="no rows"):
        steps.lay_out(spark.createDataFrame([], "row_id long, embedding array<double>"), 4)


@pytest.mark.parametrize("n, size, per_step, block, most", [(100, 7, 1, 3, 50), (100, 7, 2, 3, 1), (90, 9, 10, 1, 90), (5, 64, 1, 64, 9)])
def test_runs_have_the_steps_of_an_epoch_in_order(make_points, monkeypatch, n, size, per_step, block, most):
    monkeypatch.setattr(steps, "BLOCK_BATCHES", block)
    ids = np.arange(n) * 5 + 2
    layout = steps.lay_out(make_points(np.arange(2 * n).reshape(n, 2), ids=ids), size, per_step, seed=3)
    for epoch in (0, 2):
        runs = [sorted((r.step, r.place, r.row_id) for r in run.collect()) for run in layout.runs(epoch, most)]
        assert all(len(run) <= max(most, layout.block_rows) for run in runs)
        found = {}
        for step, _, i in (row for run in runs for row in run):
            found.setdefault(step, []).append(i)
        assert list(found) == list(range(len(found))) and list(found.values()) == plain(ids, size, per_step, epoch, 3)
