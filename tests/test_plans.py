"""Waves, stuck tasks and audits against a plain walk, for plans in a row and for larger ones; prompts of odd tasks."""

import random

import pytest

from tracemill.operators import plans as P

TASKS = "plan_id string, ord int, id string, inputs array<string>, outputs array<string>"


def plain(rows):
    """{(plan, id, ord): (level, reason)}"""
    out = {}
    for plan in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == plan]
        have, left, level = set(), list(own), 0
        while now := [t for t in left if all(k is not None and k in have for k in t[3] or ())]:
            out |= {(plan, t[2], t[1]): (level, None) for t in now}
            left, level = [t for t in left if t not in now], level + 1
            have |= {k for t in now for k in t[4] or () if k is not None}
        made = {k for t in own for k in t[4] or () if k is not None}
        out |= {(plan, t[2], t[1]): (None, P.MISSING if any(k not in made for k in t[3] or ()) else P.BLOCKED) for t in left}
    return out


def tables(seed, n=40):
    rng, rows = random.Random(seed), []
    for p in range(n):
        size, plan = rng.randint(1, 9), None if p == 0 else f"p{p}"
        for i in range(size):
            keys = [f"k{rng.randint(0, size)}" for _ in range(rng.randint(0, 2))]
            rows.append((plan, i, f"t{i}", rng.choice([keys, None, [*keys, *keys], [*keys, None]]) if rng.random() < 0.3 else keys, rng.choice([[f"k{i}"], [f"k{i}", "k0"], [], None, [None]])))
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 128), (1, 4), (2, 0)])
def test_waves(spark, monkeypatch, seed, most):
    monkeypatch.setattr(P, "ROW_TASKS", most)
    rows = tables(seed)
    want, frame = plain(rows), spark.createDataFrame(rows, TASKS).repartition(3)
    levels, stuck = P.execution_levels(frame), P.stuck_tasks(frame)
    assert sorted(map(repr, ((r.plan_id, r.id, r.level) for r in levels.collect()))) == sorted(map(repr, ((p, i, x) for (p, i, _), (x, _) in want.items() if x is not None)))
    assert sorted(map(repr, map(tuple, stuck.collect()))) == sorted(map(repr, ((p, i, r) for (p, i, _), (_, r) in want.items() if r)))
    audits = {r.plan_id: (r.n_tasks, r.n_missing, r.n_blocked) for r in P.audit_plans(frame).collect()}
    assert audits == {plan: (len(own := [v for k, v in want.items() if k[0] == plan]), sum(v[1] == P.MISSING for v in own), sum(v[1] == P.BLOCKED for v in own)) for plan in {r[0] for r in rows}}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(tables(3), TASKS)
    for df in (P.execution_levels(frame), P.stuck_tasks(frame), P.audit_plans(frame)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Pandas", "InArrow")) and text.count("Exchange hashpartitioning") == 1


def test_a_plan_of_many_tasks(spark):
    """20,000 tasks without a plan_id, in four waves."""
    rows = [(None, i, f"t{i}", [] if i < 100 else [f"k{i % 100}"] if i < 10_000 else [f"k{i - 5000}", f"k{i % 100}"], [f"k{i}"]) for i in range(20_000)]
    got = {r.id: r.level for r in P.execution_levels(spark.createDataFrame(rows, TASKS)).collect()}
    assert len(got) == 20_000 and [sum(v == x for v in got.values()) for x in range(5)] == [100, 9_900, 5_000, 5_000, 0]


def test_prompts_of_odd_tasks(spark):
    rows = [("p", "a", ["x", "y"], ["o"]), ("p", "a", ["x", "y"], ["o"]), (None, "b", ["x"], []), ("p", "c", [], []), ("p", "d", None, []), ("p", "e", ["no", None], []), ("q", "f", ["x"], [])]
    tasks = spark.createDataFrame(rows, "plan_id string, id string, inputs array<string>, outputs array<string>")
    slots = spark.createDataFrame([("p", "x", "1"), ("p", "y", None), (None, "x", "none")], "workflow_id string, slot string, value string")
    got = sorted(((r.plan_id, r.id, r.inputs_text) for r in P.task_prompts(tasks, slots).collect()), key=repr)
    assert got == sorted([("p", "a", "x: 1\ny: ")] * 2 + [(None, "b", "x: "), ("p", "c", ""), ("p", "d", ""), ("p", "e", "no: "), ("q", "f", "x: ")], key=repr)
