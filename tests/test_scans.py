"""Running states over pieces of documents against a plain loop, with pieces of a few places so that documents are cut."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import relational, scans
from foliant.plans import catalogue


def lines(seed, n_docs=5, most=60):
    r = random.Random(seed)
    for d in range(n_docs):
        at = -3
        for _ in range(r.randrange(1, most)):
            at += r.randrange(1, 4)
            yield d, at, r


def test_running(spark):
    rows = [(None if d == 4 else d, at, r.choice([None, *range(-5, 6)])) for d, at, r in lines(1)]
    df = spark.createDataFrame(rows, "d int, at long, v int")
    got = scans.running(df, ["d"], "at", {"low": ("min", F.col("v")), "high": ("max", F.col("v")), "all": ("sum", F.col("v"))}, chunk=7).collect()
    assert len(got) == len(rows)
    for x in got:
        seen = [v for d, at, v in rows if d == x["d"] and at <= x["at"] and v is not None]
        assert (x["low"], x["high"], x["all"]) == (min(seen, default=None), max(seen, default=None), sum(seen))


def fold(rows, slots):
    """Slots as a plain list, line by line."""
    state, out = [None] * slots, {}
    for at, depth, name in sorted(rows):
        placed = None
        if name is not None:
            deepest = max((i for i, s in enumerate(state) if s), default=-1)
            placed = min(depth, deepest + 1, slots - 1)
            state = state[:placed] + [(at, name)] + [None] * (slots - placed - 1)
        out[at] = (placed, list(state))
    return out


def test_slot_fill(spark):
    for seed, slots, chunk in ((2, 8, 5), (3, 3, 11), (4, 8, 4096)):
        rows = [(d, at, r.choice([0, 1, 1, 2, 3, 5, 9]), None if r.random() < 0.4 else f"h{at}") for d, at, r in lines(seed)]
        df = spark.createDataFrame([(*x, 1) for x in rows], "d int, at long, depth int, name string, more int")
        got = scans.slot_fill(df, ["d"], "at", "depth", "name", ["more"], slots, chunk)
        got = got.withColumn("leaf", scans.with_leaf(F.col("slots"), F.col("depth"), F.lit("leaf"))).withColumn("short", scans.with_leaf(F.col("slots"), F.col("depth"), F.lit("x"))).collect()
        assert len(got) == len(rows)
        want = {d: fold([x[1:] for x in rows if x[0] == d], slots) for d in range(5)}
        for x in got:
            placed, state = want[x["d"]][x["at"]]
            assert x["placed"] == placed and [s and (s["at"], s["name"]) for s in x["slots"]] == state
            names = [s and s[1] for s in state]
            assert x["short"] == names
            names[min(x["depth"], sum(s is not None for s in state), slots - 1)] = "leaf"
            assert x["leaf"] == names


def test_transitions_and_breaks():
    r = random.Random(6)
    for _ in range(200):
        target = r.randrange(1, 12)
        restart = r.randrange(target)
        amount = [r.choice((0, 1, 2, 5, 30)) for _ in range(r.randrange(0, 30))]
        carry, times = scans.transitions(np.array(amount, np.int64), target, restart)
        for c in range(target):
            count, at = c, []
            for i, w in enumerate(amount):
                count += w
                if count >= target:
                    count, at = restart, [*at, i]
            assert (carry[c], times[c]) == (count, len(at)) and scans.breaks(np.array(amount, np.int64), c, target, restart).tolist() == at


def test_segments(spark):
    rows = [(f"d{d}", at, r.choice([None, 0, 1, 3, 10, 200])) for d, at, r in lines(7)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "d string, at long, w int, kept string")
    for restart, chunk in ((0, 6), (2, 13), (2, 4096)):
        got = {(x["d"], x["at"]): x["segment"] for x in scans.segments(df, "d", "at", "w", 50, restart, chunk).collect()}
        want = {}
        for d in {x[0] for x in rows}:
            count = n = 0
            for _, at, w in sorted(x for x in rows if x[0] == d):
                want[d, at] = n
                count += w or 0
                if count >= 50:
                    count, n = restart, n + 1
        assert got == want
    assert scans.segments(df.limit(0), "d", "at", "w", 50).count() == 0


def test_edge_levels(spark):
    edges = [("a", x) for x in [60.0] + [70.0, 71.5, 73.0] * 4 + [79.0] * 2 + [88.0, 88.25, 90.0] + [125.0] * 9] + [("b", 50.0)] * 4 + [("c", None)] + [("d", 3.0 * k) for k in range(40)]
    got = {x["doc"]: x["levels"] for x in scans.edge_levels(spark.createDataFrame(edges, "doc string, x double"), "doc", "x").collect()}

    def plain(xs):
        groups = []
        for x in sorted(xs):
            if groups and x - sum(groups[-1]) / len(groups[-1]) <= 4:
                groups[-1].append(x)
            else:
                groups.append([x])
        out = []
        for c in [sum(g) / len(g) for i, g in enumerate(groups) if i == 0 or len(g) >= 3]:
            if out and c - out[-1] > 30:
                break
            out.append(c)
        return out[:9]

    assert got == {d: plain([x for e, x in edges if e == d]) for d in "abd"} and len(got["a"]) == 3
    level = spark.createDataFrame([(71.0, [60.0, 71.5, 88.0]), (66.0, [60.0, 72.0]), (5.0, [])], "x double, levels array<double>")
    assert [x[0] for x in level.select(scans.level_of(F.col("x"), F.col("levels"))).collect()] == [1, 0, 0]


def test_segments_by_batches(spark):
    """Pieces that Arrow batches cut; documents of one piece need no table, and no piece is a group joined again with its rows."""
    rows = [(f"d{d}", at, (at * 7 + d) % 23) for d in range(3) for at in range(40 + 90 * d)]
    df = spark.createDataFrame(rows, "d string, at long, w int").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = scans.segments(df, "d", "at", "w", 50, 2, 64)
        got = {(x["d"], x["at"]): x["segment"] for x in cut.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want, count, n = {}, 0, 0
    for d, at, w in rows:
        count, n = (0, 0) if at == 0 else (count, n)
        want[d, at], count = n, count + w
        count, n = (2, n + 1) if count >= 50 else (count, n)
    assert got == want
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_tasks_of_pairs_grow_with_the_rows(spark):
    df = spark.range(1000).selectExpr("id div 5 as basket", "id % 5 * 7 as item")
    pairs = relational.cooccurrence(df, "basket", "item", per_task=100)
    assert "RepartitionByExpression [item_a" in (plan := pairs._jdf.queryExecution().optimizedPlan().toString()) and plan.count(", 11") >= 2
    assert {(x["item_a"], x["item_b"]): x["together"] for x in pairs.collect()} == {(7 * a, 7 * b): 200 for b in range(5) for a in range(b)}


def test_footnotes_read_each_step_once(spark):
    """Steps that several others read are written once, so the last plan holds no step again."""
    plan = catalogue.QUERIES["footnotes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
