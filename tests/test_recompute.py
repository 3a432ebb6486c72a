"""Refreshing derived tables by key: equal to a full run, over the changed keys alone."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.plans import committed, recompute



def steps(calls):
    def sums(t):
        calls.append(("sums", sorted(r[0] for r in t["samples"].select("ride_id").distinct().collect())))
        return t["samples"].join(t["tags"], "ride_id", "left").crossJoin(t["profile"]).groupBy("ride_id").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(1.0)) * F.col("mass")).alias("total"))

    def top(t):
        calls.append(("top", sorted(r[0] for r in t["samples"].select("ride_id").distinct().collect())))
        return t["samples"].groupBy("ride_id").agg(F.max("v").alias("top"))

    def share(t):
        calls.append(("share", sorted(r[0] for r in t["sums"].collect())))
        return t["sums"].join(t["top"], "ride_id").select("ride_id", (F.col("total") / F.col("top")).alias("share"))

    S = recompute.Step
    return [S("sums", ("samples", "tags", "profile"), sums), S("top", ("samples",), top), S("share", (), share, after=("sums", "top"))]


@pytest.fixture
def world(spark):
    calls = []
    samples = [(i, float(i * k % 5 + 1)) for i in range(6) for k in range(4)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)

    class W:
        root = tempfile.mkdtemp(prefix="spark-")

        def refresh(self, rows=samples, tags=(), mass=2.0):
            calls.clear()
            inputs = {"samples": made(rows, "ride_id long, v double"), "tags": made(list(tags), "ride_id long, w double")}
            done = recompute.refresh(spark, self.root, steps(calls), inputs, {"profile": made([(mass,)], "mass double")})
            return done, dict(calls)

        def rows(self, name, schema):
            return {r[0]: (round(r[1], 9), r[2]) for r in recompute.table(spark, self.root, name, T.StructType.fromDDL(schema)).collect()}

    w = W()
    w.samples = samples
    return w


def expected(rows, tags=(), mass=2.0):
    w = dict(tags)
    return {i: round(sum(v * w.get(i, 1.0) * mass for j, v in rows if j == i) / max(v for j, v in rows if j == i), 9) for i, _ in rows}


def shares(world):
    return {i: v for i, (v, _) in world.rows("share", "ride_id long, share double").items()}


def test_only_what_a_change_concerns_is_computed(spark, world):
    everything = list(range(6))
    assert world.refresh() == (1, {"sums": everything, "top": everything, "share": everything})
    assert shares(world) == expected(world.samples)
    assert world.refresh() == (None, {})
    assert world.refresh(tags=[(3, 0.5)]) == (2, {"sums": [3], "top": [], "share": [3]})  # a tag: its ride, not what samples alone decide
    assert shares(world) == expected(world.samples, [(3, 0.5)])
    assert {i: b for i, (_, b) in world.rows("top", "ride_id long, top double").items()} == dict.fromkeys(everything, 1)
    assert world.refresh(tags=[(3, 0.5)], mass=3.0)[1] == {"sums": everything, "top": [], "share": everything}  # the profile: all rides
    assert shares(world) == expected(world.samples, [(3, 0.5)], 3.0)
    assert {(r["batch"], r["step"]): r["n_keys"] for r in recompute.touched(spark, world.root).collect()} == {(1, "sums"): 6, (1, "top"): 6, (1, "share"): 6, (2, "sums"): 1, (2, "share"): 1, (3, "sums"): 6, (3, "share"): 6}


def test_rides_that_come_change_and_go(world):
    world.refresh()
    rows = [r for r in world.samples if r[0] != 2] + [(9, 4.0), (4, 7.0)]
    assert world.refresh(rows) == (2, {"sums": [4, 9], "top": [4, 9], "share": [4, 9]})
    assert shares(world) == expected(rows)
    assert world.refresh(rows) == (None, {})
    assert world.refresh(world.samples)[1]["sums"] == [2, 4]  # back again
    assert shares(world) == expected(world.samples)
    assert world.refresh([])[0] == 4 and shares(world) == {}


def test_order_is_no_change_and_repeats_are(world):
    world.refresh()
    assert world.refresh(world.samples[::-1]) == (None, {})
    assert world.refresh([*world.samples, world.samples[4]])[1]["sums"] == [world.samples[4][0]]
    assert world.refresh([*world.samples, (None, 1.0), (1, None)])[1]["sums"] == [1]


def test_a_failure_before_the_marker_changes_nothing(world, monkeypatch):
    world.refresh()
    before = shares(world)
    stage = committed.stage

    def failing(root, batch, name, rows):
        if name == "share":
            raise OSError("disk")
        stage(root, batch, name, rows)

    monkeypatch.setattr(committed, "stage", failing)
    with pytest.raises(OSError):
        world.refresh(tags=[(1, 9.0)])
    assert shares(world) == before
    monkeypatch.setattr(committed, "stage", stage)
    assert world.refresh(tags=[(2, 9.0)]) == (2, {"sums": [2], "top": [], "share": [2]})  # the failed try's ride 1 isn't among them
    assert shares(world) == expected(world.samples, [(2, 9.0)])


def test_empty_tables_and_wrong_steps(spark, world):
    assert world.refresh([]) == (None, {}) and shares(world) == {}
    S = recompute.Step
    for bad in ([S("a", (), None, after=("b",))], [S("a", (), None), S("a", (), None)], [S("stamps", (), None)]):
        with pytest.raises(ValueError):
            recompute.refresh(spark, world.root, bad, {"samples": spark.createDataFrame([], "ride_id long")})


def test_content_tells_nulls_apart(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, "a", None), (3, "a", None), (4, None, None)]
    found = {r[0]: r[1] for r in recompute.content(spark.createDataFrame(rows, "k long, x string, `y.z` string"), "k").collect()}
    assert len(set(found.values())) == 4
    same = recompute.content(spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")).collect()
    assert len(same) == 1
