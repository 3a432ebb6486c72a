"""Loads of rides in any order of arrival, and runs by a table function, against plain Python."""

import math
import random

import pytest

from ridgeline.sources import runs_udtf
from ridgeline.streaming import late

SCHEMA = "rider long, id long, day double, trimp double"


def folded(rows):
    """{id: (ctl, atl)} of (rider, id, day, trimp)."""
    out, state = {}, {}
    for rider, i, day, x in sorted(rows, key=lambda r: (r[2], r[1])):
        last, ctl, atl = state.get(rider, (day, 0.0, 0.0))
        ctl = ctl * math.exp((last - day) / 42) + x * (1 - math.exp(-1 / 42))
        atl = atl * math.exp((last - day) / 7) + x * (1 - math.exp(-1 / 7))
        state[rider] = day, ctl, atl
        out[i] = ctl, atl
    return out


def streamed(spark, path, batches, **more):
    for rows in [*batches, [(-1, -1, 10_000.0, 0.0)]]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        loads = late.training_load(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), **more)
        loads.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return [r for r in spark.read.parquet(f"{path}/out").collect() if r.rider >= 0]


def test_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, k, 100.0 + k // 2, 40.0 + k % 7) for k in range(60)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 12))  # up to twelve days late
    got = streamed(spark, tmp_path, [shuffled[i : i + 15] for i in range(0, 60, 15)], delay="14 days")
    want = folded(rows)
    assert len(got) == 60 and all(r.final for r in got)
    assert {r.id: (r.ctl, r.atl) for r in got} == {i: pytest.approx(v) for i, v in want.items()}


def test_provisional_loads_and_one_that_is_too_late(spark, tmp_path):
    batches = [[(1, 1, 10.0, 50.0), (1, 2, 12.0, 60.0)], [(1, 3, 11.0, 70.0)], [(1, 4, 60.0, 10.0)], [(1, 5, 9.0, 99.0)]]
    got = streamed(spark, tmp_path, batches, delay="14 days", provisional=True)
    told = [(r.id, r.final) for r in got]
    assert told.count((2, False)) == 2 and told.count((3, False)) == 1 and told.count((1, False)) == 1  # the late ride changes what follows only
    assert 5 not in {r.id for r in got}  # behind the watermark
    want = folded([r for b in batches[:3] for r in b])
    assert {r.id: r.ctl for r in got if r.final} == {i: pytest.approx(v[0]) for i, v in want.items()}


def test_runs_of_a_table_function(spark):
    rng = random.Random(2)
    rows = [(ride, i, None if i == 5 else float(i), rng.random() < 0.6) for ride in range(4) for i in range(80)] + [(9, 0, 1.0, None), (9, 1, 2.0, True)]
    spark.createDataFrame(rows, "ride_id long, idx long, t double, is_on boolean").repartition(3).createOrReplaceTempView("run_samples")
    runs_udtf.register(spark, "runs_of")
    want = []
    for ride in (0, 1, 2, 3, 9):
        island, own = 0, []
        for _, i, t, on in [*[r for r in rows if r[0] == ride], (ride, -1, 0.0, False)]:
            if on:
                island += not own
                own.append(t)
            elif own:
                known = [t for t in own if t is not None]
                want.append((ride, island, len(own), min(known, default=None), max(known, default=None)))
                own = []
    for least in (1, 3):
        got = spark.sql(f"SELECT * FROM runs_of({least}, TABLE(run_samples) PARTITION BY ride_id ORDER BY idx)").collect()
        assert sorted(tuple(r) for r in got) == sorted(w for w in want if w[2] >= least)


def test_many_riders_share_few_calls(spark, tmp_path, monkeypatch):
    from pyspark.sql import GroupedData

    keys, whole = [], GroupedData.applyInPandasWithState
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, *a: keys.append(self._df) or whole(self, *a))
    rows = [(r, 10 * r + k, 100.0 + 3 * k + r % 5, 50.0 + r % 7) for r in range(500) for k in range(4)]
    schema = "rider long, id long, day double, trimp double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, -1, 1000.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late.training_load(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {(r["rider"], r["id"]): (r["ctl"], r["atl"]) for r in spark.read.parquet(f"{tmp_path}/out").where("final").collect()}
    for r in (0, 3, 499):
        for k in range(4):
            for days, value in zip((42.0, 7.0), got[r, 10 * r + k], strict=True):
                assert value == pytest.approx(sum((50.0 + r % 7) * math.exp(-3 * (k - j) / days) for j in range(k + 1)) * (1 - math.exp(-1 / days)))
    assert len(got) == 2000 and keys[0].columns[-1] == "_group"
