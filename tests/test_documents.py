"""The metrics document: its parts, and rides that lack some of them."""

from ridgeline.plans.read_models import metrics_document

SAMPLES = "ride_id long, t double, hr double, watts double, speed double, mode string"


def rides():
    steady = [(1, 10.0 * k, 130 + k * 0.1, 180.0 + k % 7, 7.0, "pedal") for k in range(200)]
    no_heart = [(2, 10.0 * k, None, 200.0, 8.0, "pedal") for k in range(40)]
    return [*steady, *no_heart, (3, 0.0, 120.0, 100.0, 5.0, "pedal"), (4, 0.0, None, None, None, None), (None, 0.0, 1.0, 1.0, 1.0, "pedal")]


def test_parts_and_what_is_lacking(spark):
    got = {r["ride_id"]: r for r in metrics_document(spark.createDataFrame(rides(), SAMPLES)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    whole, plain, single, empty = (got[i] for i in (1, 2, 3, 4))
    assert (whole["n_points"], whole["duration_s"], whole["has_hr"]) == (200, 1990.0, True)
    assert abs(sum(whole["heart"]["zones"]) - 1990.0) < 1e-6 and whole["heart"]["max"] == 130 + 19.9
    assert whole["drift"]["drift_bpm_per_hr"] == 36.0 and whole["drift"]["n_windows"] == 1  # 0.1 bpm in 10 s
    assert [w["hr"] for w in whole["watts_at_hr"]] == [130, 140, 150, 160] and abs(whole["watts_at_hr"][0]["watts"] - 183) < 2
    assert sorted(whole["power"]["curve"]) == [1, 2, 5, 10, 20, 30, 60] and whole["power"]["curve"][60] < whole["power"]["curve"][1] <= 186
    assert round(whole["power"]["vo2max"], 6) == round(10.8 * whole["power"]["curve"][5] / 75 + 7, 6)
    assert plain["heart"] is None and plain["drift"] is None and plain["watts_at_hr"] is None and not plain["has_hr"]
    assert plain["power"]["avg"] == 200.0 and plain["power"]["pedalling"] == 1.0 and round(plain["power"]["normalized"], 6) == 200.0
    assert single["duration_s"] == 0.0 and single["heart"]["avg"] == 120.0 and single["drift"] is None and single["power"]["curve"][1] == 100.0
    assert empty["n_points"] == 1 and not empty["has_hr"] and empty["power"]["avg"] is None


def test_no_rides(spark):
    assert metrics_document(spark.createDataFrame([], SAMPLES)).count() == 0
