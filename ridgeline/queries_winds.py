"""Registered queries: fits of noisy rides whose constants and winds are known, so that their SQL is the truth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .operators import wind_fits
from .plans.views import points
from .queries_time import P

CRR, CDA, MASS, RHO, G = 0.005, 0.32, 86.0, 1.225, 9.80665
SPEED_NOISE, GRADE_NOISE = 0.05, 0.002


def _normal(*seed) -> F.Column:
    """A number from the normal distribution that the columns decide."""
    u = lambda k: (F.pmod(F.xxhash64(*seed, F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def _wind() -> tuple[F.Column, F.Column]:
    """Speed and direction of a ride's wind."""
    return 1.0 + F.col("ride_id") % 5, ((F.col("ride_id") * 37) % 360).cast("double")


def noisy_coasts(spark, sf_dir: str) -> DataFrame:
    """ride_id, segment, t, speed, grade, heading: six seconds of coasting for each sample of the ride view, in segments of a minute that turn by 2.4 radians (never, for every
    tenth ride). The grade is what the balance asks for; speed and grade carry noise."""
    k = F.explode(F.sequence(F.col("idx") * 6, F.col("idx") * 6 + 5))
    p = points(spark, sf_dir).select("ride_id", k.alias("k")).select("ride_id", F.floor(F.col("k") / 60).alias("segment"), F.col("k").cast("double").alias("t"))
    straight = F.col("ride_id") % 10 == 9
    turn = 2 * math.pi / (70 + (F.col("ride_id") * 13 + F.col("segment") * 29) % 70)
    phase = turn * F.col("t") + F.col("ride_id") + F.col("segment") * 1.7
    v, a = 9 + 2.5 * F.sin(phase), 2.5 * turn * F.cos(phase)
    heading = F.pmod(F.when(straight, F.lit(0.7)).otherwise(F.col("segment") * 2.4) + 0.05 * F.sin(F.col("t") / 9), F.lit(2 * math.pi))
    p = p.select("*", v.alias("v"), a.alias("a"), heading.alias("heading"))
    wind, to = _wind()
    x, y = wind * F.cos(F.radians(to)), wind * F.sin(F.radians(to))
    along = F.col("v") + x * F.cos("heading") + y * F.sin("heading")
    across = y * F.cos("heading") - x * F.sin("heading")
    drop = (CDA * 0.5 * RHO * F.sqrt(along * along + across * across) * along + MASS * wind_fits.INERTIA * F.col("a")) / (MASS * G)
    # sin(angle) + CRR cos(angle) = -drop
    p = p.select("ride_id", "segment", "t", "v", "heading", (F.asin(-drop / math.hypot(1.0, CRR)) - math.atan(CRR)).alias("angle"))
    return p.select("ride_id", "segment", "t", (F.col("v") + SPEED_NOISE * _normal("ride_id", "t", F.lit("v"))).alias("speed"), (F.tan("angle") + GRADE_NOISE * _normal("ride_id", "t", F.lit("g"))).alias("grade"), "heading")


def _near(c: str, truth, width: float) -> F.Column:
    return F.abs(F.col(c) - truth) < width


@query(P + "SELECT DISTINCT ride_id, ride_id % 10 <> 9 recovered, true crr_near, true cda_near, true wind_near, true known_spread FROM p")
def loop_fit_noisy(spark, sf_dir):
    """Each ride's constants and wind from its own noisy coasts: within 0.002 and 0.03 of the truth, the wind within 0.8 m/s. Rides of one heading fall back to their archived wind."""
    rides = wind_fits.coasting(noisy_coasts(spark, sf_dir))
    wind, to = _wind()
    weather = rides.select("ride_id", wind.alias("wind"), to.alias("wind_dir"), F.lit(RHO).alias("rho"))
    found = wind_fits.with_fallback(rides, weather)
    spread = F.when(F.col("recovered"), F.col("crr_sigma").between(5e-5, 1e-3) & F.col("cda_sigma").between(1e-3, 2e-2)).otherwise(F.col("crr_sigma").isNull())
    return found.select("ride_id", "recovered", _near("crr", CRR, 0.002).alias("crr_near"), _near("cda", CDA, 0.03).alias("cda_near"), _near("wind", wind, 0.8).alias("wind_near"), spread.alias("known_spread"))


@query(P + ", n AS (SELECT DISTINCT ride_id, ride_id % 10 = 9 straight FROM p) SELECT ride_id, straight, NOT straight told, NOT straight crr_near, NOT straight cda_near, NOT straight wind_near, CASE WHEN straight THEN 0 ELSE CAST((SELECT count(*) FROM n WHERE NOT straight) AS INTEGER) END n_rides FROM n")
def pooled_fit_noisy(spark, sf_dir):
    """Rides that turn, as one pool: its constants within 0.00087 and 0.021 of the truth, each wind within 0.8 m/s; rides of one heading, as another, of which nothing can be told."""
    wind, _ = _wind()
    rides = wind_fits.coasting(noisy_coasts(spark, sf_dir))
    nears, out = {"crr_near": _near("crr", CRR, 0.00087), "cda_near": _near("cda", CDA, 0.021), "wind_near": _near("wind", wind, 0.8)}, None
    for straight in (False, True):
        found = wind_fits.pooled_fits(rides.where((F.col("ride_id") % 10 == 9) == straight))
        rows = found.select("ride_id", F.lit(straight).alias("straight"), F.col("crr").isNotNull().alias("told"), *[F.coalesce(near, F.lit(False)).alias(n) for n, near in nears.items()], F.coalesce("n_rides", F.lit(0)).alias("n_rides"))
        out = rows if out is None else out.union(rows)
    return out
