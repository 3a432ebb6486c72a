"""Column functions of heart rate, power and energy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import C
from .geo import _c, clip


def default_max_hr(age) -> Column:
    return F.greatest(F.lit(120.0), 220.0 - _c(age))


def hr_zones(max_hr, resting_hr=None) -> Column:
    """Five zones from 50 to 100 % of the reserve (of the maximum without a resting rate): array<struct<lo, hi>>."""
    top = _c(max_hr)
    base = _c(resting_hr) if resting_hr is not None else F.lit(0.0)
    bound = lambda k: F.bround(base + (top - base) * (0.5 + 0.1 * k)).cast("int")
    return F.array(*[F.struct(bound(k).alias("lo"), bound(k + 1).alias("hi")) for k in range(5)])


def zone_of(hr, zones: Column) -> Column:
    """Number of the half-open zone, from 0; at or above the last one's top: the last; below the first: null."""
    h = _c(hr)
    found = F.when(h >= F.element_at(zones, 5)["hi"], 4)
    for k in range(5):
        z = F.element_at(zones, k + 1)
        found = found.when((h >= z["lo"]) & (h < z["hi"]), k)
    return found


def trimp_step(hr, seconds, max_hr, resting_hr, female: bool = False) -> Column:
    """Training impulse of one sample: minutes x reserve share x weight."""
    c, k = C.trimp_female if female else C.trimp_male
    share = clip((_c(hr) - _c(resting_hr)) / (_c(max_hr) - _c(resting_hr)), 0.0, 1.0)
    return _c(seconds) / 60 * share * c * F.exp(k * share)


def power(speed, accel, grade, rho, mass, crr=C.crr, cda=C.cda, headwind=0.0, crosswind=0.0, efficiency=C.efficiency) -> dict[str, Column]:
    """Watts at the legs and their parts: rolling, aero, gravity, inertia; gain only is divided by the drive's efficiency."""
    v, angle = _c(speed), F.atan(clip(_c(grade), -1.0, 1.0))
    mass, rho = _c(mass), _c(rho)
    along = v + _c(headwind)
    air = F.sqrt(along * along + _c(crosswind) * _c(crosswind))
    parts = {
        "rolling": _c(crr) * mass * C.gravity * F.cos(angle) * v,
        "aero": 0.5 * rho * _c(cda) * air * along * v,
        "gravity": mass * C.gravity * F.sin(angle) * v,
        "inertia": mass * 1.05 * _c(accel) * v,
    }
    wheel = parts["rolling"] + parts["aero"] + parts["gravity"] + parts["inertia"]
    return parts | {"wheel": wheel, "watts": F.when(wheel > 0, wheel / efficiency).otherwise(wheel)}


def confidence(gravity: Column, watts: Column) -> Column:
    """How much of the power is the well-known gravity part."""
    share = F.when(F.abs(watts) > 1e-9, F.abs(gravity) / F.abs(watts)).otherwise(F.lit(0.0))
    return F.when(share >= 0.5, "high").when(share >= 0.2, "med").otherwise("low")


def logistic(z: Column) -> Column:
    """Logistic function that saturates beyond 40."""
    return 1 / (1 + F.exp(-clip(z, -40.0, 40.0)))


def coast_label(score: Column, has_hr: Column, novel: Column | None = None) -> Column:
    """coast, pedal or ask, by the score's thresholds; without heart rate, or far from all examples: ask."""
    unsure = ~has_hr if novel is None else ~has_hr | novel
    return F.when(unsure, "ask").when(score >= C.coast_accept, "coast").when(score <= C.coast_reject, "pedal").otherwise("ask")


def mode(grade, speed) -> Column:
    return F.when(_c(grade) < C.downhill, "coast").when(_c(speed) < 0.3, "static").otherwise("pedal")


def vo2max(best_5_minutes, weight_kg=C.weight_kg) -> Column:
    return 10.8 * (_c(best_5_minutes) / _c(weight_kg)) + 7.0


def altitude_code(elev) -> Column:
    """Device code of an altitude: a fifth of a metre above -500 m, limited to 32 bits without a sign; null: the invalid code."""
    return F.coalesce(clip(F.bround((_c(elev) + 500.0) * 5.0), 0.0, 4294967294.0).cast("long"), F.lit(4294967295))


def altitude_of(code) -> Column:
    return F.when(_c(code) != 4294967295, _c(code) / 5.0 - 500.0)


def power_band(speed, accel, grade, rho, mass, headwind=0.0, crosswind=0.0, crr=C.crr, cda=C.cda, efficiency=C.efficiency, calibrated: bool = False, sigma_wind=C.sigma_wind) -> dict[str, Column]:
    """Watts with a band of two standard deviations, by first-order propagation of six uncertain inputs; no less than 0."""
    p = power(speed, accel, grade, rho, mass, crr, cda, headwind, crosswind, efficiency)
    v, m, along = _c(speed), _c(mass), _c(speed) + _c(headwind)
    air = F.sqrt(along * along + _c(crosswind) * _c(crosswind))
    angle = F.atan(clip(_c(grade), -1.0, 1.0))
    sigma_cda = F.greatest(_c(cda) * C.sigma_cda_calibrated, F.lit(0.012)) if calibrated else _c(cda) * C.sigma_cda
    sigma_crr = F.greatest(_c(crr) * C.sigma_crr_calibrated, F.lit(0.0003)) if calibrated else _c(crr) * C.sigma_crr
    terms = [
        0.5 * _c(rho) * _c(cda) * v * (F.when(air > 0, along * along / F.when(air > 0, air)).otherwise(F.lit(0.0)) + air) * _c(sigma_wind),
        0.5 * _c(rho) * air * along * v * sigma_cda,
        m * C.gravity * F.cos(angle) * v * sigma_crr,
        m * C.gravity * F.pow(F.cos(angle), F.lit(3.0)) * v * C.sigma_grade,
        (p["rolling"] + p["gravity"] + p["inertia"]) / m * C.sigma_mass,
        p["aero"] / _c(rho) * C.sigma_rho,
    ]
    spread = F.sqrt(sum((t * t for t in terms), F.lit(0.0))) / efficiency
    return p | {"lo": F.greatest(p["watts"] - 2 * spread, F.lit(0.0)), "hi": F.greatest(p["watts"] + 2 * spread, F.lit(0.0)), "sigma": spread}
