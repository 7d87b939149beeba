"""Units, walking time, decay bands and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT_M = 0.3048
ACRE_M2 = 4046.8564224


def length_m(c: Column, unit_to_m: float) -> Column:
    return c * F.lit(unit_to_m)


def area_m2(c: Column, unit_to_m: float) -> Column:
    return c * F.lit(unit_to_m**2)


def feet(metres: Column) -> Column:
    return metres / F.lit(FOOT_M)


def square_feet(m2: Column) -> Column:
    return m2 / F.lit(FOOT_M**2)


def acres(m2: Column) -> Column:
    return m2 / F.lit(ACRE_M2)


def walk_minutes(metres: Column, metres_per_second: float) -> Column:
    """Minutes on foot; the speed must be positive."""
    if metres_per_second <= 0:
        raise ValueError("walking speed must be positive")
    return metres / F.lit(metres_per_second) / 60.0


def band_weight(minutes: Column, bands: tuple[tuple[float, float], ...] = ((3, 1.0), (5, 0.6), (8, 0.25))) -> Column:
    """Weight of the first band whose upper end is not exceeded; 0 beyond the last."""
    out = F.when(minutes <= bands[0][0], bands[0][1])
    for upper, w in bands[1:]:
        out = out.when(minutes <= upper, w)
    return out.otherwise(0.0)


def floors(levels: Column, height_m: Column, floor_m: float) -> Column:
    """Stated levels, else the height in floors (half to even), at least one."""
    return F.greatest(F.coalesce(levels.cast("double"), F.bround(height_m / floor_m)), F.lit(1.0))


def bearing(dx: Column, dy: Column) -> Column:
    """Direction of a segment in degrees, both ways alike: 0 to below 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), F.lit(180.0) - F.abs(a - b))
