"""Expressions over a pair of dates: differences, change vectors, change types, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of change types by number.
CVA_TYPES = {1: "Vegetation Loss", 2: "Vegetation Gain", 3: "Urban/Soil Gain", 4: "Water/Shadow"}
SEVERITIES = {
    0: "Masked / Cloud",
    1: "Severe Loss",
    2: "Moderate Loss",
    3: "Minor Loss",
    4: "Vegetation Gain",
    5: "Stable Vegetation",
    6: "Stable Bare / Rocky",
    7: "Stable Transition Zone",
}
# NDVI losses that are severe and moderate; NDVI of vegetation before and after, and of bare ground.
SEVERE, MODERATE, VEGETATED, STILL_VEGETATED, BARE = -0.20, -0.10, 0.22, 0.18, 0.12


def difference(before: Column, after: Column) -> Column:
    return after - before


def magnitude(deltas: list[Column]) -> Column:
    """Length of the change vector over the bands that are present; NULL if none is."""
    squares = reduce(lambda a, b: a + b, (F.coalesce(d * d, F.lit(0.0)) for d in deltas))
    some = reduce(lambda a, b: a | b, (d.isNotNull() for d in deltas))
    return F.when(some, F.sqrt(squares))


def direction(d_red: Column, d_nir: Column) -> Column:
    """Angle of the change in degrees, from 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(d_nir, d_red)), F.lit(360.0))


def direction_class(angle: Column, size: Column, threshold: Column) -> Column:
    """Change type by quadrant where the size is over the threshold, else 0."""
    kind = F.when((angle >= 180) & (angle < 270), 1).when((angle >= 90) & (angle < 180), 2).when((angle >= 0) & (angle < 90), 3).when(angle >= 270, 4)
    return F.coalesce(F.when(size > threshold, kind), F.lit(0))


def over(value: Column, threshold: Column) -> Column:
    """Strictly over the threshold; a masked pixel is not."""
    return F.coalesce(value > threshold, F.lit(False))


def either(*masks: Column) -> Column:
    """The union of masks; a NULL mask counts as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(m, F.lit(False)) for m in masks))


def severity(delta: Column, before: Column, after: Column, loss: Column, gain: Column, valid: Column) -> Column:
    """Eight states of a pixel, the first that holds; a NULL mask counts as false."""
    loss, gain = F.coalesce(loss, F.lit(False)), F.coalesce(gain, F.lit(False))
    stable = ~loss & ~gain
    ok = delta.isNotNull() & F.coalesce(valid, F.lit(False))
    state = (
        F.when(loss & (delta < SEVERE), 1).when(loss & (delta < MODERATE), 2).when(loss, 3).when(gain, 4)
        .when(stable & (before >= VEGETATED) & (after >= STILL_VEGETATED), 5).when(stable & (before < BARE), 6).when(stable & (before >= BARE) & (before < VEGETATED), 7).otherwise(0)
    )
    return F.when(ok, state).otherwise(0)
