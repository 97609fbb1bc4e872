"""Spectral indices. Bands are doubles; a masked pixel is NULL and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features in the order of the classifier's vector.
FEATURES = ("b02", "b03", "b04", "b08", "ndvi", "ndwi", "brightness", "savi", "evi", "bsi")
TEXTURES = ("homogeneity", "contrast")
BANDS = ("b02", "b03", "b04", "b08")


def ndvi(red: Column, nir: Column) -> Column:
    """NULL where the denominator is 0."""
    return F.try_divide(nir - red, nir + red)


def ndwi(green: Column, nir: Column) -> Column:
    return F.try_divide(green - nir, green + nir)


def brightness(blue: Column, green: Column, red: Column, nir: Column) -> Column:
    return (blue + green + red + nir) / 4


def savi(red: Column, nir: Column, soil: float = 0.5) -> Column:
    return F.try_divide((1 + soil) * (nir - red), nir + red + soil)


def evi(blue: Column, red: Column, nir: Column) -> Column:
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def bsi(blue: Column, red: Column, nir: Column) -> Column:
    return F.try_divide(red + blue - nir, red + blue + nir)


def feature_columns(suffix: str = "") -> list[Column]:
    """All ten features of a date, from band columns with the suffix."""
    blue, green, red, nir = (F.col(b + suffix) for b in BANDS)
    made = (blue, green, red, nir, ndvi(red, nir), ndwi(green, nir), brightness(blue, green, red, nir), savi(red, nir), evi(blue, red, nir), bsi(blue, red, nir))
    return [c.alias(name + suffix) for c, name in zip(made, FEATURES)]


def all_present(*columns: Column) -> Column:
    present = columns[0].isNotNull()
    for c in columns[1:]:
        present = present & c.isNotNull()
    return present
