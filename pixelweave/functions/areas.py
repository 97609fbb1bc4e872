"""Pixel counts as areas."""

from __future__ import annotations

from pyspark.sql import Column


def square_metres(pixels: Column, pixel_size: float = 10) -> Column:
    return pixels * float(pixel_size * pixel_size)


def hectares(pixels: Column, pixel_size: float = 10) -> Column:
    return square_metres(pixels, pixel_size) / 10_000


def square_km(pixels: Column, pixel_size: float = 10) -> Column:
    return square_metres(pixels, pixel_size) / 1_000_000
