"""Neighbourhood operators on dense grids, by separable window passes.

The grid is cut into square tiles with a margin of the operator's radius and dealt
out by tile once; the pass along rows and the pass along columns then both run
inside a tile, so an operator costs one exchange whatever the size of the image.
Where the neighbourhood goes over the image's border, mirrored (reflect: half-sample
symmetric) or repeated (nearest) pixels stand in.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .grid import Shape

#: Side of a tile in pixels.
TILE = 256


def _places(at: str, n: int | Column, radius: int, mode: str) -> Column:
    """All coordinates from -radius to n + radius - 1 where the pixel stands."""
    x = F.col(at)
    if mode == "nearest":
        low = F.when(x == 0, F.sequence(F.lit(-radius), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
        high = F.when(x == n - 1, F.sequence(F.lit(n), F.lit(n + radius - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.concat(low, F.array(x), high)
    wrapped = lambda p: F.pmod(p, F.lit(2 * n))
    source = lambda p: F.when(wrapped(p) < n, wrapped(p)).otherwise(2 * n - 1 - wrapped(p))
    often = F.filter(F.sequence(F.lit(-radius), F.lit(n + radius - 1)), lambda p: source(p) == x)  # mirrored more than once
    if isinstance(n, Column):
        return F.when(n <= radius, often).otherwise(_mirrored(x, n, radius))
    return often if n <= radius else _mirrored(x, n, radius)


def _mirrored(x: Column, n: int | Column, radius: int) -> Column:
    return F.when((x < radius) & (x >= n - radius), F.array(x, -1 - x, 2 * n - 1 - x)).when(x < radius, F.array(x, -1 - x)).when(x >= n - radius, F.array(x, 2 * n - 1 - x)).otherwise(F.array(x))


def _tiles(at: str, n: int | Column, radius: int, tile: int) -> Column:
    """Tiles that need the coordinate, theirs or in their margin."""
    last = F.floor((n - 1) / tile).cast("int") if isinstance(n, Column) else F.lit((n - 1) // tile)
    clip = lambda x: F.greatest(F.lit(0), F.least(last, F.floor(x / tile).cast("int")))
    return F.sequence(clip(F.col(at) - radius), clip(F.col(at) + radius))


def focal(grid: DataFrame, shape: Shape, values: dict[str, Column], along: Callable[[str, WindowSpec, bool], Column], radius: int, mode: str = "reflect", tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, c) and each of the values after along() has been taken over rows, then over columns.

    along(name, window, second) is the one-dimensional operator; its window is
    ordered and has all places within the radius of each pixel that is kept. With by,
    columns that tell grids apart, the shape's height and width are names of columns:
    the extent of each grid. Tiles of all grids are then dealt out together.
    """
    height, width = (F.col(shape.height), F.col(shape.width)) if by else (shape.height, shape.width)
    extent = (shape.height, shape.width) if by else ()
    if not by and shape.height * shape.width == 0:
        return grid.select("r", "c", *(v.alias(k) for k, v in values.items()))
    cells = grid.select(*by, *extent, "r", "c", *(v.alias(k) for k, v in values.items()))
    rows = cells.select(*by, *extent, F.explode(_places("r", height, radius, mode)).alias("r"), "c", *values)
    rows = rows.select(*by, *extent, "r", F.explode(_places("c", width, radius, mode)).alias("c"), *values)
    rows = rows.select(*by, *extent, "r", "c", F.explode(_tiles("r", height, radius, tile)).alias("tr"), *values)
    rows = rows.select(*by, *extent, "r", "c", "tr", F.explode(_tiles("c", width, radius, tile)).alias("tc"), *values).repartition(*by, "tr", "tc")
    across = Window.partitionBy(*by, "tr", "tc", "r").orderBy("c")
    down = Window.partitionBy(*by, "tr", "tc", "c").orderBy("r")
    rows = rows.select(*by, *extent, "r", "c", "tr", "tc", *(along(k, across, False).alias(k) for k in values))
    rows = rows.select(*by, *extent, "r", "c", "tr", "tc", *(along(k, down, True).alias(k) for k in values))
    own = F.col("r").between(F.col("tr") * tile, F.least(F.col("tr") * tile + tile, F.lit(height)) - 1) & F.col("c").between(F.col("tc") * tile, F.least(F.col("tc") * tile + tile, F.lit(width)) - 1)
    return rows.filter(own).select(*by, "r", "c", *values)


def gaussian_taps(sigma: float = 1.0, truncate: float = 4.0) -> list[float]:
    """Weights of the places 0, 1, 2, ... from the centre; both sides sum to 1."""
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    whole = w[0] + 2 * sum(w[1:])
    return [x / whole for x in w]


def gaussian(grid: DataFrame, shape: Shape, *columns: str, sigma: float = 1.0, tile: int = TILE, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Blurs columns of a dense grid, or of several (see focal); NULL counts as 0 and stays NULL. Carried columns come along as they are."""
    taps = gaussian_taps(sigma)

    def along(name: str, window: WindowSpec, second: bool) -> Column:
        out = F.col(name) * taps[0]
        for k, w in enumerate(taps[1:], start=1):
            out = out + (F.lag(name, k).over(window) + F.lead(name, k).over(window)) * w
        return out

    marked = {f"_null_{c}": F.col(c).isNull() for c in columns}
    kept = lambda name, window, second: along(name, window, second) if name in columns else F.col(name)
    out = focal(grid, shape, {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns} | marked | {c: F.col(c) for c in carry}, kept, len(taps) - 1, tile=tile, by=by)
    return out.select(*by, "r", "c", *(F.when(~F.col(f"_null_{c}"), F.col(c)).alias(c) for c in columns), *carry)


def box_texture(grid: DataFrame, shape: Shape, column: str | dict[str, str], window: int = 5, tile: int = TILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Homogeneity 1 / (1 + variance) and contrast (max - min) of the window around each pixel.

    Several columns, given with suffixes for the result's names, are taken in one
    pass; carried columns come along as they are.
    """
    half = window // 2
    of = {"": column} if isinstance(column, str) else {suffix: c for c, suffix in column.items()}

    def along(name: str, spec: WindowSpec, second: bool) -> Column:
        if name in carry:
            return F.col(name)
        frame = spec.rowsBetween(-half, half)
        return (F.min if name.startswith("low") else F.max if name.startswith("high") else F.avg)(name).over(frame)

    values = {}
    for suffix, c in of.items():
        x = F.col(c).cast("double")
        values |= {f"mean{suffix}": x, f"square{suffix}": x * x, f"low{suffix}": x, f"high{suffix}": x}
    out = focal(grid, shape, values | {c: F.col(c) for c in carry}, along, half, tile=tile)
    made = []
    for suffix in of:
        spread = F.greatest(F.col(f"square{suffix}") - F.col(f"mean{suffix}") * F.col(f"mean{suffix}"), F.lit(0.0))
        made += [(1 / (1 + spread)).alias(f"homogeneity{suffix}"), (F.col(f"high{suffix}") - F.col(f"low{suffix}")).alias(f"contrast{suffix}")]
    return out.select("r", "c", *made, *carry)


def majority(grid: DataFrame, shape: Shape, columns: list[str], classes: list[int], valid: Column | None = None, window: int = 5, tile: int = TILE) -> DataFrame:
    """Most frequent class within the window; 0 does not vote, ties go to the smallest class.

    NULL counts as 0; pixels that are not valid become 0.
    """
    half = window // 2
    values = {f"{c}_{k}": F.coalesce((F.col(c) == k).cast("int"), F.lit(0)) for c in columns for k in classes}
    ok = (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).alias("_ok")
    out = focal(grid, shape, values | {"_ok": ok}, lambda name, spec, second: F.col(name) if name == "_ok" else F.sum(name).over(spec.rowsBetween(-half, half)), half, mode="nearest", tile=tile)
    winner = {}
    for c in columns:
        most = F.greatest(*(F.col(f"{c}_{k}") for k in classes)) if len(classes) > 1 else F.col(f"{c}_{classes[0]}")
        pick = F.when(~F.col("_ok") | (most == 0), 0)
        for k in sorted(classes):
            pick = pick.when(F.col(f"{c}_{k}") == most, k)
        winner[c] = pick
    return out.select("r", "c", *(v.cast("int").alias(c) for c, v in winner.items()))
