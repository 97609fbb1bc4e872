"""Rasters derived from the driver's tables, as DataFrames and as SQL.

There is no imagery among the tables: pixels are made by modular arithmetic on
integers, so that both sides are the same to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.indices import BANDS
from .operators import grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, scene, b02, b03, b04, b08, scl): before and after; missing pixels are gaps."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 100).cast("int").alias("r"), (F.col("l_suppkey") % 100).cast("int").alias("c"),
        F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"), "before").otherwise("after").alias("scene"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_linenumber").alias("n"), "l_orderkey",
    )
    band = lambda base, shift, span, name: (base + F.sum(F.col("cents") * (F.col("n") + shift) if shift is not None else F.col("cents")) % span).cast("double").alias(name)
    return lines.groupBy("r", "c", "scene").agg(band(300, 2, 1000, "b02"), band(400, 3, 1200, "b03"), band(500, None, 1500, "b04"), band(2000, 1, 2000, "b08"), (F.sum("l_orderkey") % 11).cast("int").alias("scl"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that both dates have, with suffixes _b and _a."""
    both = scenes(spark, sf_dir)
    side = lambda name: both.filter(F.col("scene") == name).drop("scene")
    return grid.align(side("before"), side("after"))


def clear_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair with bands NULL where either date is cloudy, and valid."""
    valid = ~grid.cloudy(F.col("scl_b")) & ~grid.cloudy(F.col("scl_a"))
    rows = pair(spark, sf_dir).withColumn("valid", valid)
    return grid.masked(rows, F.col("valid"), *(f"{b}_{d}" for d in "ba" for b in BANDS))


def scl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-resolution cloud layer of the first date."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"))
    place = lambda key: F.expr(f"cast(({key} % 100) div 2 as int)")
    return lines.groupBy(place("l_partkey").alias("r20"), place("l_suppkey").alias("c20")).agg((F.sum("l_orderkey") % 11).cast("int").alias("scl"))


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, x) without gaps: rows of 100 events."""
    return table(spark, sf_dir, "events").select(F.expr("cast(event_id div 100 as int)").alias("r"), (F.col("event_id") % 100).cast("int").alias("c"), F.col("value").alias("x"))


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, wc): land-cover codes on the dense grid, 0 for unlabelled."""
    codes = F.array(*(F.lit(k) for k in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0)))
    return dense_grid(spark, sf_dir).select("r", "c", F.get(codes, (F.col("r") * 31 + F.col("c") * 17) % 12).alias("wc"))


def class_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for a trained model: classes by NDVI and confidences by arithmetic."""
    from .functions.change import magnitude
    from .functions.indices import ndvi

    rows = clear_pair(spark, sf_dir).withColumns({f"ndvi_{d}": ndvi(F.col(f"b04_{d}"), F.col(f"b08_{d}")) for d in "ba"})
    klass = lambda x: F.coalesce((1 + F.least(F.floor(x * 5), F.lit(3))).cast("int"), F.lit(0))
    delta = F.col("ndvi_a") - F.col("ndvi_b")
    return rows.withColumns({
        "class_b": klass(F.col("ndvi_b")), "class_a": klass(F.col("ndvi_a")), "delta": delta,
        "conf_b": (F.col("r") * 31 + F.col("c") * 17) % 100 / F.lit(100.0), "conf_a": (F.col("r") * 13 + F.col("c") * 7) % 100 / F.lit(100.0),
        "magnitude": magnitude([F.col(f"{b}_a") - F.col(f"{b}_b") for b in BANDS]),
    }).withColumns({
        "ndvi": F.coalesce(F.abs("delta") > 0.1, F.lit(False)), "rf": F.col("valid") & (F.col("class_b") != F.col("class_a")), "cva": F.coalesce(F.col("magnitude") > 800, F.lit(False)),
        "bd": F.coalesce(F.abs(F.col("b04_a") - F.col("b04_b")) > 400, F.lit(False)), "loss": F.coalesce(F.col("delta") < -0.1, F.lit(False)), "gain": F.coalesce(F.col("delta") > 0.1, F.lit(False)),
    })


# The same as common table expressions.

_SUMS = {"b02": "300 + sum(cents * (n + 2)) % 1000", "b03": "400 + sum(cents * (n + 3)) % 1200", "b04": "500 + sum(cents) % 1500", "b08": "2000 + sum(cents * (n + 1)) % 2000"}
SCENES = f"""lines AS (SELECT CAST(l_partkey % 100 AS INT) AS r, CAST(l_suppkey % 100 AS INT) AS c, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'before' ELSE 'after' END AS scene,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber AS n, l_orderkey FROM lineitem),
scenes AS (SELECT r, c, scene, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _SUMS.items())}, CAST(sum(l_orderkey) % 11 AS INT) AS scl FROM lines GROUP BY r, c, scene)"""
PAIR = f"""{SCENES},
pair AS (SELECT b.r, b.c, {', '.join(f'{x}.{k} AS {k}_{x}' for x in 'ba' for k in (*BANDS, 'scl'))} FROM scenes b JOIN scenes a ON b.r = a.r AND b.c = a.c AND b.scene = 'before' AND a.scene = 'after')"""
CLEAR = f"""{PAIR},
clear AS (SELECT r, c, v AS valid, {', '.join(f'CASE WHEN v THEN {b}_{d} END AS {b}_{d}' for d in 'ba' for b in BANDS)} FROM (SELECT *, scl_b NOT IN (3, 8, 9, 10) AND scl_a NOT IN (3, 8, 9, 10) AS v FROM pair))"""
DENSE = "dense AS (SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, value AS x FROM events)"
LABELS = f"""{DENSE}, labelled AS (SELECT r, c, list_extract([10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0], (r * 31 + c * 17) % 12 + 1) AS wc FROM dense)"""
MAPS = f"""{CLEAR},
indexed AS (SELECT *, (b08_b - b04_b) / nullif(b08_b + b04_b, 0) AS ndvi_b, (b08_a - b04_a) / nullif(b08_a + b04_a, 0) AS ndvi_a FROM clear),
classed AS (SELECT *, coalesce(CAST(1 + least(floor(ndvi_b * 5), 3) AS INT), 0) AS class_b, coalesce(CAST(1 + least(floor(ndvi_a * 5), 3) AS INT), 0) AS class_a, ndvi_a - ndvi_b AS delta,
  (r * 31 + c * 17) % 100 / 100e0 AS conf_b, (r * 13 + c * 7) % 100 / 100e0 AS conf_a,
  CASE WHEN valid THEN sqrt({' + '.join(f'({b}_a - {b}_b) * ({b}_a - {b}_b)' for b in BANDS)}) END AS magnitude FROM indexed),
maps AS (SELECT *, coalesce(abs(delta) > 0.1, false) AS ndvi, valid AND class_b <> class_a AS rf, coalesce(magnitude > 800, false) AS cva, coalesce(abs(b04_a - b04_b) > 400, false) AS bd,
  coalesce(delta < -0.1, false) AS loss, coalesce(delta > 0.1, false) AS gain FROM classed)"""
