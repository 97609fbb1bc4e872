"""Compositions of methods: all evidence about a pair, and the steps that refine a forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions.classes import CLASS_NAMES
from ..operators import grid
from ..operators.crosstab import transitions
from . import consensus, learning, reporting
from .methods import ChangeResult


@dataclass
class Integrated:
    """Lazy tables of an integrated run."""

    scored: DataFrame
    summary: DataFrame
    transitions: DataFrame
    severity: DataFrame
    table: DataFrame


def integrated(bd: ChangeResult, ndvi: ChangeResult, cva: ChangeResult, forest: learning.ForestResult, weights: consensus.Weights = consensus.Weights(), least_confidence: float = 0.60, n_classes: int = 4) -> Integrated:
    """Consensus of four methods, credible transitions, NDVI severity and the summary table.

    The methods' pixels are joined on the pixel. Transitions are those of confident
    pixels, or of all where none is confident.
    """
    n = ndvi.pixels.select("r", "c", "delta", "ndvi_b", "ndvi_a", "loss", "gain", F.col("changed").alias("ndvi"))
    v = cva.pixels.select("r", "c", "magnitude", F.col("changed").alias("cva"))
    b = bd.pixels.select("r", "c", F.col("changed").alias("bd"))
    f = forest.pixels.select("r", "c", "class_b", "class_a", "conf_b", "conf_a", "valid", F.col("changed").alias("rf"))
    pixels = n.join(v, ["r", "c"]).join(b, ["r", "c"]).join(f, ["r", "c"], "left")
    scored = consensus.consensus(pixels, weights, forest.mode != "unsupervised", least_confidence)
    sure = (F.col("conf_b") >= least_confidence) & (F.col("conf_a") >= least_confidence)
    some = not forest.pixels.filter(sure & F.col("valid")).isEmpty()
    matrix = transitions(forest.pixels, "class_b", "class_a", n_classes, sure if some else None)
    share = lambda m, ok: F.coalesce(F.try_divide(F.count_if(m) * F.lit(100.0), F.count_if(ok)), F.lit(0.0))
    totals = pixels.agg(share(F.col("ndvi"), F.col("delta").isNotNull()).alias("ndvi_pct"), share(F.col("rf"), F.col("valid")).alias("rf_pct"))
    summary = consensus.consensus_summary(scored)
    table = reporting.summary_table(reporting.compare([bd, ndvi, cva]).unionByName(forest_row(forest, n_classes), allowMissingColumns=True))
    # Fixed value: the consensus's name in the table.
    agreed = summary.select(F.lit("Consensus (NDVI+RF+CVA+BD)").alias("method"), display.percent(F.col("change_pct_any")).alias("change"), F.concat(display.fixed(F.col("change_pct_any") * 4, 0), F.lit(" km²")).alias("changed_area"), F.lit("w=" + str({k: round(x, 3) for k, x in weights.shares(forest.mode != "unsupervised").items()})).alias("threshold"))
    return Integrated(scored, summary, consensus.credible_transitions(matrix, F.col("ndvi_pct"), F.col("rf_pct"), totals), consensus.ndvi_severity(pixels.withColumn("valid", F.coalesce("valid", F.lit(False)))), table.unionByName(agreed))


def forest_row(forest: learning.ForestResult, n_classes: int = 4) -> DataFrame:
    """The forest's row of the comparison table: change, hold-out accuracy, stable share of each class."""
    p = forest.pixels
    one = p.agg(F.round(F.coalesce(F.try_divide(F.count_if("changed") * F.lit(100.0), F.count_if("valid")), F.lit(0.0)), 4).alias("change_pct"), F.count_if("changed").alias("changed_pixels"), F.count("*").alias("total_pixels"), F.lit(None).cast("double").alias("threshold"))
    stable = transitions(p, "class_b", "class_a", n_classes).filter("class_before = class_after").groupBy().pivot("class_before", list(range(1, n_classes + 1))).agg(F.round(F.first("row_pct"), 2))
    named = stable.select(*(F.col(str(k)).alias(f"rf_stable_{CLASS_NAMES[k].lower().replace(' ', '_')}_pct") for k in range(1, n_classes + 1)))
    return one.crossJoin(F.broadcast(named)).select(F.lit("Random Forest").alias("method"), "*", F.lit(round(forest.accuracy * 100, 2)).alias("rf_accuracy_pct"))


def forest_statistics(forest: learning.ForestResult, n_classes: int = 4) -> DataFrame:
    """The forest's metrics as long rows (method, metric, value, unit)."""
    wide = forest_row(forest, n_classes)
    units = {"change_pct": "%", "changed_pixels": "px", "total_pixels": "px"}
    metrics = [c for c in wide.columns if c not in ("method", "threshold")]
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"), F.lit(units.get(c, "%")).alias("unit")) for c in metrics))
    return wide.select("method", F.explode(rows).alias("x")).select("method", "x.*")


@dataclass
class Improved:
    binary: learning.ForestResult
    smoothed: DataFrame
    comparison: DataFrame
    sweep: DataFrame


def improvement_pipeline(pair: DataFrame, shape: grid.Shape, ndvi: ChangeResult, labels: DataFrame | None = None, settings: learning.ForestSettings = learning.ForestSettings(), n_samples: int = 50_000, texture: bool = True, window: int = 5, cross_validate: bool = True) -> Improved:
    """Binary forest, majority filter and confidence sweep, each compared with the NDVI method."""
    forest = learning.binary_forest(pair, shape, labels, n_samples, settings, cross_validate, texture)
    mask = ndvi.pixels.select("r", "c", F.col("changed").alias("ndvi"))
    smooth = learning.smoothed(forest, shape, window)
    return Improved(forest, smooth, learning.majority_comparison(smooth.join(mask, ["r", "c"]), "ndvi"), consensus.confidence_sweep(forest.pixels.join(mask, ["r", "c"])))
