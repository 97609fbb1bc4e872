"""Agreement of methods: weighted consensus, credible transitions, confidence sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.change import SEVERITIES, severity
from ..operators.crosstab import jaccard
from ..operators.quantiles import percentile

LIKELY, CONFIRMED = 0.35, 0.55
METHODS = ("ndvi", "rf", "cva", "bd")


@dataclass(frozen=True)
class Weights:
    """Weights of the methods, brought to a sum of 1; an unsupervised forest counts half."""

    ndvi: float = 0.45
    rf: float = 0.30
    cva: float = 0.20
    bd: float = 0.05

    def shares(self, supervised: bool) -> dict[str, float]:
        own = {"ndvi": self.ndvi, "rf": self.rf if supervised else self.rf / 2, "cva": self.cva, "bd": self.bd}
        whole = sum(own.values())
        return {k: v / whole for k, v in own.items()}


def confidence_scale(before: Column, after: Column, least: float = 0.60) -> Column:
    """0 at the least confidence of both dates, 1 at certainty."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(before, after) - least) / (1 - least)))


def consensus(pixels: DataFrame, weights: Weights = Weights(), supervised: bool = True, least_confidence: float = 0.60) -> DataFrame:
    """Adds agreement (methods that see change), score and consensus_class (1 likely, 2 confirmed).

    pixels: delta, valid and the masks ndvi, rf, cva, bd; conf_b and conf_a weigh the
    forest and magnitude the change vectors where present. Scores of pixels that are
    not valid are 0. The 95th percentile of positive magnitudes is found first, exactly.
    """
    share = weights.shares(supervised)
    ok = F.col("delta").isNotNull() & F.coalesce("valid", F.lit(False))
    vote = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in METHODS}
    agreement = sum((F.coalesce(F.col(m).cast("int"), F.lit(0)) for m in METHODS[1:]), F.coalesce(F.col("ndvi").cast("int"), F.lit(0)))
    if {"conf_b", "conf_a"} <= set(pixels.columns):
        vote["rf"] = vote["rf"] * F.coalesce(confidence_scale(F.col("conf_b"), F.col("conf_a"), least_confidence), F.lit(0.0))
    if "magnitude" in pixels.columns:
        top = F.lit(percentile(pixels.filter("magnitude > 0"), "magnitude", 0.95)).cast("double")
        scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.coalesce("magnitude", F.lit(0.0)), top)))
        vote["cva"] = vote["cva"] * (0.5 + 0.5 * F.coalesce(scaled, F.lit(0.0)))
    score = sum((share[m] * vote[m] for m in METHODS[1:]), share["ndvi"] * vote["ndvi"])
    out = pixels.withColumn("agreement", F.when(ok, agreement).otherwise(0)).withColumn("score", F.when(ok, F.round(score, 6)).otherwise(0.0)).withColumn("_ok", ok)
    return out.withColumn("consensus_class", F.when(F.col("score") >= CONFIRMED, 2).when(F.col("score") >= LIKELY, 1).otherwise(0)).withColumn("valid", F.col("_ok")).drop("_ok")


def consensus_summary(scored: DataFrame) -> DataFrame:
    """Shares of likely and confirmed change among valid pixels and the six Jaccard likenesses."""
    ok = F.col("valid")
    share = lambda n: F.coalesce(F.try_divide(n * F.lit(100.0), F.count_if(ok)), F.lit(0.0))
    mask = {m: F.coalesce(F.col(m), F.lit(False)) & ok for m in METHODS}
    pairs = [(a, b) for i, a in enumerate(METHODS) for b in METHODS[i + 1 :]]
    return scored.agg(
        F.count_if(ok).alias("valid_pixels"), share(F.count_if(ok & (F.col("consensus_class") >= 1))).alias("change_pct_any"), share(F.count_if(ok & (F.col("consensus_class") == 2))).alias("change_pct_confirmed"),
        *(jaccard(mask[a], mask[b]).alias(f"jaccard_{a}_{b}") for a, b in pairs),
    )


def credible_transitions(matrix: DataFrame, ndvi_pct: Column, rf_pct: Column, totals: DataFrame) -> DataFrame:
    """Transition shares scaled to the NDVI method's change, without implausible cells.

    matrix: class_before, class_after, row_pct; totals: one row that the two columns
    are taken from. Off-diagonal cells are scaled, the diagonal takes the rest of
    100; bare soil to vegetation over 15, water to others over 30 and others to water
    over 10 are set to 0 and rows brought to 100 again.
    """
    n = F.max("class_before").over(Window.partitionBy(F.lit(0)))
    scale = F.when(rf_pct > 0, ndvi_pct / rf_pct).otherwise(1.0)
    cells = matrix.crossJoin(F.broadcast(totals.select(scale.alias("scale_factor"))))
    off = F.col("class_before") != F.col("class_after")
    row = Window.partitionBy("class_before")
    cells = cells.withColumn("n", n).withColumn("_off", F.when(off, F.col("row_pct") * F.col("scale_factor")).otherwise(0.0))
    cells = cells.withColumn("scaled_pct", F.when(off, F.col("_off")).otherwise(F.greatest(F.lit(0.0), 100 - F.sum("_off").over(row))))
    b, a, x = F.col("class_before"), F.col("class_after"), F.col("scaled_pct")
    suspect = ((b == 2) & (a == 1) & (x > 15)) | ((F.col("n") >= 3) & off & (((b == 3) & (x > 30)) | ((a == 3) & (x > 10))))
    cells = cells.withColumn("suspect", suspect).withColumn("_kept", F.when(suspect, 0.0).otherwise(x))
    total = F.sum("_kept").over(row)
    return cells.select("class_before", "class_after", "row_pct", "scale_factor", "scaled_pct", "suspect", F.when(total > 0, F.col("_kept") / total * 100).otherwise(F.col("_kept")).alias("credible_pct"))


def ndvi_severity(pixels: DataFrame) -> DataFrame:
    """Pixels and share (of all pixels) of each of eight states, from delta, ndvi_b, ndvi_a, loss, gain and valid."""
    spark = pixels.sparkSession
    state = severity(F.col("delta"), F.col("ndvi_b"), F.col("ndvi_a"), F.col("loss"), F.col("gain"), F.col("valid"))
    counts = pixels.groupBy(state.cast("int").alias("severity")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(SEVERITIES.items()), "severity int, label string")
    full = names.join(counts, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select("severity", "label", "n", F.coalesce(F.try_divide(F.col("n") * F.lit(100.0), F.col("total")), F.lit(0.0)).alias("pct"))


def confidence_sweep(pixels: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Coverage, change and Jaccard with the NDVI mask among pixels confident on both dates, by threshold.

    pixels: conf_b, conf_a, changed, ndvi, valid. Thresholds that no pixel reaches
    have no row; best marks the first of the highest Jaccard.
    """
    taus = thresholds or [round(0.50 + 0.05 * k, 2) for k in range(9)]
    both = F.least("conf_b", "conf_a")
    sure = [(both >= t) & F.col("valid") for t in taus]
    changed, ndvi = F.coalesce("changed", F.lit(False)), F.coalesce("ndvi", F.lit(False))
    one = pixels.agg(F.count_if("valid").alias("valid"), *(x for k, s in enumerate(sure) for x in (F.count_if(s).alias(f"n{k}"), F.count_if(s & changed).alias(f"c{k}"), jaccard(s & changed, s & ndvi).alias(f"j{k}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(t).alias("threshold"), F.col(f"n{k}").alias("n"), F.col(f"c{k}").alias("c"), F.col(f"j{k}").alias("jaccard")) for k, t in enumerate(taus))))
    rows = one.select("valid", rows.alias("x")).select("valid", "x.*").filter("n > 0")
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("jaccard"), "ordinal")) == 1
    return rows.select("threshold", (F.col("n") * F.lit(100.0) / F.col("valid")).alias("coverage_pct"), (F.col("c") * F.lit(100.0) / F.col("n")).alias("change_pct"), "jaccard", (best & (F.col("jaccard") > 0)).alias("best"))
