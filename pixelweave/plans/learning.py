"""Classification of pixels with Spark ML: forests, clusters, validation, ablation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import CODE_TO_BINARY, CODE_TO_CLASS, pseudo_label, recode
from ..functions.indices import FEATURES, TEXTURES, all_present, feature_columns
from ..operators import focal, grid
from ..operators.crosstab import jaccard, macro_f1, transitions
from ..operators.quantiles import percentile
from ..operators.sampling import balanced_binary, class_guard, order_key, spatial_block, stratified_pair
from ..operators.storage import stored
from .forests import bagged_forest, out_of_bag_accuracy

# The ablation's experiments and their features.
EXPERIMENTS = {
    "Baseline (all 10)": FEATURES,
    "No NDWI": tuple(f for f in FEATURES if f != "ndwi"),
    "No EVI": tuple(f for f in FEATURES if f != "evi"),
    "No SAVI": tuple(f for f in FEATURES if f != "savi"),
    "No BSI": tuple(f for f in FEATURES if f != "bsi"),
    "No NDVI": tuple(f for f in FEATURES if f != "ndvi"),
    "No Brightness": tuple(f for f in FEATURES if f != "brightness"),
    "Veg indices only": ("ndvi", "ndwi", "savi", "evi"),
    "Spectral bands only": ("b02", "b03", "b04", "b08"),
    "No moisture indices": tuple(f for f in FEATURES if f != "ndwi"),
}


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    depth: int = 20
    subset: str = "0.4"
    min_leaf: int = 5
    seed: int = 42
    #: Blocks of the image, by rows and columns, that cross-validation leaves out in turn.
    blocks: tuple[int, int] = (4, 4)
    #: Bags that a forest of the same settings is fitted on for its out-of-bag accuracy; 0 for none.
    bags: int = 0


@dataclass
class ForestResult:
    """Classified pixels (class_b, class_a, conf_b, conf_a, changed), the model, and figures of its training."""

    pixels: DataFrame
    model: PipelineModel
    accuracy: float
    cv_mean: float
    cv_std: float
    importances: list[tuple[str, float]] = field(default_factory=list)
    mode: str = "supervised"
    #: Out-of-bag accuracy, if bags were asked for.
    oob: float | None = None


def date_features(pair: DataFrame, date: str) -> DataFrame:
    """(r, c, ten features, present) of one date of a pair."""
    bands = pair.select("r", "c", *feature_columns(f"_{date}"))
    own = bands.select("r", "c", *(F.col(f"{f}_{date}").alias(f) for f in FEATURES))
    return own.withColumn("present", all_present(*(F.col(f) for f in FEATURES)))


def pair_features(pair: DataFrame) -> DataFrame:
    """(r, c, ten features and present of each date with suffixes _b and _a), one row a pixel."""
    both = pair.select("r", "c", *feature_columns("_b"), *feature_columns("_a"))
    return both.withColumns({f"present_{d}": all_present(*(F.col(f"{f}_{d}") for f in FEATURES)) for d in "ba"})


def _scaled(x: Column, top: float | None) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x, F.lit(top).cast("double")))), F.lit(0.0))


def with_texture(features: DataFrame, shape: grid.Shape, window: int = 5, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    """Adds homogeneity and contrast of the near infrared, scaled by its 99th percentile to 0..1.

    The dates that the suffixes name are taken in one pass.
    """
    tops = {s: percentile(features.filter(F.col(f"b08{s}") > 0), f"b08{s}", 0.99) for s in suffixes}
    cells = grid.dense(features, shape).withColumns({f"_x{s}": _scaled(F.col(f"b08{s}"), tops[s]) for s in suffixes})
    rest = tuple(c for c in features.columns if c not in ("r", "c"))
    out = focal.box_texture(cells, shape, {f"_x{s}": s for s in suffixes}, window, carry=rest).filter(F.col(f"present{suffixes[0]}").isNotNull())
    return out.withColumns({f"{t}{s}": F.when(F.col(f"present{s}"), F.col(f"{t}{s}")) for t in TEXTURES for s in suffixes})


def forest(features: tuple[str, ...], settings: ForestSettings = ForestSettings()) -> Pipeline:
    """Assembler, label indexer and forest; columns label and weight are expected."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
        RandomForestClassifier(
            featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=settings.trees, maxDepth=settings.depth, featureSubsetStrategy=settings.subset,
            minInstancesPerNode=settings.min_leaf, maxBins=256, seed=settings.seed,
        ),
    ])


def balanced(samples: DataFrame) -> DataFrame:
    """Adds weight = N / (classes x pixels of the class), from a small broadcast table."""
    counts = samples.groupBy("label").agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    out = samples.join(F.broadcast(counts), "label").crossJoin(F.broadcast(whole))
    return out.withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def classify(model: PipelineModel, features: DataFrame, suffix: str) -> DataFrame:
    """The features with class and confidence (of that suffix) of each pixel, in place; 0 where a feature is missing.

    features are those of one date, as columns of the suffix or, of a date alone, without it.
    """
    assembler, labels, trees = model.stages
    own = suffix if f"present{suffix}" in features.columns else ""
    names = assembler.getInputCols()
    filled = features.withColumns({f"_f{k}": F.coalesce(F.col(f"{n}{own}"), F.lit(0.0)) for k, n in enumerate(names)})
    out = trees.transform(VectorAssembler(inputCols=[f"_f{k}" for k in range(len(names))], outputCol="features").transform(filled))
    klass = F.element_at(F.array(*(F.lit(int(n)) for n in labels.labels)), F.col("prediction").cast("int") + 1)
    present = F.coalesce(F.col(f"present{own}"), F.lit(False))
    made = {f"class{suffix}": F.when(present, klass).otherwise(0), f"conf{suffix}": F.when(present, F.array_max(vector_to_array("probability"))).otherwise(0.0)}
    return out.withColumns(made).select(*features.columns, *made)


def classify_pair(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(r, c, class_b, class_a, conf_b, conf_a, valid, changed) of pair_features: two transforms of the same row."""
    both = classify(model, classify(model, features, "_b"), "_a").select("r", "c", "class_b", "conf_b", "class_a", "conf_a")
    valid = (F.col("class_b") > 0) & (F.col("class_a") > 0)
    return both.withColumns({"valid": valid, "changed": valid & (F.col("class_b") != F.col("class_a"))})


def predicted(model: PipelineModel, samples: DataFrame) -> DataFrame:
    names = model.stages[1].labels
    return model.transform(samples).select("label", F.element_at(F.array(*(F.lit(int(n)) for n in names)), F.col("prediction").cast("int") + 1).alias("predicted"))


#: Fits of cross-validation that run at a time.
FITS_AT_ONCE = 8


def _validated(samples: DataFrame, features: tuple[str, ...], trials: list[ForestSettings]) -> list[list[float]]:
    """Macro-F1 of each fold, in order, for each of the settings: all fits share one pool."""
    labels: dict[int, set] = {}
    for fold, label in samples.select("fold", "label").distinct().collect():
        labels.setdefault(fold, set()).add(label)
    folds = [f for f in sorted(labels) if len(set().union(*(x for g, x in labels.items() if g != f))) >= 2]

    def score(job: tuple[ForestSettings, int]) -> float:
        settings, fold = job
        model = forest(features, settings).fit(balanced(samples.filter(F.col("fold") != fold)))
        outside = samples.filter(F.col("fold") == fold).withColumn("weight", F.lit(1.0))
        return macro_f1(predicted(model, outside), "label", "predicted").first()["macro_f1"]

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        scores = iter(list(pool.map(score, [(t, f) for t in trials for f in folds])))
    return [[next(scores) for _ in folds] for _ in trials]


def spatial_cv(samples: DataFrame, features: tuple[str, ...], settings: ForestSettings) -> tuple[float, float, list[float]]:
    """Mean and population deviation of macro-F1 over folds that each leave one block out.

    samples has fold. Folds whose training part has fewer than two classes are
    skipped; without folds the result is 0, 0. The fits run several at a time.
    """
    scores = _validated(samples, features, [settings])[0]
    mean, deviation = _mean_and_deviation(scores)
    return mean, deviation, scores


def _mean_and_deviation(scores: list[float]) -> tuple[float, float]:
    if not scores:
        return 0.0, 0.0
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def holdout(samples: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test part: of each class the share, rounded, that comes first in a fixed random order.

    The samples are at most as many as were asked for, so a class of them is put in order by one task.
    """
    own = Window.partitionBy("label")
    ranked = samples.withColumn("_rank", F.row_number().over(own.orderBy(order_key(seed + 1, F.concat_ws(":", "pixel_id", "date")), "pixel_id", "date")))
    parted = ranked.withColumn("_test", F.col("_rank") <= F.round(F.count("*").over(own) * share))
    return tuple(parted.filter(F.col("_test") == test).drop("_rank", "_test") for test in (False, True))


def train(samples: DataFrame, features: tuple[str, ...], settings: ForestSettings, cross_validate: bool = True) -> tuple[PipelineModel, float, tuple[float, float]]:
    """The model, its hold-out accuracy and cross-validated macro-F1.

    With cross-validation the model is fitted on all samples at last, else on the training part.
    """
    inside, outside = holdout(samples)
    model = forest(features, settings).fit(balanced(inside))
    accuracy = predicted(model, outside.withColumn("weight", F.lit(1.0))).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] or 0.0
    cv = (0.0, 0.0)
    if cross_validate:
        cv = spatial_cv(samples, features, settings)[:2]
        model = forest(features, settings).fit(balanced(samples))
    return model, accuracy, cv


def grid_search(samples: DataFrame, features: tuple[str, ...], settings: ForestSettings, subsets: tuple[str, ...] = ("sqrt", "0.3", "0.4"), leaves: tuple[int, ...] = (3, 5, 10)) -> ForestSettings:
    """The feature share and leaf size of the best mean macro-F1; the first wins."""
    trials = [replace(settings, subset=subset, min_leaf=leaf) for subset in subsets for leaf in leaves]
    means = [_mean_and_deviation(scores)[0] for scores in _validated(samples, features, trials)]
    return trials[means.index(max(means))] if trials else settings


def importances(model: PipelineModel, features: tuple[str, ...]) -> list[tuple[str, float]]:
    """Features by importance, the largest first."""
    return sorted(zip(features, model.stages[2].featureImportances.toArray().tolist()), key=lambda x: -x[1])


def top_features(figures: DataFrame, n: int = 5, by: str = "pair") -> DataFrame:
    """(by, rank, feature, importance): the n most important features of each row's importances (a map); ties by name."""
    rows = figures.select(by, F.explode("importances").alias("feature", "importance"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "feature"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(by, "rank", "feature", "importance")


def cluster_labels(features: DataFrame, k: int = 4, sample: int = 50_000, starts: int = 10, seed: int = 42) -> DataFrame:
    """Pseudo-labels 1..k of pixels by k-means on z-scores, the best of several starts; they name no land cover."""
    scaled = grid.scene_zscore(features.filter("present"), *FEATURES)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(scaled)
    keyed = assembled.orderBy(order_key(seed, F.concat_ws(":", "r", "c"))).limit(sample).cache()
    fits = [KMeans(k=k, maxIter=300, seed=seed + s, featuresCol="v", predictionCol="cluster").fit(keyed) for s in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    keyed.unpersist()
    return best.transform(assembled).select("r", "c", (F.col("cluster") + 1).alias("label"))


def _samples(chosen: DataFrame, shape: grid.Shape, features: DataFrame, names: tuple[str, ...], blocks: tuple[int, int]) -> DataFrame:
    """Features of chosen pixels (r, c, label, date) on their own date, with folds."""
    both = features.join(chosen, ["r", "c"])
    before = F.col("date") == "before"
    own = both.filter(F.when(before, F.col("present_b")).otherwise(F.col("present_a")))
    own = own.select("r", "c", "label", "date", *(F.when(before, F.col(f"{n}_b")).otherwise(F.col(f"{n}_a")).alias(n) for n in names))
    return own.withColumn("fold", spatial_block(shape, *blocks)).withColumn("pixel_id", F.col("r").cast("long") * shape.width + F.col("c"))


def usable_labels(features: DataFrame, labels: DataFrame, codes: dict[int, int], shape: grid.Shape) -> DataFrame:
    """(r, c, label, pixel_id) of the pixels that both dates have and that have a label."""
    usable = features.filter("present_b and present_a").select("r", "c").join(labels.select("r", "c", recode(F.col("wc"), codes).alias("label")), ["r", "c"])
    return usable.filter("label > 0").select("r", "c", "label", (F.col("r").cast("long") * shape.width + F.col("c")).alias("pixel_id"))


def supervised_samples(both: DataFrame, labels: DataFrame, shape: grid.Shape, n_samples: int, settings: ForestSettings) -> DataFrame:
    """Samples of four classes from pair_features and land-cover labels (r, c, wc); classes of few pixels are merged."""
    usable = usable_labels(both, labels, CODE_TO_CLASS, shape)
    guard = class_guard(usable, "label", [1, 2, 3, 4]).collect()
    active = sorted(r["class"] for r in guard if r.n >= 100)
    if not active:
        raise ValueError("no class has enough labelled pixels")
    usable = usable.withColumn("label", recode(F.col("label"), {r["class"]: r.target for r in guard}))
    chosen = stratified_pair(usable, "label", active, max(1, n_samples // len(active) // 2), settings.seed)
    return stored(_samples(chosen.select("r", "c", "label", "date"), shape, both, FEATURES, settings.blocks))


def _fitted(both: DataFrame, samples: DataFrame, features: tuple[str, ...], settings: ForestSettings, cross_validate: bool, mode: str) -> ForestResult:
    """The forest of the samples, its figures, and the pair's pixels classified by it."""
    model, accuracy, cv = train(samples, features, settings, cross_validate)
    oob = None
    if settings.bags:
        weighed = stored(balanced(samples))
        oob = out_of_bag_accuracy(bagged_forest(weighed, features, settings, settings.bags), weighed, settings.bags, settings.seed)
    return ForestResult(classify_pair(model, both), model, accuracy, *cv, importances(model, features), mode, oob)


def random_forest(pair: DataFrame, shape: grid.Shape, labels: DataFrame | None = None, n_samples: int = 50_000, settings: ForestSettings = ForestSettings(), cross_validate: bool = True, features: tuple[str, ...] = FEATURES) -> ForestResult:
    """Post-classification change of four classes, from land-cover labels (r, c, wc) or from clusters.

    Both dates stay on one row from the features to the classes.
    """
    both = pair_features(pair)
    if labels is not None:
        return _fitted(both, supervised_samples(both, labels, shape, n_samples, settings), features, settings, cross_validate, "supervised")
    clusters = cluster_labels(date_features(pair, "b"), seed=settings.seed)
    keyed = clusters.withColumn("pixel_id", F.col("r").cast("long") * shape.width + F.col("c")).withColumn("date", F.lit("before"))
    chosen = keyed.orderBy(order_key(settings.seed, F.col("pixel_id"))).limit(min(5000, n_samples))
    samples = stored(_samples(chosen.select("r", "c", "label", "date"), shape, both, FEATURES, settings.blocks))
    return _fitted(both, samples, features, settings, cross_validate, "unsupervised")


def binary_forest(pair: DataFrame, shape: grid.Shape, labels: DataFrame | None = None, n_samples: int = 50_000, settings: ForestSettings = ForestSettings(), cross_validate: bool = True, texture: bool = False) -> ForestResult:
    """Vegetated or not on both dates; loss is 1 to 2, gain 2 to 1. Without labels NDVI of the first date stands in."""
    both = pair_features(pair)
    names = FEATURES + TEXTURES if texture else FEATURES
    if texture:
        both = stored(with_texture(both, shape, suffixes=("_b", "_a")))
    if labels is not None:
        usable = usable_labels(both, labels, CODE_TO_BINARY, shape)
        mode = "supervised_binary"
    else:
        pixel = (F.col("r").cast("long") * shape.width + F.col("c")).alias("pixel_id")
        usable = both.filter("present_b").select("r", "c", pseudo_label(F.col("ndvi_b")).alias("label"), pixel)
        mode = "ndvi_threshold_binary"
    chosen = balanced_binary(usable.filter("label > 0"), "label", n_samples, settings.seed)
    if labels is None:
        chosen = chosen.withColumn("date", F.lit("before"))
    samples = stored(_samples(chosen.select("r", "c", "label", "date"), shape, both, names, settings.blocks))
    result = _fitted(both, samples, names, settings, cross_validate, mode)
    pixels = result.pixels.withColumns({"loss": (F.col("class_b") == 1) & (F.col("class_a") == 2), "gain": (F.col("class_b") == 2) & (F.col("class_a") == 1)})
    return replace(result, pixels=pixels)


def smoothed(result: ForestResult, shape: grid.Shape, window: int = 5, classes: list[int] | None = None) -> DataFrame:
    """The classified pixels with both maps majority-filtered and change taken anew (changed_before is the old mask)."""
    cells = grid.dense(result.pixels.select("r", "c", "class_b", "class_a", "valid", "changed"), shape)
    maps = focal.majority(cells, shape, ["class_b", "class_a"], classes or [1, 2], F.col("valid"), window)
    out = maps.join(cells.select("r", "c", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("changed", F.lit(False)).alias("changed_before")), ["r", "c"])
    return out.withColumn("changed", F.col("valid") & (F.col("class_b") > 0) & (F.col("class_a") > 0) & (F.col("class_b") != F.col("class_a")))


def majority_comparison(pixels: DataFrame, ndvi_mask: str | None = None) -> DataFrame:
    """One row: change before and after smoothing, the reduction, and Jaccard with the NDVI mask if given."""
    ok = F.col("valid")
    share = lambda m: F.try_divide(F.count_if(ok & m) * F.lit(100.0), F.count_if(ok))
    old, new = F.col("changed_before"), F.col("changed")
    more = [jaccard(ok & old, ok & F.col(ndvi_mask)).alias("jaccard_original"), jaccard(ok & new, ok & F.col(ndvi_mask)).alias("jaccard_smoothed")] if ndvi_mask else []
    return pixels.agg(F.count_if(ok).alias("total_pixels"), share(old).alias("change_pct_original"), share(new).alias("change_pct_smoothed"), (share(old) - share(new)).alias("reduction_pp"), *more)


def forest_report(result: ForestResult, n_classes: int = 4, least_confidence: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """Transition tables of all pixels and of those that are confident on both dates."""
    sure = (F.col("conf_b") >= least_confidence) & (F.col("conf_a") >= least_confidence)
    return transitions(result.pixels, "class_b", "class_a", n_classes), transitions(result.pixels, "class_b", "class_a", n_classes, sure)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def distinct_experiments(experiments: DataFrame) -> DataFrame:
    """Of (ordinal, name, features) the first of each set of features."""
    key = F.array_sort("features")
    first = experiments.groupBy(key.alias("_key")).agg(F.min_by(F.struct("ordinal", "name", "features"), "ordinal").alias("x"))
    return first.select("x.*")


def verdicts(figures: DataFrame, baseline: str = "Baseline (all 10)") -> DataFrame:
    """Differences of (name, f1, jaccard, change_pct) to the baseline's row and what they mean."""
    base = figures.filter(F.col("name") == baseline).select(F.col("f1").alias("_f1"), F.col("jaccard").alias("_j"), F.col("change_pct").alias("_c"))
    out = figures.crossJoin(F.broadcast(base)).withColumns({"delta_f1": F.col("f1") - F.col("_f1"), "delta_jaccard": F.col("jaccard") - F.col("_j"), "delta_change": F.col("change_pct") - F.col("_c")})
    # The verdicts' wording and borders.
    said = F.when(F.col("name") == baseline, "BASELINE").when((F.col("delta_f1") > 0.02) | (F.col("delta_jaccard") > 0.05), "BETTER (removing helps)").when(F.col("delta_f1") < -0.02, "WORSE (removing hurts)").otherwise("NEUTRAL (±noise)")
    return out.withColumn("verdict", said).drop("_f1", "_j", "_c")


def ablation(pair: DataFrame, shape: grid.Shape, ndvi_pixels: DataFrame, labels: DataFrame, settings: ForestSettings = ForestSettings(), experiments: dict[str, tuple[str, ...]] = EXPERIMENTS, n_samples: int = 50_000) -> DataFrame:
    """A forest for each distinct set of features, on the same samples, and the verdicts."""
    spark = pair.sparkSession
    listed = spark.createDataFrame([(k, n, list(f)) for k, (n, f) in enumerate(experiments.items())], "ordinal int, name string, features array<string>")
    rows, features = [], stored(pair_features(pair))
    samples = supervised_samples(features, labels, shape, n_samples, settings)
    for e in distinct_experiments(listed).orderBy("ordinal").collect():
        r = _fitted(features, samples, tuple(e["features"]), settings, True, "supervised")
        both = r.pixels.filter("valid").join(ndvi_pixels.select("r", "c", F.col("changed").alias("ndvi")), ["r", "c"])
        j, pct = both.agg(jaccard(F.col("changed"), F.col("ndvi")), F.coalesce(F.avg(F.col("changed").cast("double")) * 100, F.lit(0.0))).first()
        rows.append((e["ordinal"], e["name"], len(e["features"]), r.cv_mean, r.cv_std, r.accuracy, pct, j))
    return verdicts(spark.createDataFrame(rows, "ordinal int, name string, n_features int, f1 double, f1_std double, accuracy double, change_pct double, jaccard double"))


def seasonal_comparison(pairs: dict[str, tuple[DataFrame, grid.Shape, DataFrame | None]], settings: ForestSettings = ForestSettings(), n_samples: int = 50_000) -> DataFrame:
    """NDVI and forest change of several pairs, their ratio and agreement, one row for each pair."""
    from .methods import ndvi_differencing

    spark = next(iter(pairs.values()))[0].sparkSession
    rows = []
    for name, (pair, shape, labels) in pairs.items():
        by_ndvi = ndvi_differencing(pair, shape)
        r = random_forest(pair, shape, labels, n_samples, settings)
        both = r.pixels.filter("valid").join(by_ndvi.pixels.select("r", "c", F.col("changed").alias("ndvi")), ["r", "c"])
        j, pct = both.agg(jaccard(F.col("changed"), F.col("ndvi")), F.coalesce(F.avg(F.col("changed").cast("double")) * 100, F.lit(0.0))).first()
        ndvi_pct = by_ndvi.summary.first()["change_pct"]
        rows.append((name, ndvi_pct, pct, pct / ndvi_pct if ndvi_pct else None, r.cv_mean, r.cv_std, r.accuracy, j, dict(r.importances)))
    return spark.createDataFrame(rows, "pair string, ndvi_change_pct double, rf_change_pct double, rf_ndvi_ratio double, f1 double, f1_std double, accuracy double, jaccard double, importances map<string,double>")


def importance_shift(comparison: DataFrame, first: str, second: str, feature: str = "ndwi") -> DataFrame:
    """Importances of two pairs side by side, by the first's, and what the shift of one feature says."""
    side = lambda name, out: comparison.filter(F.col("pair") == name).select(F.explode("importances").alias("feature", out))
    out = side(first, "first").join(side(second, "second"), "feature").withColumn("delta", F.col("second") - F.col("first"))
    said = F.when(F.col("delta") < -0.03, "CONFIRMED").when(F.abs("delta") < 0.03, "INCONCLUSIVE").otherwise("UNEXPECTED")
    return out.withColumn("finding", F.when(F.col("feature") == feature, said)).orderBy(F.desc("first"))
