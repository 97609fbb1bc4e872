"""Forests as tables of nodes, applied by native expressions; bags of pixels and out-of-bag votes."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import scratch, stored

#: A row a node: where the feature is at most split a pixel goes left, else right; at a leaf both are the node itself. shares are those of the classes.
NODES = "bag int, tree int, node int, feature int, split double, left int, right int, shares array<double>"
_TREE = "bag int, feature array<int>, split array<double>, left array<int>, right array<int>, shares array<array<double>>"
#: Bags whose trees are fitted at a time.
FITS_AT_ONCE = 8
#: A pixel is in a bag so many times at most (as good as surely: the next has a chance of 1e-8).
MOST_DRAWS = 10


@dataclass(frozen=True)
class Forest:
    """nodes (see NODES), the features that node rows number from 0, and the classes that shares are of."""

    nodes: DataFrame
    features: tuple[str, ...]
    classes: tuple[int, ...]


def _nodes_of(model: RandomForestClassificationModel, n_classes: int, bag: int = 0) -> DataFrame:
    """The trees of a model as rows, read from what it saves of itself."""
    spark = SparkSession.active()
    path = scratch(spark)
    model.write().save(path)
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    whole = F.aggregate(n["impurityStats"], F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.get(n["impurityStats"], k) / whole, F.lit(0.0)))
    return spark.read.parquet(f"{path}/data").select(
        F.lit(bag).alias("bag"), F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(leaf, 0).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(leaf, 0.0).otherwise(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("split"),
        F.when(leaf, n["id"]).otherwise(n["leftChild"]).alias("left"), F.when(leaf, n["id"]).otherwise(n["rightChild"]).alias("right"), shares.alias("shares"),
    )


def forest_table(model: PipelineModel) -> Forest:
    """The forest of a fitted pipeline (assembler, label indexer, forest) as a table of nodes."""
    assembler, labels, trees = model.stages
    return Forest(_nodes_of(trees, len(labels.labels)), tuple(assembler.getInputCols()), tuple(int(x) for x in labels.labels))


def save_forest(forest: Forest, path: str) -> None:
    """Nodes as Parquet, with the names of features and classes as columns of each row."""
    named = forest.nodes.withColumns({"features": F.array(*map(F.lit, forest.features)), "classes": F.array(*map(F.lit, forest.classes))})
    named.write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> Forest:
    rows = spark.read.parquet(path)
    first = rows.first()
    return Forest(rows.drop("features", "classes"), tuple(first["features"]), tuple(first["classes"]))


def _literal(nodes: DataFrame) -> tuple[Column, int]:
    """All trees as one constant, and their depth.

    A forest is as large as its settings let it be, whatever the number of pixels: it
    goes through the driver as a model does.
    """
    trees: dict[tuple[int, int], list] = {}
    for row in nodes.toLocalIterator():
        trees.setdefault((row.bag, row.tree), []).append(row)
    made, depth = [], 0
    for (bag, _), rows in sorted(trees.items()):
        rows.sort(key=lambda r: r.node)
        place = {r.node: k for k, r in enumerate(rows)}
        left, right = ([place[getattr(r, side)] for r in rows] for side in ("left", "right"))
        level, deep = {0: 0}, [0]
        while deep:
            at = deep.pop()
            for child in {left[at], right[at]} - {at}:
                level[child] = level[at] + 1
                deep.append(child)
        depth = max(depth, *level.values())
        made.append({"bag": bag, "feature": [r.feature for r in rows], "split": [r.split for r in rows], "left": left, "right": right, "shares": [list(r.shares) for r in rows]})
    return F.from_json(F.lit(json.dumps(made)), f"array<struct<{_TREE}>>"), depth


def votes(forest: Forest, features: list[Column], bags: Column | None = None) -> Column:
    """Sum of the trees' class shares for the features of a row, in the order of the classes.

    With bags, an array of a weight for each bag, only trees vote whose bag has the
    weight 0. Each tree is walked by a fold over its levels: no Python, and the plan
    is of one size whatever the forest's.
    """
    trees, depth = _literal(forest.nodes)
    x = F.array(*(f.cast("double") for f in features))

    def leaf(tree: Column) -> Column:
        step = lambda at, _: F.when(F.get(x, F.get(tree["feature"], at)) <= F.get(tree["split"], at), F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)

    def add(sums: Column, tree: Column) -> Column:
        more = F.zip_with(sums, F.get(tree["shares"], leaf(tree)), lambda a, b: a + b)
        return more if bags is None else F.when(F.get(bags, tree["bag"]) == 0, more).otherwise(sums)

    return F.aggregate(trees, F.array(*[F.lit(0.0)] * len(forest.classes)), add)


def winner(forest: Forest, summed: Column) -> Column:
    """The class of most votes, of equal ones the first; NULL without votes."""
    at = F.array_position(summed, F.array_max(summed)).cast("int") - 1
    return F.when(F.array_max(summed) > 0, F.get(F.array(*map(F.lit, forest.classes)), at))


def apply_forest(forest: Forest, pixels: DataFrame, suffix: str = "", present: Column | None = None) -> DataFrame:
    """The pixels with class and confidence (of that suffix); 0 where a feature is missing or present is not true.

    A stored forest needs no model class: nodes, features and classes are all there is.
    """
    own = [F.col(f"{f}{suffix}") for f in forest.features]
    whole = present if present is not None else F.lit(True)
    for c in own:
        whole = whole & c.isNotNull()
    summed = pixels.withColumn("_votes", votes(forest, own))
    share = F.try_divide(F.array_max("_votes"), F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b))
    made = {f"class{suffix}": F.when(whole, F.coalesce(winner(forest, F.col("_votes")), F.lit(0))).otherwise(0), f"conf{suffix}": F.when(whole, F.coalesce(share, F.lit(0.0))).otherwise(0.0)}
    return summed.withColumns(made).drop("_votes")


def draw_limits() -> list[float]:
    """Chances of at most 0, 1, 2, ... draws of a pixel for a bag of as many draws as pixels."""
    out, term = [], math.exp(-1)
    for k in range(MOST_DRAWS):
        out.append((out[-1] if out else 0.0) + term)
        term /= k + 1
    return out


def draws(bag: int, pixel: Column, seed: int = 42) -> Column:
    """How often a bag has a pixel: Poisson(1), by md5 of seed, bag and pixel, so the same wherever it is asked for."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{bag}:"), pixel.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    out = F.lit(0)
    for limit in draw_limits():
        out = out + (u >= limit).cast("int")
    return out


def bagged_forest(samples: DataFrame, features: tuple[str, ...], settings, bags: int, pixel: Column | None = None) -> Forest:
    """A forest whose trees are fitted on bags that can be told again: settings.trees in all, shared out to the bags.

    samples: label, features and weight; pixel tells rows apart. A bag is a weight, not
    a copy of rows; bags are fitted several at a time.
    """
    pixel = F.concat_ws(":", "pixel_id", "date") if pixel is None else pixel
    classes = sorted(r[0] for r in samples.select("label").distinct().collect())
    indexer = StringIndexerModel.from_labels([str(c) for c in classes], inputCol="label", outputCol="label_index")
    rows = stored(VectorAssembler(inputCols=list(features), outputCol="features").transform(indexer.transform(samples.withColumn("_pixel", pixel))).select("features", "label_index", "weight", "_pixel"))
    each = [settings.trees // bags + (b < settings.trees % bags) for b in range(bags)]

    def fit(bag: int) -> DataFrame:
        own = rows.withColumn("weight", F.col("weight") * draws(bag, F.col("_pixel"), settings.seed)).filter("weight > 0")
        trees = RandomForestClassifier(
            featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=each[bag], maxDepth=settings.depth, featureSubsetStrategy=settings.subset,
            minInstancesPerNode=settings.min_leaf, maxBins=256, seed=settings.seed + bag, bootstrap=False,
        )
        # the indexer names all classes, so a bag that lacks one has shares for it
        return _nodes_of(trees.fit(own), len(classes), bag)

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(fit, [b for b in range(bags) if each[b]]))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return Forest(stored(nodes), features, tuple(classes))


def out_of_bag(forest: Forest, samples: DataFrame, bags: int, seed: int = 42, pixel: Column | None = None) -> DataFrame:
    """The samples with oob_votes (by class), n_out (bags without them) and oob_class, by the trees of bags that left them out.

    oob_class is NULL where every bag has the pixel.
    """
    pixel = F.concat_ws(":", "pixel_id", "date") if pixel is None else pixel
    drawn = F.array(*(draws(b, pixel, seed) for b in range(bags)))
    rows = samples.withColumn("_draws", drawn)
    rows = rows.withColumn("oob_votes", votes(forest, [F.col(f) for f in forest.features], F.col("_draws")))
    out = F.size(F.filter("_draws", lambda w: w == 0))
    return rows.withColumns({"n_out": out, "oob_class": winner(forest, F.col("oob_votes"))}).drop("_draws")


def out_of_bag_accuracy(forest: Forest, samples: DataFrame, bags: int, seed: int = 42) -> float:
    """Share of the samples, among those that a bag left out, whose class the left-out trees find."""
    judged = out_of_bag(forest, samples, bags, seed).filter("oob_class is not null")
    return judged.agg(F.avg((F.col("label") == F.col("oob_class")).cast("double"))).first()[0] or 0.0
