"""Forests as tables, out-of-bag votes, parallel validation."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pixelweave.plans import forests, learning

SMALL = learning.ForestSettings(trees=7, depth=5, min_leaf=2)


@pytest.fixture(scope="module")
def samples(spark):
    """Three classes over two features, with some noise, in six blocks."""
    rows = spark.range(900).select(F.col("id").alias("pixel_id"), F.lit("before").alias("date"), (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), (F.col("id") % 6).cast("int").alias("fold"))
    label = F.when(F.col("a") + F.rand(3) > 7, 1).when(F.col("b") + F.rand(4) * 2 > 5, 3).otherwise(4)
    rows = rows.withColumn("label", label).cache()
    rows.count()
    return rows


def test_a_table_of_nodes_gives_what_the_model_gives(spark, samples, tmp_path):
    model = learning.forest(("a", "b"), SMALL).fit(learning.balanced(samples))
    table = forests.forest_table(model)
    assert table.classes == (1, 3, 4) and table.features == ("a", "b")
    assert table.nodes.select("tree").distinct().count() == 7
    forests.save_forest(table, str(tmp_path / "forest"))
    stored = forests.load_forest(spark, str(tmp_path / "forest"))
    rows = samples.withColumn("weight", F.lit(1.0))
    want = {r.pixel_id: (table.classes[int(r.prediction)], max(r.p)) for r in model.transform(rows).withColumn("p", vector_to_array("probability")).collect()}
    plan = forests.apply_forest(stored, samples)
    got = {r.pixel_id: (r["class"], r.conf) for r in plan.collect()}
    assert len(got) == 900 and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9) for k in want)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "UDF" not in text


def test_missing_features_and_empty_tables(spark, samples):
    table = forests.forest_table(learning.forest(("a", "b"), SMALL).fit(learning.balanced(samples)))
    odd = spark.createDataFrame([(1.0, None, True), (1.0, 2.0, False), (1.0, 2.0, None), (9.0, 2.0, True)], "a double, b double, ok boolean")
    got = [(r["class"], r.conf) for r in forests.apply_forest(table, odd, present=F.col("ok")).collect()]
    assert got[:3] == [(0, 0.0)] * 3 and got[3][0] == 1 and got[3][1] > 0.5
    assert forests.apply_forest(table, odd.limit(0)).count() == 0
    stump = forests.Forest(spark.createDataFrame([(0, 0, 5, 0, 0.0, 5, 5, [0.25, 0.75])], forests.NODES), ("a",), (2, 7))
    assert {(r["class"], r.conf) for r in forests.apply_forest(stump, odd).collect()} == {(7, 0.75)}


def test_draws_are_those_of_a_bag(spark):
    rows = spark.range(20_000).select(*(forests.draws(b, F.col("id")).alias(f"d{b}") for b in range(2)))
    none, mean, spread, same = rows.agg(F.avg((F.col("d0") == 0).cast("double")), F.avg("d0"), F.var_pop("d0"), F.corr("d0", "d1")).first()
    assert abs(none - math.exp(-1)) < 0.012 and abs(mean - 1) < 0.02 and abs(spread - 1) < 0.05 and abs(same) < 0.02


def test_out_of_bag_is_near_the_hold_out(spark, samples):
    settings = learning.ForestSettings(trees=20, depth=5, min_leaf=2, subset="all")
    inside, outside = learning.holdout(samples, 0.5)
    weighed = learning.balanced(inside)
    forest = forests.bagged_forest(weighed, ("a", "b"), settings, 10)
    assert forest.nodes.select("bag", "tree").distinct().count() == 20
    oob = forests.out_of_bag_accuracy(forest, weighed, 10)
    whole = forests.apply_forest(forest, outside).agg(F.avg((F.col("class") == F.col("label")).cast("double"))).first()[0]
    own = forests.apply_forest(forest, inside).agg(F.avg((F.col("class") == F.col("label")).cast("double"))).first()[0]
    assert abs(oob - whole) < 0.04 and own > oob
    # by plain counting over single trees
    judged = forests.out_of_bag(forest, weighed.limit(40), 10).collect()
    drawn = {r.pixel_id: r for r in weighed.limit(40).select("pixel_id", *(forests.draws(b, F.concat_ws(":", "pixel_id", "date")).alias(f"d{b}") for b in range(10))).collect()}
    trees = {}
    for n in forest.nodes.collect():
        trees.setdefault((n.bag, n.tree), {})[n.node] = n
    for r in judged:
        sums = [0.0] * 3
        for (bag, _), tree in trees.items():
            if drawn[r.pixel_id][f"d{bag}"] == 0:
                at = tree[0]
                while at.left != at.node:
                    at = tree[at.left if (r.a, r.b)[at.feature] <= at.split else at.right]
                sums = [x + y for x, y in zip(sums, at.shares)]
        assert r.n_out == sum(drawn[r.pixel_id][f"d{b}"] == 0 for b in range(10))
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(sums, r.oob_votes))
        assert r.oob_class == ((1, 3, 4)[sums.index(max(sums))] if max(sums) > 0 else None)


def plain_cv(samples, features, settings):
    scores = []
    for fold in range(6):
        model = learning.forest(features, settings).fit(learning.balanced(samples.filter(F.col("fold") != fold)))
        outside = samples.filter(F.col("fold") == fold).withColumn("weight", F.lit(1.0))
        scores.append(learning.macro_f1(learning.predicted(model, outside), "label", "predicted").first()["macro_f1"])
    return scores


def test_validation_in_parallel_equals_one_fit_after_another(samples):
    mean, deviation, scores = learning.spatial_cv(samples, ("a", "b"), SMALL)
    want = plain_cv(samples, ("a", "b"), SMALL)
    assert all(math.isclose(x, y) for x, y in zip(scores, want)) and len(scores) == 6
    assert math.isclose(mean, sum(want) / 6) and math.isclose(deviation, (sum((x - mean) ** 2 for x in want) / 6) ** 0.5)
    # a fold outside of which there is one class alone is left out
    lone = samples.withColumn("label", F.when(F.col("fold") == 2, F.col("label")).otherwise(1))
    assert len(learning.spatial_cv(lone, ("a", "b"), SMALL)[2]) == 5


def test_settings_ask_for_out_of_bag(spark):
    from tests.test_sources import SMALL as small
    from tests.test_sources import pair_of

    pair, shape = pair_of(spark, 30)
    labels = pair.select("r", "c", F.when(F.col("r") < 15, 10).otherwise(60).alias("wc"))
    settings = learning.replace(small, bags=4)
    found = learning.random_forest(pair, shape, labels, 400, settings, cross_validate=False)
    assert found.oob is not None and 0 <= found.oob <= 1 and learning.random_forest(pair, shape, labels, 400, small, cross_validate=False).oob is None
