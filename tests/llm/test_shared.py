from pyspark.sql import functions as F

from pixelweave.llm import shared


def test_stored_tables_are_cleared(spark, tmp_path, monkeypatch):
    kept = shared.stored(spark.range(5))
    monkeypatch.setattr(shared, "_tables", lambda spark: str(tmp_path / "tables"))
    assert shared.stored(spark.range(3)).count() == 3 and (tmp_path / "tables").exists()
    shared.clear(spark)
    assert not (tmp_path / "tables").exists() and kept.count() == 5


def test_pair_hash_tells_nulls_and_values_apart(spark):
    rows = [(None, None), (None, "a"), (1, None), (1, "a"), (0, ""), (None, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    made = df.withColumn("h", shared.pair_hash(F.col("k").isNull(), F.col("k"), F.col("t").isNull(), F.col("t")))
    assert made.schema["h"].dataType.simpleString() == shared.PAIR.replace(" ", "")
    assert made.select("h").distinct().count() == len(rows)
    assert made.union(made).groupBy("h").count().filter("count != 2").isEmpty()
