"""Change detection as scenes arrive: a stream of pair tables through a method, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.methods import methods_by_scene


def change_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, method: str = "NDVI Differencing", scene: str = "scene_id", available_now: bool = True) -> StreamingQuery:
    """Runs a method on the scenes of newly arrived Parquet files and writes their summary rows to target.

    A scene's files must arrive together. All scenes of a batch are one plan, a row
    each. Batches write by their number, so that a batch that is run again after a
    failure replaces its own rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            (found,) = (m for m in methods_by_scene(rows, scene) if m.method == method)
            found.summary.write.mode("overwrite").parquet(f"{target}/batch={number}")

    arriving = spark.readStream.schema(schema).parquet(source)
    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
