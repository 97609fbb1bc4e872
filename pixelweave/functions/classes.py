"""Land-cover classes: recodes of product codes, colours, pseudo-labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Land-cover product codes and the classes they stand for, the classes' names and their colours.
CODE_TO_CLASS = {10: 1, 20: 4, 30: 4, 40: 1, 50: 2, 60: 2, 70: 2, 80: 3, 90: 3, 95: 3, 100: 4}
CODE_TO_BINARY = {10: 1, 20: 1, 30: 1, 40: 1, 50: 2, 60: 2, 70: 2, 80: 2, 90: 2, 95: 2, 100: 1}
CLASS_NAMES = {0: "Unclassified", 1: "Vegetation", 2: "Bare Soil / Urban", 3: "Water / Shadow", 4: "Sparse Vegetation"}
CLASS_COLOURS = {0: "#ffffff", 1: "#2dc653", 2: "#c1440e", 3: "#457b9d", 4: "#f4d35e"}


def recode(code: Column, table: dict[int, int]) -> Column:
    """The class of a code, 0 for any other code and NULL."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(0))


def class_table(spark: SparkSession, table: dict[int, int]) -> DataFrame:
    """The recode as a dimension table (code, class), of a handful of rows."""
    return spark.createDataFrame(list(table.items()), "code int, class int")


def pseudo_label(ndvi_before: Column, vegetated: float = 0.15, bare: float = 0.08) -> Column:
    """1 above the first threshold, 2 below the second, 0 between and where masked."""
    return F.coalesce(F.when(ndvi_before > vegetated, 1).when(ndvi_before < bare, 2), F.lit(0))


def colour(klass: Column) -> tuple[Column, Column]:
    """Hexadecimal colour of a class and its opacity: the masked class is faint."""
    pairs = [F.lit(x) for pair in CLASS_COLOURS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), klass.cast("int")), F.when(klass == 0, 0.25).otherwise(1.0)
