"""Places in a total order, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.scratch import written


def numbered(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Rows with their place (from 1) in a total order."""
    sorted_rows = rows.orderBy(*order).withColumns({"part_no": F.spark_partition_id(), "in_part": F.monotonically_increasing_id()})
    sorted_rows = written(sorted_rows, "sorted")
    sizes = {r["part_no"]: r["n"] for r in sorted_rows.groupBy("part_no").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    moved = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part_no")) if before else F.lit(0)
    # monotonically_increasing_id counts within the partition below its 33rd bit
    place = F.col("in_part").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + moved
    return sorted_rows.withColumn(into, place.cast("int")).drop("part_no", "in_part")
