"""Gapless numbering within a key without gathering the key's rows in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCKS = 1024


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """Adds name: 0, 1, 2 ... within each key, ordered by block and then by order.

    Rows are numbered inside (key, block) and moved up by the rows of the key's
    lower blocks, so a key with a third of all rows spreads over its blocks.
    The counts are joined on the same columns that the window is dealt by.
    """
    rows = df.withColumn("_block", block)
    by = [*keys, "_block"]
    below = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by).count().select(
        *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return (inside.join(counts, match).withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_at", "_before", "_block", *[f"_{c}" for c in by]))
