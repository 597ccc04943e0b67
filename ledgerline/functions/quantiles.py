"""Exact percentiles of groups of any size."""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.plans.stage import write_stage


def exact_percentiles(df: DataFrame, by: list, value: str, probs: dict) -> DataFrame:
    """Interpolated percentiles per group without gathering a group in one place.

    Equal values are counted first (map-side), the distinct ones are range
    partitioned over all groups together, and a running count inside each range
    plus the counts of the ranges before it gives every value its exact rank.
    The ranged table is written before it is read twice, so both reads see the
    same ranges.  Null, NaN and infinite values do not take part.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    counted = df.where(ok).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = write_stage(
        counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    per_part = ranged.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part")  # one row per range
    per_part = (per_part.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
                .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by))).drop("_n"))
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.withColumn("_cum", F.sum("_c").over(inside)).join(per_part, [*by, "_part"])
    ranks = ranks.withColumn("_upto", F.col("_before") + F.col("_cum"))
    aggs = [F.first("_total").alias("n")]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("_upto") > pos, F.col("_v"))).alias(f"{name}_{side}"))
    out = ranks.groupBy(*by).agg(*aggs)
    mixed = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        mixed.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*by, "n", *mixed)
