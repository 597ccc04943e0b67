"""Connected components of a link table, and joins against a set of ids whose size is checked."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.plans.stage import write_stage

#: Ids that may be broadcast: about 16 MB of them.
MOST_BROADCAST = 500_000


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the least node that it reaches.

    Labels sink to the least neighbour's label and then jump to their label's
    label, so long chains halve each round; every round is a written table.
    """
    both = write_stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = write_stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        sunk = labels.join(near, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("was"))
        over = sunk.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        labels = write_stage(sunk.join(over, "comp").select("node", F.least("comp", "further").alias("comp"), "was"), f"{name}-{step}")
        if labels.where("comp <> was").limit(1).count() == 0:
            return labels.select("node", "comp")


def of_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """df semi or anti joined with ids (one column of the same name); ids are broadcast only if they are counted to be few."""
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    other = ids.select(F.col(column).alias("_id"))
    return df.join(F.broadcast(other) if few else other, df[column].eqNullSafe(F.col("_id")), how)
