"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the mean of its copies.  Among all rates that meet every
source's token target, those nearest to "one copy each" in relative entropy are
exponential tilts of a base law of 0 to MOST copies with mean 1:

    rate(n) = MOST * e^(t n) / (e^(t n) + MOST - 1)

with one multiplier t per source and n the document's size over the source's mean
size.  The multipliers solve the convex dual, whose gradient is the tokens taken
less the target, by Newton steps.  Rates depend on source and size only, so the
corpus is first counted by (source, size); every Newton step aggregates that
table.  A bracket keeps each source's steps from leaving the root.

Rounding: documents of one source and size share a whole number of copies, the
difference of cumulated rates in falling order of size, so a source's copies are
never off by more than a half at any size.  What is then missing or too much in
words is mended with the largest sizes that still fit, REPAIRS times.  Which of
the equal-sized documents get one copy more is drawn by a hash of the row.

Windows run over sources, or over the sizes of a source, never over documents of a
source; documents are ranked within parts of about GROUP of one source and size.
Sums that decide anything are whole numbers, so reruns agree.  Null texts have size
0 and are never taken; a null source is a source; repeated rows are documents of
their own; a source with only empty documents has target 0.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.tables import words
from ledgerline.plans.stage import write_stage

MOST, REPAIRS, STEPS, TOLERANCE = 3, 4, 40, 2e-4
#: Documents of one source and size that are ranked together.
GROUP = 512
#: Fixed point of summed rates.
_UNIT = float(1 << 20)


def source_targets(sizes: DataFrame, weights: tuple = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """(source, n, target) from (source, n): shares of all words by weight, none above most times its own.

    Sources whose share would be above are those with the least most * n / weight,
    up to the first whose ratio the common level of the others does not reach.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", (F.col("n") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = (t.withColumn("level", (F.sum("n").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
         .withColumn("free", F.col("level") <= F.col("ratio")))
    # the first free source's level holds for it and all behind it
    level = F.min(F.when(F.col("free"), F.struct("ratio", F.col("source").isNull().alias("z"), "source", "level"))).over(everything).level
    return t.select("source", "n", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("w") * level, F.col("cap")))).alias("target"))


def _rate(t: Column, n: Column, most: int) -> Column:
    """The tilted mean number of copies, without overflow."""
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -t * n))))


def balance(counts: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, t, full) from counts (source, size, docs): t is the multiplier; full sources take most copies of all they have.

    Newton steps inside the bracket found so far; what STEPS of them leave is halved on.
    """
    means = counts.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("docs") * F.col("size")) / F.sum("docs")).alias("mean"))
    state = targets.join(means, targets["source"].eqNullSafe(F.col("s"))).select(
        "source", "target", "mean", F.lit(0.0).alias("t"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (F.col("target") >= F.col("n") * most).alias("full"),
        (F.col("target") <= 0).alias("done")).withColumn("done", F.col("done") | F.col("full"))
    state = write_stage(state, "tilt-0")
    for step in range(1, 3 * STEPS + 1):
        s = state.select(*[F.col(c).alias(f"_{c}") for c in ("source", "t", "mean", "done")])
        x = counts.join(s, F.col("source").eqNullSafe(F.col("_source"))).where("not _done")
        z = F.col("size") / F.col("_mean")
        rate = _rate(F.col("_t"), z, most)
        whole = lambda c: F.sum(F.round(c * _UNIT).cast("decimal(38,0)")).cast("double") / _UNIT
        sums = x.groupBy("source").agg(whole(rate * F.col("docs") * F.col("size")).alias("got"),
                                       whole(rate * (1 - rate / most) * z * F.col("docs") * F.col("size")).alias("slope"))
        sums = sums.select(F.col("source").alias("_source"), "got", "slope")
        gap = F.col("target") - F.col("got")
        lo, hi = F.when(gap > 0, F.col("t")).otherwise(F.col("lo")), F.when(gap < 0, F.col("t")).otherwise(F.col("hi"))
        newton = F.col("t") + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), gap / F.greatest("slope", F.lit(1e-12))))
        near = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("lo", lo).withColumn("hi", hi)
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & F.lit(step <= STEPS)
        bounded = (F.col("lo") > -1e6) & (F.col("hi") < 1e6)
        moved = F.when(inside, newton).when(bounded, (F.col("lo") + F.col("hi")) / 2).otherwise(F.when(gap > 0, F.col("t") * 2 + 1).otherwise(F.col("t") * 2 - 1))
        over = F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target"))
        state = write_stage(near.select("source", "target", "mean", F.when(over, F.col("t")).otherwise(moved).alias("t"),
                                        "lo", "hi", "full", over.alias("done")), f"tilt-{step}")
        if state.where("not done").limit(1).count() == 0:
            return state
    raise RuntimeError("the dual of some sources is not solved; their targets cannot be met")


def copies_by_size(counts: DataFrame, state: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, docs, copies): whole copies that the documents of one source and size share."""
    s = state.select(F.col("source").alias("_source"), "target", "mean", "t", "full")
    x = counts.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("full"), F.lit(float(most))).when((F.col("target") <= 0) | (F.col("size") == 0), F.lit(0.0)).otherwise(_rate(F.col("t"), F.col("size") / F.col("mean"), most))
    fixed = F.round(rate * F.col("docs") * _UNIT).cast("decimal(38,0)")
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.floor(F.sum(fixed).over(down) / F.lit(1 << 20).cast("decimal(20,0)") + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    x = x.withColumn("run", run).withColumn("fixed", fixed)
    step = F.col("run") - F.coalesce(F.lag("run").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    x = write_stage(x.select("source", "size", "docs", F.least(F.greatest(step, F.lit(0)), F.col("docs") * most).alias("copies"), F.round("target").cast("long").alias("wanted")), "copies-0")
    for i in range(1, REPAIRS + 1):
        gaps = x.groupBy("source").agg((F.max("wanted") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        g = gaps.select(F.col("source").alias("_source"), "gap")
        x = x.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        room = F.when(F.col("gap") > 0, F.col("docs") * most - F.col("copies")).otherwise(F.col("copies"))
        usable = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0)
        pick = F.max(F.when(usable, F.col("size"))).over(Window.partitionBy("source"))
        change = F.when(F.col("size") == pick, F.least(room, F.floor(F.abs("gap") / F.col("size"))) * F.signum("gap").cast("long")).otherwise(F.lit(0))
        x = write_stage(x.withColumn("copies", (F.col("copies") + F.coalesce(change, F.lit(0))).cast("long")).drop("gap"), f"copies-{i}")
    return x.select("source", "size", "docs", "copies")


def mix(docs: DataFrame, weights: tuple = (1.0, 2.0, 3.0), most: int = MOST, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", keep: tuple = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) and the columns in keep, for every row.

    Rows are told apart by id and a checksum of the text; ids tie only among equal rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.size(words(text)).cast("long").alias("size"),
                       F.xxhash64(id_column, text).alias("draw"), *keep)
    if not keep:
        rows = write_stage(rows, "sized")
    counts = write_stage(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "size-counts")
    targets = write_stage(source_targets(counts.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("n")), weights, most), "source-targets")
    shared = copies_by_size(counts, balance(counts, targets, most), most)
    shared = shared.join(targets.select(F.col("source").alias("_s"), F.col("n").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    parts = F.ceil(F.col("docs") / GROUP).cast("int")
    group = shared.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "docs", "copies", "source_size", "target", parts.alias("parts"))
    dealt = rows.join(group, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    dealt = dealt.withColumn("part", F.pmod("draw", F.col("parts")).cast("int"))
    # how the extra copies of a (source, size) fall to its parts, by the parts' cumulated rows
    by = ["source", "size", "part"]
    have = dealt.groupBy(*by).agg(F.count("*").alias("rows"), F.max("docs").alias("docs"), F.max("copies").alias("copies"))
    below = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.pmod("copies", F.col("docs"))
    upto = lambda c: F.floor(extra * c / F.col("docs").cast("decimal(20,0)")).cast("long")
    cuts = have.withColumn("below", below).select(*[F.col(c).alias(f"_{c}") for c in by], (upto(F.col("below")) - upto(F.col("below") - F.col("rows"))).alias("more"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("draw", "id"))
    out = dealt.withColumn("place", place).join(cuts, match).withColumn(
        "copies", (F.floor(F.col("copies") / F.col("docs")) + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
