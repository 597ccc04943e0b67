"""Trailing twelve months: year + current year-to-date - prior year-to-date."""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.dims import template as T
from ledgerline.functions import columns as C
from ledgerline.plans.stage import unbroadcast
from ledgerline.sources.layout import of_tags

RUNGS = 4


def interim_spans(obs: DataFrame, filers: DataFrame) -> DataFrame:
    """Distinct spans of one to three quarters reported for an anchor tag."""
    rows = of_tags(obs, T.anchor_tags()).where(F.col("is_duration") & F.col("days").between(C.YTD_MIN, C.YTD_MAX))
    # folded per tag and span before the filer's industry is joined
    first = F.min(F.struct("unit_ord", F.col("first.pos").alias("pos")))
    rows = rows.groupBy("cik", "tag", "end", "days").agg(first.alias("first"), F.max(F.col("n_10q") > 0).alias("on_10q"))
    rows = rows.join(filers.select("cik", "industry"), "cik").join(
        F.broadcast(T.period_tags(obs.sparkSession)), ["industry", "tag"])
    seen = F.struct("tag_ord", F.col("first.unit_ord").alias("unit_ord"), F.col("first.pos").alias("pos"))
    return rows.groupBy("cik", "end", "days").agg(
        F.min(seen).alias("seen"), F.max("on_10q").alias("on_10q")
    ).withColumn("start", F.date_sub("end", F.col("days")))


def rung_options(spans: DataFrame, periods: DataFrame, rungs: int = RUNGS) -> DataFrame:
    """Spans that start with the year after one of the newest fiscal years.

    The +-10 day tolerance becomes 21 start dates per year, so the match is an
    equi-join on (cik, start) instead of a comparison of all pairs.  Spark sees the
    years only, which fit a broadcast long before their 21 dates do.
    """
    years = periods.where(F.col("idx") <= rungs).select(
        "cik", F.col("idx").alias("k"), F.col("end").alias("fy_end"),
        F.explode(F.sequence(F.date_sub("end", 9), F.date_add("end", 11))).alias("start"))
    return spans.join(unbroadcast(years), ["cik", "start"]).where(F.col("end") > F.col("fy_end"))


def ytd_rungs(spans: DataFrame, periods: DataFrame, rungs: int = RUNGS) -> DataFrame:
    """Rung 0 is the newest 10-Q span; rung k the span like it, k years earlier.

    Rungs after the first missing one are dropped.
    """
    opts = rung_options(spans, periods, rungs)
    rung0 = opts.where("k = 0 AND on_10q").groupBy("cik").agg(F.max(F.struct("end", "days", "start")).alias("r"))
    base = rung0.select("cik", F.col("r.end").alias("end0"), F.col("r.days").alias("days0"))
    older = opts.where("k > 0").join(base, "cik").withColumn(
        "off", F.abs(F.date_diff("end", F.date_sub("end0", F.col("k") * 365))))
    older = older.where((F.abs(F.col("days") - F.col("days0")) <= C.SPAN_SLACK) & (F.col("off") <= 35))
    near = older.groupBy("cik", "k").agg(F.min_by(F.struct("end", "days", "start"), F.struct("off", "seen")).alias("r"))
    found = rung0.select("cik", F.lit(0).alias("k"), "r").unionByName(near)
    w = Window.partitionBy("cik").orderBy("k")  # one row more than there are rungs
    found = found.withColumn("unbroken", F.row_number().over(w) - 1 == F.col("k")).where("unbroken")
    return found.select("cik", "k", "r.start", "r.end", "r.days")


def ltm_windows(rungs: DataFrame, periods: DataFrame) -> DataFrame:
    """Pair rung k with rung k + 1 and with the fiscal years they follow."""
    cur = rungs.select("cik", "k", F.col("start").alias("cur_start"), F.col("end").alias("cur_end"),
                       F.col("days").alias("cur_days"))
    prior = rungs.where("k > 0").select("cik", (F.col("k") - 1).alias("k"), F.col("start").alias("prior_start"),
                                        F.col("end").alias("prior_end"), F.col("days").alias("prior_days"))
    fy = periods.select("cik", F.col("idx").alias("k"), "industry", "ccy", F.col("end").alias("fy_end"))
    prev = periods.select("cik", (F.col("idx") - 1).alias("k"), F.col("end").alias("prev_fy_end"))
    return cur.join(prior, ["cik", "k"]).join(fy, ["cik", "k"]).join(prev, ["cik", "k"])


def basis_check(obs: DataFrame, facts: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs whose prior span was re-presented without the fiscal year following.

    ``legs``: (cik, k, tag, prior_end, cur_days, prev_fy_end, fy_accn).  Returns
    the (cik, k, tag) that must not be stitched.
    """
    h = obs.where("is_duration").select("cik", "tag", "end", "days", "unit_ord", "val", "n", "hist_first", "hist_last")
    lo = F.struct(F.col("hist_first.filed").alias("f"), "unit_ord", F.col("hist_first.pos").alias("p"))
    hi = F.struct(F.col("hist_last.filed").alias("f"), "unit_ord", F.col("hist_last.pos").alias("p"))
    key = ["cik", "tag", "k"]
    ends = [F.sum("n").alias("n"), F.min_by("val", lo).alias("v0"), F.max_by("val", hi).alias("v1")]
    asked = legs.select(*key, F.col("prior_end").alias("end"), "cur_days")
    pri = h.join(asked, ["cik", "tag", "end"]).where(
        F.col("days").between(F.col("cur_days") - C.SPAN_SLACK, F.col("cur_days") + C.SPAN_SLACK)).groupBy(*key).agg(*ends)
    suspect = pri.where((F.col("n") >= 2) & C.moved("v0", "v1")).select(*key)
    asked = legs.join(suspect, key, "left_semi").select(*key, F.col("prev_fy_end").alias("end"), "fy_accn")
    prev = h.where(C.is_annual()).join(asked, ["cik", "tag", "end"]).groupBy(*key).agg(*ends[:2])
    in_fy = (facts.where(F.col("is_duration") & C.is_annual())
             .join(asked.withColumnRenamed("fy_accn", "accn"), ["cik", "tag", "end", "accn"])
             .groupBy(*key).agg(F.max_by("val", F.struct("filed", "unit_ord", "pos")).alias("in_fy")))
    followed = prev.join(in_fy, key).where((F.col("n") > 1) & C.moved("v0", "in_fy")).select(*key)
    return suspect.join(followed, key, "left_anti")


def stitch(obs: DataFrame, facts: DataFrame, windows: DataFrame, fy_cells: DataFrame, picks: DataFrame) -> DataFrame:
    """Duration rows of the LTM columns, all three legs from the annual pick's tag and unit."""
    fy = fy_cells.where("NOT is_instant").select(
        "cik", "industry", "k", F.col("end").alias("fy_end"), "status", "ccy", "plain_pick.*").withColumnRenamed("k", "line")
    w = windows.drop("industry", "ccy").join(fy, ["cik", "fy_end"])
    leg = lambda name, pre: picks.where("shape = 'D' AND gate").select(
        "cik", "tag", F.col("end").alias(f"{pre}_end"), F.col("dmin").alias(f"{pre}_dmin"),
        F.col("val").alias(f"{pre}_val"), F.col("unit").alias(f"{pre}_unit"))
    w = w.withColumn("cur_dmin", F.col("cur_days") - C.SPAN_SLACK).withColumn("prior_dmin", F.col("prior_days") - C.SPAN_SLACK)
    w = w.join(leg("cur", "cur"), ["cik", "tag", "cur_end", "cur_dmin"], "left")
    w = w.join(leg("prior", "prior"), ["cik", "tag", "prior_end", "prior_dmin"], "left")
    ready = F.coalesce((F.col("cur_unit") == F.col("unit")) & (F.col("prior_unit") == F.col("unit")), F.lit(False))
    ready = ready & F.col("cur_val").isNotNull() & F.col("prior_val").isNotNull()
    w = w.withColumn("ready", ready)
    legs = w.where("ready").select("cik", "k", "tag", "prior_end", "cur_days", "prev_fy_end",
                                   F.col("accn").alias("fy_accn")).distinct()
    bad = basis_check(obs, facts, legs).withColumn("bad", F.lit(True))
    w = w.join(bad, ["cik", "k", "tag"], "left")
    out = (F.when(F.col("val").isNull(), F.col("status")).when(~F.col("ready"), "no-interim")
           .when(F.col("bad"), "restated-basis").otherwise("ltm"))
    ok = out == "ltm"
    return w.select(
        "cik", "industry", F.lit("LTM").alias("basis"), F.col("cur_end").alias("end"), F.col("line").alias("k"),
        F.lit(False).alias("is_instant"),
        F.when(ok, F.col("val") + F.col("cur_val") - F.col("prior_val")).alias("value"),
        F.when(ok, F.col("unit")).alias("unit"), "tag",
        *[F.when(ok, F.col(c)).alias(c) for c in ("accn", "form", "filed")],
        F.when(ok, F.date_sub("cur_end", 364)).alias("start"), F.coalesce("descaled", F.lit(False)).alias("descaled"),
        out.alias("status"), F.when(F.col("val").isNull(), F.col("ccy")).alias("ccy"))


def carried_filers(periods: DataFrame, windows: DataFrame, rungs: DataFrame) -> DataFrame:
    """Filers with no LTM column and no 10-Q after their newest year: the year stands in."""
    newest = periods.where("idx = 0")
    return (newest.join(windows.select("cik").distinct(), "cik", "left_anti")
            .join(rungs.where("k = 0").select("cik"), "cik", "left_anti").select("cik", "end"))


#: Days that a year-to-date span may begin off the end of the year before; interim ends nearer to each other than MERGE_DAYS are one.
START_SLACK, MERGE_DAYS = 10, 20


def interim_ends(obs: DataFrame, windows: DataFrame) -> DataFrame:
    """(cik, side, slot, end, days, quarter_days): where the interim periods of the newest window's two fiscal years end.

    They are read off the filer's own year-to-date spans in their order, so quarters
    of twelve, thirteen or sixteen weeks are all the same: slot 1 is the first
    interim period after a year end.  ``days`` is the length of the span to date
    and ``quarter_days`` that of the period alone.  Of ends a few days apart the
    most reported stays; the window's own end always does.
    """
    w = windows.where("k = 0")
    sides = w.select("cik", F.inline(F.array(
        F.struct(F.lit("cur").alias("side"), F.col("fy_end").alias("base"), F.col("cur_end").alias("own"), F.col("cur_end").alias("last")),
        F.struct(F.lit("prior").alias("side"), F.col("prev_fy_end").alias("base"), F.col("prior_end").alias("own"), F.date_sub("fy_end", 30).alias("last")))))
    spans = obs.where(F.col("is_duration") & F.col("is_periodic") & (F.col("n_10q") > 0) & F.col("days").between(C.YTD_MIN, C.YTD_MAX)).groupBy(
        "cik", "end", "days").agg(F.sum("n_10q").alias("n"))
    starts = sides.withColumn("start", F.explode(F.sequence(F.date_add("base", 1 - START_SLACK), F.date_add("base", 1 + START_SLACK))))
    hit = spans.withColumn("start", F.date_sub("end", F.col("days"))).join(unbroadcast(starts), ["cik", "start"]).where("end > base AND end <= last")
    ends = hit.groupBy("cik", "side", "base", "own", "end").agg(F.sum("n").alias("n"), F.max_by("days", F.struct("n", "days")).alias("days"))
    # one filer's interim ends of one year: a handful
    near = Window.partitionBy("cik", "side").orderBy("end")
    ends = ends.withColumn("apart", F.coalesce((F.date_diff("end", F.lag("end").over(near)) > MERGE_DAYS).cast("int"), F.lit(1))).withColumn("slot", F.sum("apart").over(near).cast("int"))
    best = F.max_by(F.struct("end", "days"), F.struct((F.col("end") == F.col("own")).alias("is_own"), "n", "end"))
    one = ends.groupBy("cik", "side", "slot", "base").agg(best.alias("b")).select("cik", "side", "slot", "base", "b.end", "b.days")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("cik", "side").orderBy("slot")), F.date_sub("end", F.col("days") + 1))
    return one.withColumn("quarter_days", F.date_diff("end", before) - 1).drop("base")


def _spans(end, days):
    """The request for a span of about so many days."""
    return F.struct(end.alias("end"), F.lit("D").alias("shape"), (days - C.SPAN_SLACK).alias("dmin"), (days + C.SPAN_SLACK).alias("dmax"), F.lit(True).alias("gate"))


def quarter_requests(windows: DataFrame, ends: DataFrame) -> DataFrame:
    """Requests of ``reconstruct_ltm``: the interim periods and spans to date of two fiscal years, and the year between."""
    w = windows.where("k = 0")
    year = F.struct(F.col("fy_end").alias("end"), F.lit("D").alias("shape"), F.lit(C.ANNUAL_MIN).alias("dmin"), F.lit(C.ANNUAL_MAX).alias("dmax"), F.lit(True).alias("gate"))
    asked = w.select("cik", "ccy", F.inline(F.array(year)))
    spans = F.array(_spans(F.col("end"), F.col("days")), _spans(F.col("end"), F.col("quarter_days")))
    asked = asked.unionByName(ends.join(w.select("cik", "ccy"), "cik").select("cik", "ccy", spans.alias("a")).select("cik", "ccy", F.inline("a")))
    return asked.select("cik", "end", "ccy", "shape", "dmin", "dmax", "gate").distinct()


def reconstruct_ltm(picks: DataFrame, windows: DataFrame, ends: DataFrame, tags=None) -> DataFrame:
    """Rebuild the newest LTM of a tag without the stitch: the interim periods after the window's start and the year's last one.

    Each period's figure is the filed one where it exists and otherwise the
    difference of neighbouring figures to date; the year's last period is the year
    less what is to date before it.  ``picks`` must hold ``quarter_requests``,
    ``ends`` is ``interim_ends``.  A tag with a period that neither is filed nor is
    such a difference has no row.
    """
    p = picks.where("shape = 'D' AND gate").select("cik", "tag", "end", "dmin", "val")
    if tags:
        p = p.where(F.col("tag").isin(list(tags)))
    w = windows.where("k = 0").select("cik", "fy_end", "cur_end", "prior_end")
    # the interim periods of two years: a handful a filer
    slots = ends.groupBy("cik").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(
            "slot", "end", (F.col("days") - C.SPAN_SLACK).alias("y"), (F.col("quarter_days") - C.SPAN_SLACK).alias("q"))))).alias(side) for side in ("cur", "prior")])
    told = p.join(w.select("cik"), "cik").groupBy("cik", "tag").agg(F.collect_list(F.struct("end", "dmin", "val")).alias("vals"))
    rows = told.join(slots, "cik").join(w, "cik")
    value = lambda end, dmin: F.get(F.filter("vals", lambda v: (v["end"] == end) & (v["dmin"] == dmin)), F.lit(0))["val"]

    def parts(side: str):
        """(end, figure of the period, figure to date), in order."""
        known = F.transform(side, lambda s: F.struct(s["end"].alias("end"), value(s["end"], s["y"]).alias("y"), value(s["end"], s["q"]).alias("q")))
        later = lambda k, i: F.get(k, i + 1)["y"] - F.get(k, i + 1)["q"]
        seen = F.transform(known, lambda s, i: F.struct(s["end"].alias("end"), F.coalesce(s["y"], F.when(i == 0, s["q"])).alias("y"), s["q"].alias("q"), later(known, i).alias("later")))
        none = F.filter(F.transform(seen, lambda s: F.struct(s["end"].alias("end"), s["y"].alias("part"), s["y"].alias("to_date"))), lambda s: F.lit(False))

        def step(acc, s):
            before = F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(F.try_element_at(acc, F.lit(-1))["to_date"])
            to_date = F.coalesce(s["y"], before + s["q"], s["later"])
            return F.concat(acc, F.array(F.struct(s["end"].alias("end"), F.coalesce(s["q"], to_date - before).alias("part"), to_date.alias("to_date"))))

        return F.aggregate(seen, none, step)

    rows = rows.withColumn("cur_parts", parts("cur")).withColumn("prior_parts", parts("prior")).withColumn("fy", value(F.col("fy_end"), F.lit(C.ANNUAL_MIN)))
    rows = rows.withColumn("used", F.concat(F.col("cur_parts"), F.filter("prior_parts", lambda s: s["end"] > F.col("prior_end"))))
    whole = F.forall("used", lambda s: s["part"].isNotNull()) & F.exists("cur_parts", lambda s: s["end"] == F.col("cur_end")) & F.exists("prior_parts", lambda s: s["end"] == F.col("prior_end"))
    total = F.aggregate("used", F.lit(0.0), lambda a, s: a + s["part"])
    fourth = F.col("fy") - F.try_element_at("prior_parts", F.lit(-1))["to_date"]
    return rows.where(whole).select("cik", "tag", F.col("cur_end").alias("end"), (total + fourth).alias("rebuilt")).where("rebuilt IS NOT NULL")
